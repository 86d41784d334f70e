"""The registered queries as SQL for DuckDB, written independently of the Spark plans.

Rules that Spark fuses or folds are stated step by step here.  DuckDB's regex engine has no
lookaround and no back-references, so those patterns appear in their plain spellings.
"""

from __future__ import annotations

import re
import string

from folioforge.functions import fixed_values as fv
from folioforge.plans.inputs import DEFECTS, PAGE_TOPS

K, DIM = 5, 64
BLANKS = " \t\n\r\x0b\f"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"trim({x}, {q(BLANKS)})"


def literal(x: str, table) -> str:
    for a, b in table:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def subs(x: str, table) -> str:
    for a, b in table:
        x = f"regexp_replace({x}, {q(a)}, {q(b)}, 'g')"
    return x


def count_matches(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def n_words(x: str) -> str:
    return count_matches(x, r"\S+")


# --- inputs -----------------------------------------------------------------------

PLAIN = "docs AS (SELECT doc_id, source, text FROM documents)"
NOISY = f"docs AS (SELECT doc_id, source, {literal('text', DEFECTS)} AS text FROM documents)"
_TOP = " ".join(f"WHEN {i} THEN {q(t)}" for i, t in enumerate(PAGE_TOPS))
TOPPED = (
    f"docs AS (SELECT doc_id, source, (CASE doc_id % {len(PAGE_TOPS)} {_TOP} END) || "
    f"replace(text, chr(10), chr(10) || ' ' || chr(10)) AS text FROM documents)"
)

# --- cleaning ---------------------------------------------------------------------

# Published patterns and tables, which results depend on.
SPACES = [
    ("([a-z])([A-Z])", r"\1 \2"),
    (r"([a-z])(\d)", r"\1 \2"),
    (r"([A-Z])(\d)", r"\1 \2"),
    (r"(\d)([A-Za-z])", r"\1 \2"),
    (r"\.([A-Z][a-z])", r". \1"),
    ("([,;])([a-zA-Z])", r"\1 \2"),
    (r"\)([a-zA-Z])", r") \1"),
    (r"([a-zA-Z])(\()", r"\1 \2"),
    ("([a-zA-Z])([=<>])", r"\1 \2"),
    ("([=<>])([a-zA-Z])", r"\1 \2"),
    (":([a-zA-Z])", r": \1"),
    (r"%(\d)", r"% \1"),
    (r"(\d)%", r"\1 %"),
]
# Published patterns and tables, which results depend on.
ARTIFACTS = (
    [(c + "{4,}", c * 2) for c in string.ascii_letters]
    + [("[.]{3,}", "."), ("[!]{3,}", "!"), ("[?]{3,}", "?")]
    + [("-{2,}", "—"), ("_{2,}", "_"), (r"\*{2,}", "*")]
    + [(r"\\\(", " ("), (r"\\\)", ") "), (r"\\\[", "["), (r"\\\]", "] ")]
    + [
        (r"([a-zA-Z])\s*\^\s*([0-9])", r"\1^\2"),
        (r"([a-zA-Z])\s*_\s*([0-9a-zA-Z])", r"\1_\2"),
        (
            r"(Chapter|Section|Equation|Figure|Table|Algorithm)\s+([0-9]+)\s+([0-9]+)",
            r"\1 \2.\3",
        ),
    ]
)
# Published patterns and tables, which results depend on.
BLANKING = [
    (r"\n\s*\n\s*\n", "\n\n"),
    (" +", " "),
    (r"\s+([.,;:!?])", r"\1"),
    ("([.,;:!?])([a-zA-Z])", r"\1 \2"),
]


def spaces(x):
    return subs(x, SPACES)


def encoding(x):
    return literal(x, fv.ENCODING_FIXES)


def math_symbols(x):
    return literal(x, fv.MATH_SYMBOL_FIXES)


def artifacts(x):
    return subs(x, ARTIFACTS)


def abbreviations(x):
    return literal(x, fv.ABBREVIATIONS)


def whitespace(x):
    return trim(literal(subs(x, BLANKING), [("\r\n", "\n"), ("\r", "\n")]))


def clean(x):
    for step in (spaces, encoding, math_symbols, artifacts, abbreviations, whitespace):
        x = step(x)
    return x


def digest(docs: str, expr: str) -> str:
    return (
        f"WITH {docs}, t AS (SELECT doc_id, {expr} AS t FROM docs) "
        "SELECT doc_id, length(t) AS n_chars, md5(t) AS text_md5 FROM t"
    )


# --- math -------------------------------------------------------------------------

_DOLLAR = r"\$[^\$]+\$"
_DISPLAY = r"(?s)\\\[.*?\\\]"
_PAREN = r"(?s)\\\(.*?\\\)"
# Published patterns and tables, which results depend on.
PROTECTED = [
    ("INLINE_MATH", _DOLLAR),
    ("DISPLAY_MATH", _DISPLAY),
    ("INLINE_MATH", _PAREN),
    ("ENV_MATH", r"(?s)\\begin\{.*?\}.*?\\end\{.*?\}"),
]


def protected() -> str:
    ctes = ["p0 AS (SELECT doc_id, text, 0 AS n, []::VARCHAR[] AS marks, []::VARCHAR[] AS blocks FROM docs)"]
    for i, (kind, pattern) in enumerate(PROTECTED):
        ctes.append(
            f"m{i} AS (SELECT *, regexp_extract_all(text, {q(pattern)}) AS hits, "
            f"regexp_split_to_array(text, {q(pattern)}) AS gaps FROM p{i})"
        )
        mark = f"'__{kind}_' || (n + i - 1) || '__'"
        ctes.append(
            f"p{i + 1} AS (SELECT doc_id, array_to_string(list_transform(range(1, len(gaps) + 1), "
            f"lambda i: gaps[i] || CASE WHEN i <= len(hits) THEN {mark} ELSE '' END), '') AS text, "
            f"n + len(hits) AS n, "
            f"list_concat(marks, list_transform(range(1, len(hits) + 1), lambda i: {mark})) AS marks, "
            f"list_concat(blocks, hits) AS blocks FROM m{i})"
        )
    return ", ".join(ctes)


# Published patterns and tables, which results depend on.
EQUATIONS = [
    ("inline", _DOLLAR),
    ("display", _DISPLAY),
    ("inline", _PAREN),
    ("display", r"(?s)\\begin\{equation\}.*?\\end\{equation\}"),
    ("display", r"(?s)\\begin\{align\}.*?\\end\{align\}"),
    ("display", r"(?s)\\begin\{eqnarray\}.*?\\end\{eqnarray\}"),
    ("simple", r"[=≠≤≥±×÷][\s]*[0-9a-zA-Z()\^_{}]+"),
    ("symbol", "[∑∫∏√∂∇∞∈∉⊂⊃∩∪∧∨∀∃¬]"),
]


def equations() -> str:
    """``eq(doc_id, p, i, type, content, st, en)``; starts are sums of gaps and matches."""
    parts = []
    for p, (kind, pattern) in enumerate(EQUATIONS):
        parts.append(
            f"SELECT doc_id, {p} AS p, i, '{kind}' AS type, hits[i] AS content, "
            "list_sum(list_transform(gaps[1:i], lambda g: length(g)))"
            " + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS st "
            "FROM (SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM "
            f"(SELECT doc_id, regexp_extract_all(text, {q(pattern)}) AS hits, "
            f"regexp_split_to_array(text, {q(pattern)}) AS gaps FROM docs))"
        )
    return (
        f"eq0 AS ({' UNION ALL '.join(parts)}), "
        "eq AS (SELECT *, st + length(content) AS en, "
        "row_number() OVER (PARTITION BY doc_id ORDER BY p, i) - 1 AS seq FROM eq0)"
    )


_CLEAN_FOR_CHUNKING = f"""WITH RECURSIVE {NOISY}, {equations()},
es AS (SELECT doc_id, list(content ORDER BY seq) AS e FROM eq GROUP BY doc_id),
hide AS (
  SELECT doc_id, 0 AS n, text FROM docs
  UNION ALL
  SELECT h.doc_id, n + 1, replace(text, e[n + 1], '__MATH_BLOCK_' || n || '__')
  FROM hide h JOIN es USING (doc_id) WHERE n < len(e)),
hidden AS (SELECT doc_id, arg_max(text, n) AS text FROM hide GROUP BY doc_id),
shown AS (
  SELECT doc_id, 0 AS n, {clean('text')} AS text FROM hidden
  UNION ALL
  SELECT s.doc_id, n + 1, replace(text, '__MATH_BLOCK_' || n || '__', e[n + 1])
  FROM shown s JOIN es USING (doc_id) WHERE n < len(e)),
t AS (SELECT doc_id, arg_max(text, n) AS t FROM shown GROUP BY doc_id)
SELECT doc_id, length(t) AS n_chars, md5(t) AS text_md5 FROM t"""

# --- corrected cleaning -----------------------------------------------------------

_REPAIRS = sorted(
    dict(reversed([("\u00e2\u02c6\u0161", "√"), ("\u00e2\u2030\u00a0", "≠")] + fv.ENCODING_FIXES + fv.MATH_SYMBOL_FIXES)).items(),
    key=lambda kv: -len(kv[0]),
)


def decoded(x):
    """Keys to private characters first, so that no value is read again."""
    hidden = [(key, chr(0xE100 + i)) for i, (key, _) in enumerate(_REPAIRS)]
    return literal(literal(x, hidden), [(c, v) for (_, c), (_, v) in zip(hidden, _REPAIRS, strict=True)])


def expanded(x):
    """Whole words: a neighbour is consumed, so that the second round finds every other one."""
    for key, value in fv.ABBREVIATIONS:
        for _ in range(2):
            x = f"regexp_replace({x}, {q(f'(^|[^a-zA-Z0-9])' + re.escape(key) + '(?:[.]|([^a-zA-Z0-9.])|$)')}, " \
                f"{q(chr(92) + '1' + _held(value) + chr(92) + '2')}, 'g')"
        x = f"replace({x}, {q(_held(value))}, {q(value)})"
    return x


def _held(value: str) -> str:
    """A stand-in that no other rule reads as a word."""
    return "\ue200" + "".join(chr(0xE300 + ord(c)) for c in value)


def fixed_after_decoding(x):
    x = literal(expanded(subs(spaces(x), ARTIFACTS)), [("\r\n", "\n"), ("\r", "\n")])
    x = subs(x, [(r"\n\s*\n\s*\n", "\n\n"), (" +", " "), (r"[^\S\n]+([.,;:!?])", r"\1"), ("([.,;:!?])([a-zA-Z])", r"\1 \2")])
    return trim(subs(x, [(r"(^|[^a-zA-Z])(e[.]|i[.]) ([ge][.])", r"\1\2\3")] * 2))


_MATH = "|".join(
    f"(?s:{p.removeprefix('(?s)')})" if p.startswith("(?s)") else f"(?:{p})" for kind, p in EQUATIONS if kind != "symbol"
)
_CLEAN_FOR_CHUNKING_FIXED = f"""WITH {NOISY},
d AS (SELECT doc_id, {decoded('text')} AS text FROM docs),
m AS (SELECT doc_id, regexp_extract_all(text, {q(_MATH)}) AS hits, regexp_split_to_array(text, {q(_MATH)}) AS gaps FROM d),
h AS (SELECT doc_id, hits, array_to_string(list_transform(range(1, len(gaps) + 1),
  lambda i: gaps[i] || CASE WHEN i <= len(hits) THEN chr(57344) || (i - 1) || chr(57345) ELSE '' END), '') AS text FROM m),
c AS (SELECT doc_id, hits, regexp_split_to_array({fixed_after_decoding('text')}, chr(57344) || '[0-9]+' || chr(57345)) AS gaps FROM h),
t AS (SELECT doc_id, array_to_string(list_transform(range(1, len(gaps) + 1),
  lambda i: gaps[i] || CASE WHEN i <= len(hits) THEN hits[i] ELSE '' END), '') AS t FROM c)
SELECT doc_id, length(t) AS n_chars, md5(t) AS text_md5 FROM t"""

# --- structure --------------------------------------------------------------------

# Published patterns and tables, which results depend on.
_SECTION_LINES = [
    r"^Chapter\s+\d+",
    r"^Section\s+\d+\.?\d*",
    r"^\d+\.\d+\s+[A-Z][a-z]",
    r"^\d+\.\d+\.\d+\s+[A-Z][a-z]",
    "^(Abstract|Introduction|Conclusion|Appendix|References)",
    r"^[A-Z][A-Z\s]+$",
]
_ANY_SECTION = " OR ".join(f"regexp_matches(s, {q(p)})" for p in _SECTION_LINES)
_BOUNDARIES = f"""WITH {TOPPED},
lines AS (SELECT doc_id, i, l, {trim('l')} AS s FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l,
         unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM docs)),
lat AS (SELECT *, coalesce(sum(length(l) + 1) OVER (
  PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM lines),
words AS (SELECT doc_id, i, w FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '\\S+')) AS w,
         unnest(range(0, len(regexp_extract_all(text, '\\S+')))) AS i FROM docs)),
wat AS (SELECT *, coalesce(sum(length(w) + 1) OVER (
  PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM words),
marks AS (SELECT doc_id, pos FROM lat WHERE s <> '' AND ({_ANY_SECTION})
  UNION SELECT doc_id, pos FROM wat WHERE i > 0 AND i % 500 = 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS seq,
       pos::INT AS char_offset FROM marks"""

_MATH_CHARS = r"[\$\\∑∫∏√∂∇∞∈∉⊂⊃∩∪∧∨∀∃¬=≠≤≥±×÷\^_{}]"
_STATS = f"""WITH {NOISY}, s AS (SELECT doc_id, {n_words('text')} AS w, length(text) AS c,
  {count_matches('text', _MATH_CHARS)} AS m,
  {' + '.join(count_matches('text', p) for p in (_DOLLAR, _DISPLAY, _PAREN))} AS e,
  list_sum(list_transform(regexp_extract_all(text, '\\S+'), lambda x: length(x))) AS letters FROM docs)
SELECT doc_id, w AS word_count, c AS char_count, round(m / c, 9) AS math_density,
  e AS equation_count, round(letters / w, 9) AS avg_word_length, (e > 0 OR m > 0) AS has_math FROM s"""

_DOC_ID = "substr(md5(source || '_' || doc_id), 1, 12)"
_LINE = trim("replace(text, chr(10), ' ')")
_IDENTIFIERS = f"""SELECT doc_id, {_DOC_ID} AS id,
  substr(md5({_DOC_ID} || '_0'), 1, 12) AS first_chunk_id, md5({_DOC_ID}) AS cache_key,
  substr(sha256(text), 1, 24) AS judge_key,
  md5(replace({trim(subs('text', [(r'[^\p{L}\p{N}_\s-]', '')]))}, ' ', '_')) AS title_md5,
  md5(CASE WHEN length({_LINE}) > 300 THEN substring({_LINE}, 1, 300) || '...' ELSE {_LINE} END) AS preview_md5
FROM documents"""

# --- chunking ---------------------------------------------------------------------

HEADS = rf"""
h_lines AS (SELECT doc_id, i, {trim('l')} AS s, l FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l,
         unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM docs)),
h_top AS (SELECT * FROM (SELECT doc_id, i, s,
    row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n,
    CASE WHEN regexp_matches(s, '^(\d{{1,4}}|[ivxlcdmIVXLCDM]{{1,7}})$') THEN 'number'
         WHEN regexp_matches(s, '^(CHAPTER|Chapter)\s+\d+\b') THEN 'heading'
         WHEN regexp_matches(s, '^\d+(\.\d+)*\.?\s+[A-Z][^\n]{{0,120}}$') THEN 'heading'
         ELSE 'body' END AS kind
  FROM h_lines WHERE s <> '') WHERE n <= 12),
h_end AS (SELECT doc_id, coalesce(min(n) FILTER (kind = 'body'), 13) AS stop FROM h_top GROUP BY doc_id),
h_sum AS (SELECT doc_id, coalesce(max(i), 0) AS skip,
    list(s ORDER BY n) FILTER (kind = 'heading') AS headings
  FROM h_top JOIN h_end USING (doc_id) WHERE n < stop GROUP BY doc_id),
heads AS (SELECT doc_id, source, coalesce(headings, []) AS headings,
    coalesce(headings[1], '') AS section,
    {trim("array_to_string(string_split(text, chr(10))[coalesce(skip, 0) + 1:], chr(10))")} AS body
  FROM docs LEFT JOIN h_sum USING (doc_id))"""


def windows(x: str) -> str:
    return (
        f"list_filter(list_transform(range(0, length({x}), 800), lambda o: "
        f"{trim(f'substring({x}, (o + 1)::BIGINT, 1000)')}), lambda w: length(w) >= 100)"
    )


def sentences(x: str) -> str:
    marked = subs(
        x, [("\n+", " "), ("([.!?])\\s+([A-Z0-9\"'(])", "\\1\x01\\2")]
    )
    return (
        f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {trim('s')}), "
        "lambda s: s <> '')"
    )


def paragraphs(x: str) -> str:
    return (
        f"list_filter(list_transform(regexp_split_to_array({x}, '\\n\\s*\\n'), "
        f"lambda s: {trim('s')}), lambda s: s <> '')"
    )


def pack(name: str, pieces: str, sep: str) -> str:
    """``name(k, chunks)`` from ``pieces(k, n, text, split)``, n from 1, one step per piece."""
    first = (
        "list_filter(range(1, len(cur) + 2), lambda j: "
        "coalesce(list_sum(list_transform(cur[j:], lambda c: length(c))), 0) <= 200)[1]"
    )
    room = "200 - coalesce(list_sum(list_transform(cur[f:], lambda c: length(c))), 0)"
    seed = trim(
        f"array_to_string(CASE WHEN f > 1 AND room > 0 THEN "
        f"list_prepend(right(cur[f - 1], room::BIGINT), cur[f:]) ELSE cur[f:] END, {q(sep)})"
    )
    flush = f"CASE WHEN len(cur) > 0 THEN [array_to_string(cur, {q(sep)})] ELSE [] END"
    over = "(size + length(p.text) > 1000 AND len(cur) > 0)"
    return f"""
{name}_s AS (
  SELECT DISTINCT k, 0 AS n, []::VARCHAR[] AS out, []::VARCHAR[] AS cur, 0::BIGINT AS size FROM {pieces}
  UNION ALL
  SELECT k, n + 1,
    CASE WHEN split IS NOT NULL THEN list_concat({flush}, split) WHEN over THEN {flush} ELSE [] END,
    CASE WHEN split IS NOT NULL THEN [] WHEN over AND seed = '' THEN [ptext]
         WHEN over THEN [seed, ptext] ELSE list_append(cur, ptext) END,
    CASE WHEN split IS NOT NULL THEN 0 WHEN over THEN length(seed) + length(ptext)
         ELSE size + length(ptext) END
  FROM (SELECT *, {seed} AS seed FROM (SELECT *, {room} AS room FROM (
    SELECT s.k, s.n, s.cur, s.size, p.text AS ptext, p.split, {over} AS over, {first} AS f
    FROM {name}_s s JOIN {pieces} p ON s.k = p.k AND p.n = s.n + 1)))),
{name} AS (SELECT k, flatten(list(out ORDER BY n)) AS mid, arg_max(cur, n) AS cur
  FROM {name}_s GROUP BY k)"""


def chunk_ctes() -> str:
    def pieces(source: str, items: str, key: str, split: str) -> str:
        return (
            f"SELECT {key} AS k, n, text, CASE WHEN length(text) > 1000 THEN {split} END AS split "
            f"FROM (SELECT {key}, unnest({items}) AS text, "
            f"unnest(range(1, len({items}) + 1)) AS n FROM {source})"
        )

    return f"""{HEADS},
paras AS (SELECT doc_id, {paragraphs('body')} AS ps FROM heads),
para AS (SELECT doc_id, doc_id || ':' || n AS pk, n, text FROM (
  SELECT doc_id, unnest(ps) AS text, unnest(range(1, len(ps) + 1)) AS n FROM paras)),
long AS (SELECT pk, text, {sentences('text')} AS ss FROM para WHERE length(text) > 1000),
sent AS ({pieces('(SELECT * FROM long WHERE len(ss) > 1)', 'ss', 'pk', windows('text'))}),
{pack('sp', 'sent', ' ')},
sp_out AS (SELECT k AS pk, flatten(list_transform(
    list_concat(mid, CASE WHEN len(cur) > 0 THEN [array_to_string(cur, ' ')] ELSE [] END),
    lambda c: CASE WHEN length(c) > 2000 THEN {windows('c')} ELSE [c] END)) AS chunks FROM sp),
resplit AS (SELECT long.pk, CASE WHEN len(ss) <= 1 THEN {windows('long.text')} ELSE chunks END AS chunks
  FROM long LEFT JOIN sp_out USING (pk)),
pp_in AS (SELECT doc_id AS k, n, text, chunks AS split FROM para LEFT JOIN resplit USING (pk)),
{pack('pp', 'pp_in', chr(10) * 2)},
split AS (SELECT k AS doc_id, list_filter(
    list_concat(mid, CASE WHEN len(cur) > 0 THEN [array_to_string(cur, chr(10) || chr(10))] ELSE [] END),
    lambda c: length({trim('c')}) >= 100) AS chunks FROM pp),
placed AS (
  SELECT doc_id, 0 AS n, 0::BIGINT AS st, 0::BIGINT AS en, NULL::VARCHAR AS content FROM split
  UNION ALL
  SELECT doc_id, n + 1, pos, pos + length(c), c FROM (
    SELECT p.doc_id, p.n, chunks[p.n + 1] AS c,
      CASE WHEN instr(substring(body, en + 1), chunks[p.n + 1]) > 0
           THEN en + instr(substring(body, en + 1), chunks[p.n + 1]) - 1 ELSE en END AS pos
    FROM placed p JOIN split USING (doc_id) JOIN heads USING (doc_id) WHERE p.n < len(chunks))),
chunks AS (SELECT substr(md5({_DOC_ID} || '_' || (n - 1)), 1, 12) AS id, doc_id, content,
    source AS book_title, doc_id AS page_number, n - 1 AS chunk_index,
    len(chunks) AS total_chunks, st AS start_char, en AS end_char, section, headings
  FROM placed JOIN split USING (doc_id) JOIN heads USING (doc_id) WHERE n > 0)"""


CHUNKS = f"WITH RECURSIVE {TOPPED}, {chunk_ctes()}"
_CHUNK_ROWS = """SELECT id, doc_id, md5(content) AS content_md5, book_title, page_number, chunk_index,
  total_chunks, start_char, end_char, section, array_to_string(headings, '; ') AS headings,
  CASE WHEN len(headings) > 0 THEN array_to_string(headings, '; ') END AS meta_headings FROM chunks"""


def piece_rows(items: str) -> str:
    return (
        f"WITH {TOPPED}, p AS (SELECT doc_id, {items} AS ps FROM docs) "
        "SELECT doc_id, seq, length(t) AS n_chars, md5(t) AS text_md5 FROM ("
        "SELECT doc_id, unnest(ps) AS t, unnest(range(0, len(ps))) AS seq FROM p)"
    )


# --- reports ----------------------------------------------------------------------


def profile(source: str, measures: dict[str, str]) -> str:
    parts = []
    for name, expr in measures.items():
        ranks = ", ".join(
            f"s[(least(floor(n * {p}::DOUBLE), n - 1) + 1)::BIGINT] AS {label}"
            for label, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9), ("p99", 0.99))
        )
        parts.append(
            f"SELECT '{name}' AS measure, n, s[1] AS min, {ranks}, s[n] AS max, "
            f"round(list_avg(s), 6) AS mean FROM (SELECT list(v ORDER BY v) AS s, count(*) AS n "
            f"FROM (SELECT {expr} AS v FROM {source}))"
        )
    return " UNION ALL ".join(parts)


# Published patterns and tables, which results depend on.
MOJIBAKE = [
    (r"Ō[\wąćęłńóśźż]+", r"Ō[\p{L}\p{N}_]+"),
    (r"Ž[\w]+", r"Ž[\p{L}\p{N}_]+"),
    (r"╬[\w]*", r"╬[\p{L}\p{N}_]*"),
    (r"â€[\w]*", r"â€[\p{L}\p{N}_]*"),
    (r"Ã[\w]", r"Ã[\p{L}\p{N}_]"),
    (r"Â[\w]", r"Â[\p{L}\p{N}_]"),
    (r"√[\w]", r"√[\p{L}\p{N}_]"),
]
_MOJI_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, source, {q(name)} AS pattern, regexp_extract_all(text, {q(p)}) AS hits FROM docs"
    for name, p in MOJIBAKE
)
MOJI = f"""{NOISY}, moji AS (SELECT doc_id, source, pattern, len(hits) AS n,
  list_sum(list_transform(hits, lambda h: length(h))) AS chars FROM ({_MOJI_ROWS}) WHERE len(hits) > 0)"""

_HEADING_START = r"^\s*\d+(?:\.\d+)*\.?\s+[A-Z]"
_CHAPTER_START = r"^\s*(?:CHAPTER|Chapter)\s+\d+"
_FIRST = "string_split(text, chr(10))[1]"
_KINDS = {
    "heading": (f"regexp_matches(text, {q(_HEADING_START)})", f"substring({_FIRST}, 1, 80)"),
    "chapter": (f"regexp_matches(text, {q(_CHAPTER_START)})", f"substring({_FIRST}, 1, 80)"),
    "allcaps": (
        f"regexp_matches({_FIRST}, '^\\s*[A-Z][A-Z\\s\\-]{{5,}}$')",
        f"substring({_FIRST}, 1, 80)",
    ),
    "page_number_leak": (
        r"regexp_matches(substring(text, 1, 120), '^\s*(?:\S+\s+){0,8}?\b\d{2,4}\b\s+\S')",
        "substring(text, 1, 80)",
    ),
}
_SAMPLES = " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, row_number() OVER (ORDER BY doc_id) AS position, {sample} AS sample "
    f"FROM docs WHERE {cond}"
    for kind, (cond, sample) in _KINDS.items()
)
# Published patterns and tables, which results depend on.
_CAPTIONS = {
    "figure": r"(?i)\b(Figure|Fig\.)\s*\d+",
    "table": r"(?i)\bTable\s*\d+",
    "algorithm": r"(?i)\b(Algorithm|Alg\.)\s*\d+",
    "equation": r"(?i)\b(Equation|Eq\.)\s*\d+",
}
_MATH = (
    r"[\x{2200}-\x{22FF}\x{2A00}-\x{2AFF}\x{27C0}-\x{27EF}\x{2980}-\x{29FF}]"
    "|[∑∫∏√∂∇∞∈∉⊂⊃∩∪∧∨∀∃¬]|[=≠≤≥±×÷]"
)
_REPEATS = " OR ".join(f"regexp_matches(text, '{c}{{3,}}')" for c in string.ascii_letters)
_UPPER_START = f"regexp_matches(ltrim(content, {q(BLANKS)}), '^[\\p{{Lu}}\\p{{Nd}}\"''(\\[]')"
_CLEAN_END = f"regexp_matches(rtrim(content, {q(BLANKS)}), '[.?!:;\"'']$')"

# --- search -----------------------------------------------------------------------

_DOT = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_VECTOR_HITS = f"""pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS row, {_DOT} AS score,
    a.label AS q_label, b.label AS h_label FROM embeddings a, embeddings b)"""
_KNN = f"""WITH {_VECTOR_HITS} SELECT query_id, rank, row, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row) AS rank FROM pairs)
WHERE rank <= {K}"""


def hashed(name: str, table: str, key: str) -> str:
    """``name(id, bucket, v)`` and ``name_n(id, norm)``: signed token hashing."""
    return f"""
{name}_t AS (SELECT {key} AS id, md5(unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) AS h FROM {table}),
{name} AS (SELECT id, ('0x' || substr(h, 1, 8))::BIGINT % {DIM} AS bucket,
    sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END) AS v FROM {name}_t GROUP BY ALL),
{name}_n AS (SELECT id, sqrt(sum(v * v)::DOUBLE) AS norm FROM {name} GROUP BY id)"""


_BENCH_HITS = f"""{hashed('dv', 'documents', 'doc_id')}, {hashed('qv', 'benchmark', 'item_id')},
dots AS (SELECT q.id AS query_id, d.id AS row, sum(q.v * d.v)::DOUBLE AS dot FROM qv q JOIN dv d USING (bucket) GROUP BY ALL),
scored AS (SELECT b.item_id AS query_id, d.doc_id AS row,
    coalesce(dot / (CASE WHEN qn.norm = 0 THEN 1 ELSE qn.norm END) / (CASE WHEN dn.norm = 0 THEN 1 ELSE dn.norm END), 0) AS score
  FROM benchmark b CROSS JOIN documents d LEFT JOIN dots ON dots.query_id = b.item_id AND dots.row = d.doc_id
  LEFT JOIN qv_n qn ON qn.id = b.item_id LEFT JOIN dv_n dn ON dn.id = d.doc_id),
hits AS (SELECT query_id, rank, row, score, source AS book, text AS content FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, row) AS rank FROM scored)
  JOIN documents ON doc_id = row WHERE rank <= {K})"""
# The same over chunks, numbered in the order of the corpus.
_CHUNK_HITS = f"""{PLAIN}, {chunk_ctes()},
cd AS (SELECT row_number() OVER (ORDER BY doc_id, chunk_index) - 1 AS row, id AS chunk_id, doc_id, book_title,
    content, content AS text FROM chunks),
{hashed('dv', 'cd', 'row')}, {hashed('qv', 'benchmark', 'item_id')},
dots AS (SELECT q.id AS query_id, d.id AS row, sum(q.v * d.v)::DOUBLE AS dot FROM qv q JOIN dv d USING (bucket) GROUP BY ALL),
scored AS (SELECT b.item_id AS query_id, d.row,
    coalesce(dot / (CASE WHEN qn.norm = 0 THEN 1 ELSE qn.norm END) / (CASE WHEN dn.norm = 0 THEN 1 ELSE dn.norm END), 0) AS score
  FROM benchmark b CROSS JOIN cd d LEFT JOIN dots ON dots.query_id = b.item_id AND dots.row = d.row
  LEFT JOIN qv_n qn ON qn.id = b.item_id LEFT JOIN dv_n dn ON dn.id = d.row),
hits AS (SELECT query_id, rank, row, score, chunk_id, book_title AS book, doc_id AS page, content FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score::FLOAT, 6) DESC, row) AS rank FROM scored)
  JOIN cd USING (row) WHERE rank <= {K})"""
_GOLDEN = """golden AS (SELECT item_id AS query_id, 'q' || item_id AS id, 'book ' || item_id % 4 AS book,
  text AS query, ['easy', 'medium', 'hard'][item_id % 3 + 1] AS difficulty,
  text AS expected_answer_summary, '' AS notes FROM benchmark)"""
_A, _B, _C, _D = (q(p) for p in fv.JUDGE_PROMPT_PARTS)
_JUDGE_PROMPTS = f"""prompts AS (SELECT query_id, rank, row, score, h.book AS hit_book, g.book, difficulty, query,
    {_A} || query || {_B} || expected_answer_summary || {_C} || substring(content, 1, 2000) || {_D} AS prompt,
    contains(substring(content, 1, 2000), query) AS relevant
  FROM golden g JOIN hits h USING (query_id))"""


def metrics(source: str, groups: list[tuple[str, str]]) -> str:
    parts = [
        f"SELECT '{label}' AS slice, {name} AS name, count(*) AS n, {K} AS k, "
        "round(count(*) FILTER (rank = 1) / count(*), 6) AS recall_at_1, "
        "round(count(*) FILTER (rank IS NOT NULL) / count(*), 6) AS recall_at_k, "
        "round(coalesce(sum(1.0::DOUBLE / rank), 0) / count(*), 6) AS mrr, "
        "round(sum(n_relevant) / sum(n_judged), 6) AS precision_at_k "
        f"FROM {source} GROUP BY {name}"
        for label, name in groups
    ]
    return " UNION ALL ".join(parts)


_SLICES = [("overall", "''"), ("book", "book"), ("difficulty", "difficulty")]
_LABEL_RESULTS = f"""WITH {_VECTOR_HITS},
others AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row) AS rank
  FROM pairs WHERE row <> query_id),
top AS (SELECT * FROM others WHERE rank <= {K}),
res AS (SELECT query_id, 'label ' || any_value(q_label) AS book,
    ['easy', 'medium', 'hard'][query_id % 3 + 1] AS difficulty,
    'vector ' || query_id AS query,
    min(rank) FILTER (q_label = h_label) AS rank,
    coalesce(arg_min(score, rank) FILTER (q_label = h_label), 0) AS best_score,
    count(*) FILTER (q_label = h_label) AS n_relevant, count(*) AS n_judged,
    string_agg((q_label = h_label)::INT::VARCHAR, '' ORDER BY rank) AS judgments,
    string_agg(row::VARCHAR, ',' ORDER BY rank) AS retrieved_pages,
    'label ' || arg_min(h_label, rank) AS top_book, arg_min(row, rank)::VARCHAR AS top_page
  FROM top GROUP BY query_id)"""

# --- generation -------------------------------------------------------------------

_UA, _UB, _UC = (q(p) for p in fv.USER_PROMPT_PARTS)
_PROMPTS = f"""WITH RECURSIVE {_CHUNK_HITS}, {_GOLDEN},
ctx AS (SELECT query_id, string_agg('[' || rank || '] ' || book || ', page ' || page || chr(10) || {trim('content')},
      chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context,
    string_agg('[' || rank || '] ' || book || ', page ' || page, '; ' ORDER BY rank) AS cites,
    count(*) AS n_chunks FROM hits GROUP BY query_id),
p AS (SELECT query_id, query, context, cites, n_chunks, {_UA} || context || {_UB} || query || {_UC} AS prompt
  FROM golden JOIN ctx USING (query_id))"""

_STATUS = "[429, 500, 502, 503, 504, 404, 401, 403, 400, 408, 409, 200]"
_ERRORS = f"""WITH log AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'other' ELSE 'gemini' END AS provider,
    event_type || ' failed ' || CASE WHEN event_id % 2 = 0 THEN {_STATUS}[event_id % 12 + 1]::VARCHAR ELSE '' END
      || CASE WHEN event_id % 3 = 0 THEN ' quota PerDay' WHEN event_id % 5 = 0 THEN ' limit Per Day' ELSE '' END AS message,
    CASE WHEN event_id % 4 = 1 THEN {_STATUS}[event_id % 12 + 1] END AS status,
    (event_id % 6 + 1)::INT AS attempt FROM events),
coded AS (SELECT *, CASE WHEN provider = 'gemini' THEN coalesce(status,
    [c FOR c IN [429, 500, 502, 503, 504, 404, 401, 403, 400] IF contains(message, c::VARCHAR)][1]) END AS code FROM log),
e AS (SELECT *, coalesce(code = 429 AND (contains(message, 'PerDay') OR contains(lower(message), 'per day')), false) AS daily
  FROM coded)"""

ORACLE: dict[str, str] = {
    "clean_missing_spaces": digest(NOISY, spaces("text")),
    "clean_encoding": digest(NOISY, encoding("text")),
    "clean_math_symbols": digest(NOISY, math_symbols("text")),
    "clean_artifacts": digest(NOISY, artifacts("text")),
    "clean_abbreviations": digest(NOISY, abbreviations("text")),
    "clean_whitespace": digest(NOISY, whitespace("text")),
    "clean_text_full": digest(NOISY, clean("text")),
    "clean_text_expression": digest(NOISY, clean("text")),
    "protect_math": f"""WITH {NOISY}, {protected()}
SELECT doc_id, n AS n_blocks, md5(array_to_string(list_transform(range(1, n + 1),
  lambda i: marks[i] || '|' || blocks[i]), chr(10))) AS blocks_md5, md5(text) AS text_md5 FROM p4""",
    "restore_math": digest(NOISY, "text"),
    "extract_equations": f"""WITH {NOISY}, {equations()}
SELECT doc_id, seq, content, type, st::INT AS start_char, en::INT AS end_char,
  md5(substring(text, (greatest(st - 100, 0) + 1)::BIGINT,
    (least(length(text), en + 100) - greatest(st - 100, 0))::BIGINT)) AS context_md5
FROM eq JOIN docs USING (doc_id)""",
    "clean_for_chunking": _CLEAN_FOR_CHUNKING,
    "clean_text_fixed": digest(NOISY, fixed_after_decoding(decoded("text"))),
    "clean_for_chunking_fixed": _CLEAN_FOR_CHUNKING_FIXED,
    "section_boundaries": _BOUNDARIES,
    "chunking_stats": _STATS,
    "identifiers": _IDENTIFIERS,
    "word_counts": f"SELECT doc_id, {n_words('text')} AS words FROM documents",
    "strip_headings": f"""WITH {TOPPED}, {HEADS} SELECT doc_id, md5(body) AS body_md5,
  array_to_string(headings, '; ') AS headings, section FROM heads""",
    "split_paragraphs": piece_rows(paragraphs("text")),
    "split_sentences": piece_rows(sentences("text")),
    "char_windows": piece_rows(windows("text")),
    "chunk_documents": f"{CHUNKS} {_CHUNK_ROWS}",
    "chunk_plain_documents": f"WITH RECURSIVE {PLAIN}, {chunk_ctes()} {_CHUNK_ROWS}",
    "chunks_flattened": f"""{CHUNKS} SELECT id, array_to_string(headings, '; ') AS headings,
  length(content) AS content_length, book_title AS metadata_book_file,
  CASE WHEN len(headings) > 0 THEN array_to_string(headings, '; ') END AS metadata_headings,
  CASE WHEN section <> '' THEN section END AS metadata_section FROM chunks""",
    "corpus_totals": f"""SELECT count(*) AS total_pages, sum({n_words('text')}) AS total_words,
  0 AS total_images, sum({n_words('text')}) // count(*) AS avg_words_per_page FROM documents""",
    "per_book_totals": f"""SELECT source AS book_title, count(*) AS pages, sum({n_words('text')}) AS words,
  0 AS images FROM documents GROUP BY source""",
    "chunk_totals": f"""{CHUNKS} SELECT count(*) AS chunks, sum(length(content)) AS total_chars,
  round(avg(length(content)), 6) AS mean_chars FROM chunks""",
    "chunks_per_book": f"{CHUNKS} SELECT book_title, count(*) AS chunks FROM chunks GROUP BY book_title",
    "chunk_size_profile": f"{CHUNKS} "
    + profile("chunks", {"chars": "length(content)", "words": n_words("content")}),
    "chunks_per_page": f"""{CHUNKS} SELECT chunks_on_page, count(*) AS pages FROM (
  SELECT count(*) AS chunks_on_page FROM chunks GROUP BY book_title, page_number) GROUP BY chunks_on_page""",
    "chunk_boundaries": f"""{CHUNKS}, b AS (SELECT NOT {_UPPER_START} AS s, NOT {_CLEAN_END} AS e FROM chunks)
SELECT count(*) AS chunks, count(*) FILTER (s) AS mid_start,
  round(count(*) FILTER (s) / count(*) * 100, 6) AS mid_start_pct, count(*) FILTER (e) AS mid_end,
  round(count(*) FILTER (e) / count(*) * 100, 6) AS mid_end_pct FROM b""",
    "chunk_residue": f"""{CHUNKS} SELECT count(*) FILTER (regexp_matches(content, {q(_HEADING_START)})) AS heading_hits,
  count(*) FILTER (regexp_matches(content, {q(_CHAPTER_START)})) AS chapter_hits,
  count(*) FILTER (regexp_matches(substring(content, 1, 150), '(?:^|\\n)\\s*\\d{{1,4}}\\s*(?:\\n|$)')) AS page_number_hits
FROM chunks""",
    "chunk_adjacency": f"""{CHUNKS}, n AS (SELECT start_char, lag(end_char) OVER (
  PARTITION BY book_title, page_number ORDER BY chunk_index) AS prev FROM chunks)
SELECT count(*) FILTER (start_char < prev) AS overlap_pairs, count(*) FILTER (start_char > prev) AS gap_pairs FROM n""",
    "chunk_duplicates": f"""{CHUNKS} SELECT md5(content) AS content_md5, count(*) AS copies FROM chunks
GROUP BY 1 HAVING count(*) > 1""",
    "chunk_samples": f"""{CHUNKS} SELECT book_title, page_number, chunk_index + 1 AS chunk_no, total_chunks,
  length(content) AS chars, replace(substring(content, 1, 150), chr(10), ' ') AS preview
FROM chunks ORDER BY doc_id, chunk_index LIMIT 5""",
    "extraction_overall": f"""WITH {NOISY} SELECT count(*) AS n_documents, sum(length(text)) AS total_chars,
  sum({n_words('text')}) AS total_words, round(sum(length(text)) / count(*), 6) AS avg_chars_per_chunk,
  round(sum({n_words('text')}) / count(*), 6) AS avg_words_per_chunk FROM docs""",
    "mojibake_totals": f"""WITH {MOJI} SELECT count(DISTINCT doc_id) AS chunks_with_mojibake,
  round(count(DISTINCT doc_id) / (SELECT count(*) FROM docs) * 100, 6) AS chunks_with_mojibake_pct,
  sum(chars) AS total_mojibake_chars FROM moji""",
    "mojibake_patterns": f"""WITH {MOJI} SELECT pattern, sum(n) AS matches,
  array_to_string(list(doc_id ORDER BY doc_id)[1:5], ',') AS example_pages FROM moji GROUP BY pattern""",
    "size_profile": f"WITH {NOISY} "
    + profile("docs", {"chars": "length(text)", "words": n_words("text")}),
    "page_counts": """SELECT count(*) AS unique_pages, count(*) FILTER (c = 1) AS pages_with_one_chunk,
  count(*) FILTER (c > 1) AS pages_with_multiple_chunks, max(c) AS max_chunks_per_page
FROM (SELECT count(*) AS c FROM documents GROUP BY source, doc_id)""",
    "heading_counts": f"""WITH {TOPPED} SELECT
  count(*) FILTER ({_KINDS['heading'][0]}) AS chunks_starting_with_heading,
  count(*) FILTER ({_KINDS['chapter'][0]}) AS chunks_starting_with_chapter,
  count(*) FILTER ({_KINDS['allcaps'][0]}) AS chunks_starting_with_allcaps,
  count(*) FILTER ({_KINDS['page_number_leak'][0]}) AS chunks_with_leading_page_number,
  count(*) AS total_chunks FROM docs""",
    "heading_samples": f"WITH {TOPPED}, s AS ({_SAMPLES}) SELECT * FROM s WHERE position <= 5",
    "caption_counts": f"WITH {NOISY} SELECT "
    + ", ".join(f"sum({count_matches('text', p)}) AS {name}" for name, p in _CAPTIONS.items())
    + " FROM docs",
    "math_content": f"""WITH {NOISY}, m AS (SELECT {count_matches('text', _MATH)} AS m, length(text) AS c FROM docs)
SELECT count(*) FILTER (m > 0) AS chunks_with_math_symbols,
  round(count(*) FILTER (m > 0) / count(*) * 100, 6) AS chunks_with_math_symbols_pct,
  count(*) FILTER (m / c > 0.03) AS chunks_with_high_math_density, sum(m) AS total_math_symbols FROM m""",
    "text_hygiene": f"""WITH {NOISY} SELECT count(*) FILTER ({_REPEATS}) AS chunks_with_repeated_chars,
  count(*) FILTER (regexp_matches(text, '[a-z][A-Z]|[a-z]\\d{{2,}}')) AS chunks_with_missing_spaces,
  count(*) FILTER (regexp_matches(text, '[ \\t]+\\n')) AS chunks_with_trailing_whitespace,
  count(*) AS chunks_total FROM docs""",
    "empty_pages": f"""WITH {NOISY} SELECT doc_id AS doc_seq, source AS book, doc_id AS page, length(text) AS chars,
  0 AS n_images FROM docs WHERE length(text) < 100""",
    "per_book_quality": f"""WITH {MOJI} SELECT source AS book, count(*) AS chunks,
  round(avg(length(text)), 6) AS chars_mean, max(length(text)) AS chars_max,
  count(*) FILTER (bad) AS chunks_with_mojibake,
  round(count(*) FILTER (bad) / count(*) * 100, 6) AS chunks_with_mojibake_pct
FROM (SELECT source, text, doc_id IN (SELECT doc_id FROM moji) AS bad FROM docs) GROUP BY source""",
    "worst_chunks": f"""WITH {MOJI} SELECT doc_id AS doc_seq, docs.source AS book, doc_id AS page,
  sum(n) AS mojibake_count, length(text) AS chars,
  replace(substring(text, 1, 120), chr(10), ' ') AS preview
FROM moji JOIN docs USING (doc_id) GROUP BY doc_id, docs.source, text ORDER BY sum(n) DESC, doc_id LIMIT 20""",
    "ingest_pages": f"""WITH p AS (SELECT regexp_extract(url, '//([^/]+)/', 1) AS file, url, page_id, {clean('html')} AS text FROM pages),
b AS (SELECT file, min(page_id) AS o FROM p WHERE contains(url, '/en/') GROUP BY file)
SELECT substr(md5(p.file || '_' || page_id), 1, 12) AS id, page_id + 1 AS page_number,
  CASE WHEN o IS NULL THEN replace(p.file, '.pdf', '') ELSE 'Book ' || o END AS book_title,
  md5(text) AS content_md5, CASE WHEN o IS NULL THEN 'Unknown' ELSE 'A. Writer' END AS author,
  CASE WHEN o IS NULL THEN 'unknown' ELSE 'intro' END AS level, (page_id + 1)::VARCHAR AS page,
  'false' AS has_images FROM p LEFT JOIN b ON p.file = b.file WHERE {trim('text')} <> ''""",
    "first_documents": """SELECT doc_id AS doc_seq, source AS book_title, md5(text) AS content_md5
FROM documents ORDER BY doc_id LIMIT 10""",
    "documents_json": f"""SELECT {_DOC_ID} AS id, source AS book_title, doc_id AS page_number,
  md5(text) AS content_md5, source AS book_file, 0 AS n_images FROM documents""",
    "documents_json_array": f"""SELECT {_DOC_ID} AS id, source AS book_title, doc_id AS page_number,
  md5(text) AS content_md5, source AS book_file, 0 AS n_images FROM documents""",
    "line_numbers": """SELECT row_number() OVER (ORDER BY doc_id) AS number,
  CASE WHEN doc_id % 3 <> 0 THEN doc_id END AS doc_id, CASE WHEN doc_id % 3 <> 0 THEN md5(text) END AS text_md5
FROM documents""",
    "book_metadata": """WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source HAVING count(*) % 5 > 0)
SELECT doc_id, CASE WHEN n IS NULL THEN replace(d.source, '.pdf', '') ELSE 'Title ' || d.source || ' 1' END AS title,
  CASE WHEN n IS NULL THEN 'Unknown' END AS author,
  CASE WHEN n IS NULL THEN 'Unknown' ELSE (n + 1)::VARCHAR END AS year
FROM documents d LEFT JOIN s USING (source)""",
    "cache_generations": """SELECT 'v' || vec_id AS cache_key, len(embedding) AS dimension
FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0""",
    "blank_queries": "SELECT item_id AS query_id, CASE WHEN item_id % 3 <> 0 THEN 1 END AS rank FROM benchmark",
    "more_than_there_are": """SELECT vec_id AS query_id, (SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0) AS hits,
  (SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0) AS last FROM embeddings""",
    "chunks_jsonl": f"{CHUNKS} {_CHUNK_ROWS}",
    "golden_jsonl": f"""WITH {_GOLDEN} SELECT id, book, query, difficulty, expected_answer_summary, notes FROM golden""",
    "embeddings_parquet": """SELECT vec_id::VARCHAR AS chunk_id, 'label ' || label AS book_title,
  vec_id AS page_number, 0 AS chunk_index, len(embedding) AS embedding_dim FROM embeddings""",
    "stream_chunks": f"{CHUNKS} {_CHUNK_ROWS}",
    "encode_documents": f"""WITH {hashed('dv', 'documents', 'doc_id')}
SELECT id AS doc_id, bucket, v AS value FROM dv WHERE v <> 0""",
    "cached_embedding": f"""WITH {hashed('dv', 'documents', 'doc_id')},
m AS (SELECT id, sum(abs(v)) AS mass FROM dv GROUP BY id)
SELECT doc_id, doc_id NOT IN (SELECT doc_id FROM labels) AS computed, coalesce(mass, 0)::INT AS mass
FROM documents LEFT JOIN m ON id = doc_id""",
    "cache_stats": f"""SELECT count(*) AS total_embeddings,
  round(count(*) * (32 + 8 * {DIM}) / 1048576, 6) AS cache_size_mb, {DIM} AS model_dimension FROM documents""",
    "l2_normalize": """WITH v AS (SELECT vec_id AS row, embedding::DOUBLE[] AS e,
  sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)
SELECT row, round(n, 6) AS norm, unnest(range(0, len(e))) AS pos,
  unnest(list_transform(e, lambda x: round(x / n, 6))) AS x FROM v""",
    "number_rows": """SELECT source, doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS row FROM documents""",
    "index_stats": """SELECT true AS built, count(*) AS ntotal, max(len(embedding)) AS dimension,
  count(*) AS metadata_rows, 'exact inner product' AS index_type FROM embeddings""",
    "indexed_search": f"""WITH {_VECTOR_HITS}, top AS (SELECT query_id, row, row_number() OVER (
  PARTITION BY query_id ORDER BY score DESC, row) AS rank FROM pairs)
SELECT count(*) AS queries, count(*) FILTER (query_id = row) AS found_self FROM top WHERE rank = 1""",
    "knn_all_top5": _KNN,
    "knn_blocks_top5": _KNN,
    "retrieve_benchmark": f"""WITH {_BENCH_HITS} SELECT query_id, rank, row, round(score, 6) AS score,
  row::VARCHAR AS chunk_id, book, row AS page FROM hits""",
    "retrieve_chunks": f"""WITH RECURSIVE {_CHUNK_HITS} SELECT query_id, rank, row,
  chunk_id, book, page FROM hits""",
    "cached_vectors": """SELECT 'v' || vec_id AS cache_key, len(embedding) AS dimension,
  round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings""",
    "judge_prompts": f"""WITH RECURSIVE {_CHUNK_HITS}, {_GOLDEN}, {_JUDGE_PROMPTS}
SELECT query_id, rank, md5(prompt) AS prompt_md5, substr(sha256(prompt), 1, 24) AS judge_key FROM prompts""",
    "judged_hits": f"""WITH RECURSIVE {_CHUNK_HITS}, {_GOLDEN}, {_JUDGE_PROMPTS}
SELECT query_id, rank, row, relevant FROM prompts""",
    "judged_metrics": f"""WITH RECURSIVE {_CHUNK_HITS}, {_GOLDEN}, {_JUDGE_PROMPTS},
res AS (SELECT query_id, any_value(book) AS book, any_value(difficulty) AS difficulty,
  min(rank) FILTER (relevant) AS rank, count(*) FILTER (relevant) AS n_relevant, count(*) AS n_judged
  FROM prompts GROUP BY query_id) {metrics('res', _SLICES)}""",
    "query_results": f"""{_LABEL_RESULTS} SELECT query_id, 'v' || query_id AS id, book, difficulty, rank IS NOT NULL AS hit, rank,
  round(best_score, 6) AS best_score, judgments, retrieved_pages FROM res""",
    "eval_overall": f"""{_LABEL_RESULTS} SELECT * EXCLUDE (slice, name) FROM ({metrics('res', _SLICES[:1])})""",
    "eval_breakdown": f"{_LABEL_RESULTS} {metrics('res', _SLICES)}",
    "eval_failures": f"""{_LABEL_RESULTS} SELECT query_id, 'v' || query_id AS id, difficulty, top_book, top_page FROM res WHERE rank IS NULL""",
    "eval_record": f"""{_LABEL_RESULTS}
SELECT 'config' AS section, name, value, NULL::BIGINT AS n, NULL::DOUBLE AS recall_at_1, NULL::DOUBLE AS recall_at_k,
  NULL::DOUBLE AS mrr, NULL::DOUBLE AS precision_at_k, NULL::BOOLEAN AS hit, NULL::INT AS rank,
  NULL::DOUBLE AS best_score, NULL::INT AS n_retrieved
FROM (VALUES ('k', '{K}'), ('index', 'exact')) AS c(name, value)
UNION ALL SELECT slice, name, NULL, n, recall_at_1, recall_at_k, mrr, precision_at_k, NULL, NULL, NULL, NULL
FROM ({metrics('res', _SLICES)})
UNION ALL SELECT 'query', 'v' || query_id, NULL, NULL, NULL, NULL, NULL, NULL, rank IS NOT NULL, rank,
  round(best_score, 6), n_judged::INT FROM res""",
    "eval_per_entry": f"""{_LABEL_RESULTS} SELECT query_id, 'v' || query_id AS id, difficulty,
  CASE WHEN rank IS NULL THEN 'no' ELSE 'yes' END AS hit, coalesce(rank::VARCHAR, '-') AS rank,
  CASE WHEN rank IS NULL THEN '-' ELSE printf('%.3f', best_score) END AS score,
  substring(query, 1, 60) AS query FROM res""",
    "context_blocks": f"{_PROMPTS} SELECT query_id, md5(context) AS context_md5, md5(prompt) AS prompt_md5 FROM p",
    "answers": f"""{_PROMPTS} SELECT query_id, CASE WHEN length(query) > 300
    THEN '[generation failed: [gemini status=400] 400 prompt too long]' ELSE length(prompt) || ' characters' END AS answer,
  CASE WHEN length(query) > 300 THEN '' ELSE cites END AS citations, n_chunks FROM p""",
    "classify_errors": f"""{_ERRORS} SELECT event_id, code AS status_code,
  coalesce(code IN (408, 409, 429, 500, 502, 503, 504), false) AND NOT daily AS retryable,
  daily AS daily_quota, coalesce(code BETWEEN 500 AND 599, false) AS server_error FROM e""",
    "retry_schedule": f"""{_ERRORS} SELECT event_id, attempt,
  least(CASE WHEN code = 429 THEN 20.0 * attempt ELSE 2.0 * pow(2, attempt - 1) END, 120)::DOUBLE AS delay FROM e""",
    "chat_history": "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations",
}

# DuckDB sums integers into a wider type than Spark; hand out the same one.
_WIDE_SUMS = {
    "corpus_totals": ["total_words", "avg_words_per_page"],
    "per_book_totals": ["words"],
    "chunk_totals": ["total_chars"],
    "extraction_overall": ["total_chars", "total_words"],
    "mojibake_totals": ["total_mojibake_chars"],
    "mojibake_patterns": ["matches"],
    "caption_counts": ["figure", "table", "algorithm", "equation"],
    "math_content": ["total_math_symbols"],
    "worst_chunks": ["mojibake_count"],
    "encode_documents": ["value"],
}
for _name, _columns in _WIDE_SUMS.items():
    _casts = ", ".join(f'"{c}"::BIGINT AS "{c}"' for c in _columns)
    ORACLE[_name] = f"SELECT * REPLACE ({_casts}) FROM ({ORACLE[_name]})"
