"""The queries of this subpackage in SQL, for DuckDB, where SQL can express them."""

import re

from folioforge.llm.license_scan import PHRASES, TEMPLATES
from folioforge.llm.license_scan import WORD as LICENSE_WORD
from folioforge.llm.quality_rules import STOP_WORDS
from folioforge.llm.url_reputation import TWO_LABEL_SUFFIXES

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _strings(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _shrunk(counts: str, weight: str) -> str:
    return f"""SELECT c.*, (c.prior * s + k) / (n + s) AS mean
        FROM {counts} c, {weight}"""


def _weight(counts: str) -> str:
    """See ``url_reputation``: the correlation of outcomes within one parent, as a weight."""
    return f"""SELECT 1 / least(greatest(CASE WHEN p > 0 THEN e / p ELSE 0.5 END, 0.001), 0.5) - 1 AS s
        FROM (SELECT coalesce(sum((k - n * prior) ** 2 - n * prior * (1 - prior)), 0) AS e,
                     coalesce(sum(n * prior * (1 - prior) * (n - 1)), 0) AS p FROM {counts})"""


_RULE_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"

OP1 = f"""
WITH split AS (
    SELECT page_id,
           CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest
    FROM pages),
parts AS (
    SELECT page_id,
           {_LOWER.format("coalesce(regexp_extract(rest, '^[^/?#]*'), '')")} AS host,
           coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
    FROM split),
bad AS (
    SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
    FROM labels GROUP BY doc_id),
numbered AS (
    SELECT *, regexp_extract(path, '/([0-9]{{1,18}})(\\.html)?/?$', 1) AS number FROM parts),
hosts0 AS (
    SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k
    FROM numbered LEFT JOIN bad ON number <> '' AND doc_id = try_cast(number AS BIGINT)
    GROUP BY host),
bare AS (
    SELECT *, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS l FROM hosts0),
hosts1 AS (
    SELECT host, n, k,
           regexp_extract(array_to_string(l, '.'), '^[0-9]+([.][0-9]+){{3}}$') AS address,
           array_to_string(l[-2:], '.') AS two, array_to_string(l[-3:], '.') AS three, l[-1] AS one
    FROM bare),
hosts2 AS (
    SELECT host, n, k,
           CASE WHEN address <> '' THEN address WHEN two IN ({_strings(TWO_LABEL_SUFFIXES)}) THEN two ELSE one END AS suffix,
           CASE WHEN address <> '' THEN address WHEN two IN ({_strings(TWO_LABEL_SUFFIXES)}) THEN three ELSE two END AS domain
    FROM hosts1),
overall AS (SELECT (sum(k) + 1) / (sum(n) + 2) AS prior FROM hosts2),
suffixes AS (
    SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(prior) AS prior
    FROM hosts2, overall GROUP BY suffix),
suffixes1 AS ({_shrunk("suffixes", f"({_weight('suffixes')})")}),
domains AS (
    SELECT h.suffix, h.domain, sum(h.n) AS n, sum(h.k) AS k, any_value(s.mean) AS prior
    FROM hosts2 h JOIN suffixes1 s ON h.suffix = s.suffix GROUP BY h.suffix, h.domain),
domains1 AS ({_shrunk("domains", f"({_weight('domains')})")}),
hosts3 AS (
    SELECT h.host, h.n, h.k, d.mean AS prior
    FROM hosts2 h JOIN domains1 d ON h.suffix = d.suffix AND h.domain = d.domain),
hosts4 AS (
    SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (n + s + 1)) AS bound
    FROM (SELECT c.*, s, (prior * s + k) / (n + s) AS mean
          FROM hosts3 c, ({_weight("hosts3")})))
SELECT page_id, host, path, rule,
       CASE rule WHEN 'net/' THEN 'block' WHEN 'example.net/en/' THEN 'allow'
                 WHEN 'example.com/de/' THEN 'block' WHEN 'org/fr/' THEN 'allow'
                 ELSE CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END END AS verdict
FROM (SELECT page_id, host, path, bound,
             CASE WHEN {_RULE_FITS.format("example.net", "/en/")} THEN 'example.net/en/'
                  WHEN {_RULE_FITS.format("example.com", "/de/")} THEN 'example.com/de/'
                  WHEN {_RULE_FITS.format("org", "/fr/")} THEN 'org/fr/'
                  WHEN {_RULE_FITS.format("net", "/")} THEN 'net/' END AS rule
      FROM parts JOIN hosts4 USING (host))
"""

OP2 = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC) = 1 AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
WINDOW same AS (PARTITION BY t)
"""

OP6 = r"""
WITH RECURSIVE docs AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           substr(md5(doc_id::VARCHAR), 1, 2) AS tie
    FROM documents),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS w
    FROM docs GROUP BY source),
total AS (SELECT sum(source_size)::DOUBLE AS t, sum(w)::DOUBLE AS all_w FROM sources),
-- Capped sizes and the weights of the rest, round by round.
fill(i, capped, left_w) AS (
    SELECT 0, 0.0::DOUBLE, all_w FROM total
    UNION ALL
    SELECT r.i + 1,
           coalesce(sum(CASE WHEN (t - r.capped) * w > 3 * source_size * r.left_w THEN 3 * source_size END), 0)::DOUBLE,
           coalesce(sum(CASE WHEN (t - r.capped) * w > 3 * source_size * r.left_w THEN 0 ELSE w END), 0)::DOUBLE
    FROM fill r, sources, total WHERE r.i < 40 GROUP BY r.i, r.capped, r.left_w, t),
last AS (SELECT capped, left_w FROM fill ORDER BY i DESC LIMIT 1),
goals AS (
    SELECT source, source_size,
           CASE WHEN (t - capped) * w > 3 * source_size * left_w THEN (3 * source_size)::DOUBLE
                ELSE (t - capped) * w / left_w END AS target,
           ('0x' || substr(md5('mix' || coalesce('=' || source, '')), 1, 5))::BIGINT / 1048576.0 AS u
    FROM sources, total, last),
lined AS (
    SELECT d.doc_id, d.size, g.source_size, g.target, u,
           CASE WHEN g.source_size > 0 THEN target / g.source_size ELSE 0 END AS each,
           row_number() OVER (PARTITION BY d.source ORDER BY size, tie, d.doc_id) - 1 AS place
    FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (floor((place + 1) * each + u) - floor(place * each + u))::BIGINT * size AS taken
FROM lined
"""

OP7 = rf"""
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
    FROM documents),
words AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM docs),
windows AS (
    SELECT doc_id, i, a, lead(a) OVER d AS b, lead(a, 2) OVER d AS c
    FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
counted AS (
    SELECT doc_id, i, c IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, a, b, c) > 1 AS twice
    FROM windows),
covered AS (
    SELECT doc_id, twice OR coalesce(lag(twice) OVER d, false) OR coalesce(lag(twice, 2) OVER d, false) AS hit
    FROM counted WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
repeats AS (SELECT doc_id, count(*) FILTER (hit) AS n_repeat_words FROM covered GROUP BY doc_id),
counts AS (
    SELECT doc_id, len(w) AS n_words,
           length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
           length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
           len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
           len(list_filter(w, lambda x: x IN ({_strings(f for w in STOP_WORDS for f in (w, w[0].upper() + w[1:]))}))) AS n_stop,
           coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM docs LEFT JOIN repeats USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
       AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND n_words BETWEEN 50 AND 1000000
       AND 10 * n_symbols <= n_words AND 50 * n_stop >= n_words
       AND 2 * n_dup_lines <= n_lines AND 2 * n_repeat_words <= n_words AS kept
FROM counts
"""


def _template_rows(k: int = 3) -> str:
    rows = []
    for number, (label, text) in enumerate(TEMPLATES):
        w = re.findall(LICENSE_WORD, text.lower())
        rows += [
            f"({number}, '{label}', '{' '.join(w[i : i + k])}', {i}, {len(w) - k + 1}, {len(w)})"
            for i in range(len(w) - k + 1)
        ]
    return ", ".join(rows)


_BASE_HITS = " UNION ALL ".join(
    f"""SELECT doc_id, i, '{label}' AS label FROM placed
        WHERE {" AND ".join(f"w{j} = '{p}'" for j, p in enumerate(phrase.split()))}"""
    for phrase, label in PHRASES
)

OP9 = rf"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")},
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
words AS (SELECT doc_id, unnest(w) AS w0, generate_subscripts(w, 1) - 1 AS i FROM docs),
placed AS (
    SELECT doc_id, i, w0, lead(w0) OVER d AS w1, lead(w0, 2) OVER d AS w2
    FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
base AS (
    SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
           list_distinct(list(label)) AS own
    FROM ({_BASE_HITS}) GROUP BY doc_id),
runs(template, label, run, place, n_runs, n_words) AS (VALUES {_template_rows()}),
votes AS (
    SELECT doc_id, template, label, n_runs, n_words, i - place AS diagonal,
           min(i) AS first, max(i) AS last, list_distinct(list(place)) AS places
    FROM placed JOIN runs ON w2 IS NOT NULL AND concat(w0, ' ', w1, ' ', w2) = run
    GROUP BY ALL),
marked AS (
    SELECT *, CASE WHEN diagonal - lag(diagonal) OVER d > 3 THEN 1 ELSE 0 END AS new
    FROM votes WINDOW d AS (PARTITION BY doc_id, template ORDER BY diagonal)),
numbered AS (
    SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM marked),
spans AS (
    SELECT doc_id, label, len(list_distinct(flatten(list(places)))) / n_runs::DOUBLE AS coverage,
           max(last) + 2 - min(first) + 1 <= n_words * 1.5 AS short
    FROM numbered GROUP BY doc_id, template, label, n_runs, n_words, span),
voted AS (
    SELECT doc_id, list(label) FILTER (coverage >= 0.8 AND short) AS more, max(coverage) AS score
    FROM spans GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       array_to_string(list_sort(coalesce(own, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ',') AS labels,
       coalesce(score, 0) AS score
FROM docs LEFT JOIN base USING (doc_id) LEFT JOIN voted USING (doc_id)
"""

OP11 = """
WITH q AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
           CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positive AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


def _framed(*fields: str) -> str:
    one = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
    return "sha256(" + " || ".join(one.format(f) for f in fields) + ")"


def _crc32(text: str) -> str:
    """Bit by bit over the bytes of an ASCII text."""
    bits = "list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda crc, byte: {bits}), 4294967295)"


def _tree(name: str, bottom: str) -> str:
    """Nodes ``(g, level, pos, h, n)`` of a tree for each ``g`` over ``bottom``, pairs hashed."""
    return f"""{name} AS (
    SELECT g, 0 AS level, pos, h, n FROM {bottom}
    UNION ALL
    SELECT g, level + 1, pos // 2, sha256(h || coalesce(next, '')), (n + 1) // 2
    FROM (SELECT *, lead(h) OVER (PARTITION BY g ORDER BY pos) AS next FROM {name} WHERE n > 1)
    WHERE pos % 2 = 0)"""


def _climb(name: str, start: str, tree: str) -> str:
    """From the nodes of ``start`` upwards: the siblings so far and both folded hashes."""
    return f"""{name} AS (
    SELECT id, g, 0 AS level, pos, proof, fold FROM {start}
    UNION ALL
    SELECT c.id, c.g, c.level + 1, c.pos // 2, c.proof || coalesce(s.h, ''),
           sha256(CASE WHEN c.pos % 2 = 1 THEN s.h || c.fold ELSE c.fold || coalesce(s.h, '') END)
    FROM {name} c JOIN {tree} own ON own.g = c.g AND own.level = c.level AND own.pos = c.pos AND own.n > 1
    LEFT JOIN {tree} s ON s.g = c.g AND s.level = c.level AND s.pos = xor(c.pos, 1))"""


OP12 = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, coalesce('=' || lang, '') AS g,
           {_framed("doc_id", "source", "lang", "n_chars", "text")} AS leaf,
           {_framed("doc_id", "source", "lang", "n_chars + 1", "text")} AS changed
    FROM documents),
ranked AS (
    SELECT *, row_number() OVER (ORDER BY g, doc_id NULLS FIRST, leaf) AS id,
           row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
           count(*) OVER (PARTITION BY g) AS n
    FROM leaves),
bottom AS (SELECT g, pos, leaf AS h, n FROM ranked),
{_tree("nodes", "bottom")},
subroots AS (
    SELECT '*' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, h, count(*) OVER () AS n, g AS own
    FROM nodes WHERE n = 1),
{_tree("above", "subroots")},
claims AS (
    SELECT id, g, pos, '' AS proof,
           CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN changed ELSE leaf END AS fold
    FROM ranked),
{_climb("climb", "claims", "nodes")},
arrived AS (
    SELECT c.id, s.g, s.pos, c.proof, c.fold
    FROM climb c JOIN nodes t ON t.g = c.g AND t.level = c.level AND t.pos = c.pos AND t.n = 1
    JOIN subroots s ON s.own = c.g),
{_climb("climb2", "arrived", "above")}
SELECT r.doc_id, r.leaf, s.h AS subroot, t.h AS root, sha256(c.proof) AS proof_sha256,
       c.fold AS folded_root, c.fold = t.h AS verified
FROM climb2 c JOIN above t ON t.level = c.level AND t.pos = c.pos AND t.n = 1
JOIN ranked r ON r.id = c.id JOIN subroots s ON s.own = r.g
"""
