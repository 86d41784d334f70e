"""Corrected cleaning: the published rules without the quirks that come from their order.

What differs from ``cleaning``: mis-decoded characters are repaired in one pass, longest key
first, so that no key shadows a longer one; abbreviations expand as whole words, take a dot
of their own with them and stay as they are when met again; line ends are unified before
blank lines collapse, and no line break is lost before punctuation; equations are hidden
behind marks that no rule touches, and come back.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import cleaning
from folioforge.functions import fixed_values as fv
from folioforge.functions.charclass import WS_INLINE, let, strip

#: Repairs that the published tables lack or misspell: the signs as Windows-1252 shows them.
ADDED_FIXES = [("\u00e2\u02c6\u0161", "√"), ("\u00e2\u2030\u00a0", "≠")]
#: A mark is a number between two private-use characters.
OPEN, CLOSE = "\ue000", "\ue001"
MARK = f"{OPEN}([0-9]+){CLOSE}"


def longest_first(table: list[tuple[str, str]]) -> dict[str, str]:
    """The table as a mapping, longer keys first; of equal keys the first counts."""
    first: dict[str, str] = {}
    for key, value in table:
        first.setdefault(key, value)
    return dict(sorted(first.items(), key=lambda kv: -len(kv[0])))


def _replaced(text: Column, pattern: str, values: dict[str, str], key) -> Column:
    """Every match of ``pattern`` by the value of its key; the text is evaluated once."""
    known = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])

    def woven(t: Column) -> Column:
        parts = F.zip_with(
            F.split(t, pattern, -1),
            F.regexp_extract_all(t, F.lit(pattern), F.lit(0)),
            lambda gap, hit: F.concat(gap, F.coalesce(F.element_at(known, key(hit)), F.lit(""))),
        )
        return F.when(t.rlike(pattern), F.array_join(parts, "")).otherwise(t)

    return let(text, woven)


def _any_of(keys: dict[str, str]) -> str:
    """A pattern of any of the keys; most places of a text are left at their first character."""
    first = "".join(sorted({key[0] for key in keys}))
    return f"(?=[{re.escape(first)}])(?:{'|'.join(map(re.escape, keys))})"


def replace_longest(text: Column, table: list[tuple[str, str]]) -> Column:
    """Replace all keys in one pass: at one place the longest key, and no value again."""
    fixes = longest_first(table)
    return _replaced(text, _any_of(fixes), fixes, lambda hit: hit)


DECODING = ADDED_FIXES + fv.ENCODING_FIXES + fv.MATH_SYMBOL_FIXES


def decode(text: Column) -> Column:
    return replace_longest(text, DECODING)


def expand_abbreviations(text: Column) -> Column:
    """Whole words only; a dot that belongs to the abbreviation goes with it."""
    words = longest_first(fv.ABBREVIATIONS)
    pattern = rf"(?<![a-zA-Z0-9])(?:{'|'.join(map(re.escape, words))})(?![a-zA-Z0-9])\.?"
    return _replaced(text, pattern, words, lambda hit: F.regexp_replace(hit, r"\.$", ""))


def normalize_whitespace(text: Column) -> Column:
    c = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    c = F.regexp_replace(c, rf"\n(?:[{WS_INLINE}]*\n){{2,}}", "\n\n")
    c = F.regexp_replace(c, " {2,}", " ")
    c = F.regexp_replace(c, rf"[{WS_INLINE}]+(?=[.,;:!?])", "")
    c = F.regexp_replace(c, "[.,;:!?](?=[a-zA-Z])", "$0 ")
    return strip(F.regexp_replace(c, r"(?<![a-zA-Z])(e\.|i\.) ([ge]\.)", "$1$2"))


def _after_decoding(fix_spaces: bool, normalize_ws: bool) -> list:
    """The rest of the chain as (needles, step), like that of ``cleaning``."""
    steps: list = [((), cleaning.fix_missing_spaces)] if fix_spaces else []
    steps += [*cleaning.artifact_steps(), (tuple(k for k, _ in fv.ABBREVIATIONS), expand_abbreviations)]
    if normalize_ws:
        steps.append(((), normalize_whitespace))
    return steps


def steps(fix_spaces: bool, fix_encoding: bool, fix_math: bool, normalize_ws: bool) -> list:
    """The corrected chain; encodings and math symbols are repaired together, and first."""
    repairs = ADDED_FIXES * fix_math + fv.ENCODING_FIXES * fix_encoding + fv.MATH_SYMBOL_FIXES * fix_math
    needles = tuple(sorted({key[:2] for key, _ in repairs}))
    first = [(needles, lambda c: replace_longest(c, repairs))] if repairs else []
    return first + _after_decoding(fix_spaces, normalize_ws)


def clean_text(text: Column) -> Column:
    """The corrected chain as one expression.  Null becomes ``''``."""
    return reduce(lambda c, step: step[1](c), steps(True, True, True, True), F.coalesce(text, F.lit("")))


def _math_pattern() -> str:
    """Marks that a text already has, and all equations but single symbols; the first fits."""
    kinds = [p for kind, p in fv.EQUATION_PATTERNS if kind != "symbol"]
    scoped = [f"(?s:{p.removeprefix('(?s)')})" if p.startswith("(?s)") else f"(?:{p})" for p in kinds]
    return "|".join([MARK.replace("(", "(?:"), *scoped])


MATH = _math_pattern()


def _marked(decoded: Column) -> Column:
    """Struct ``<text, math>``: equations replaced by their marks, and listed."""

    def marks(gaps: Column) -> Column:
        last = F.size(gaps) - 1
        return F.transform(
            gaps,
            lambda gap, i: F.when(i < last, F.concat(gap, F.lit(OPEN), i.cast("string"), F.lit(CLOSE))).otherwise(gap),
        )

    parts = let(F.split(decoded, MATH, -1), marks)
    return F.struct(
        F.array_join(parts, "").alias("text"), F.regexp_extract_all(decoded, F.lit(MATH), F.lit(0)).alias("math")
    )


def _shown(cleaned: Column, math: Column) -> Column:
    """The equations back in place of their marks."""
    parts = F.zip_with(
        F.split(cleaned, MARK, -1),
        F.regexp_extract_all(cleaned, F.lit(MARK), F.lit(1)),
        lambda gap, i: F.concat(gap, F.coalesce(F.get(math, i.cast("int")), F.lit(""))),
    )
    return F.array_join(parts, "")


def clean_for_chunking(text: Column, preserve_math: bool = True) -> Column:
    """Clean around equations, which come back as they were (but for their encoding).

    An equation is the leftmost match of any pattern, at one place of the first pattern.
    The text is split at equations once and at marks once.
    """

    def shown(state: Column) -> Column:
        cleaned = reduce(lambda c, step: step[1](c), _after_decoding(True, True), state["text"])
        return let(cleaned, lambda c: _shown(c, state["math"]))

    text = F.coalesce(text, F.lit(""))
    return let(let(decode(text), _marked), shown) if preserve_math else clean_text(text)


def clean_column_for_chunking(df: DataFrame, column: str) -> DataFrame:
    """The same for a whole corpus: each step is a projection of its own, guarded as in
    ``cleaning.clean_column``."""
    math, c = f"{column}_math_of_text", F.col(column)
    out = cleaning.guarded(df.withColumn(column, F.coalesce(c, F.lit(""))), column, [_decoding()])
    out = out.withColumn(math, _marked(c)).withColumn(column, F.col(math)["text"])
    out = cleaning.guarded(out, column, _after_decoding(True, True))
    return out.withColumn(column, _shown(c, F.col(math)["math"])).drop(math)


def _decoding() -> tuple:
    return tuple(sorted({key[:2] for key, _ in DECODING})), decode
