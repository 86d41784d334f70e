"""Cleaning of extracted page text, as Spark column expressions.

All rules run inside whole-stage codegen.  Where several published rules are
independent of each other they are fused into one regex pass: a pass costs a UTF-8
decode and a scan of the whole text, so passes, not rules, are what a large corpus
pays for.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import fixed_values as fv
from folioforge.functions.charclass import D, DIGIT, S, WS_INLINE, let, strip

# Every missing-space rule inserts one blank between two neighbouring characters, and
# no insertion can create or destroy another rule's neighbourhood other than by
# separating the very pair it separates.  So one pass does them all: take the left
# character, look at the right one.
_LEFT_OF_GAP = (
    "(?![a-z][a-z ])(?! )(?:"  # most places in running text: leave at once
    + "|".join(
        [
            rf"[a-z](?=[A-Z0-9(=<>{DIGIT}])",
            rf"[A-Z](?=[0-9(=<>{DIGIT}])",
            r"[,;):=<>](?=[a-zA-Z])",
            r"\.(?=[A-Z][a-z])",
            f"{D}(?=[a-zA-Z%])",
            f"%(?={D})",
        ]
    )
    + ")"
)

_WRITTEN_REFERENCE = (
    "(?=[CSEFTA])(Chapter|Section|Equation|Figure|Table|Algorithm)"
    rf"{S}+([0-9]+){S}+([0-9]+)"
)


def replace_all(text: Column, table: list[tuple[str, str]]) -> Column:
    """Apply literal replacements in table order."""
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), table, text)


def fix_missing_spaces(text: Column) -> Column:
    """Insert blanks lost in extraction (``wordWord``, ``word3``, ``a,b``, ``x=y``...)."""
    return F.regexp_replace(text, _LEFT_OF_GAP, "$0 ")


def fix_encoding_issues(text: Column) -> Column:
    return replace_all(text, fv.ENCODING_FIXES)


def fix_math_symbols(text: Column) -> Column:
    return replace_all(text, fv.MATH_SYMBOL_FIXES)


def _collapse_letters(text: Column) -> Column:
    return F.regexp_replace(text, r"([a-zA-Z])\1{3,}", "$1$1")


def _collapse_marks(text: Column) -> Column:
    return F.regexp_replace(text, r"([.!?])\1{2,}", "$1")


def _collapse_rules(text: Column) -> Column:
    c = F.regexp_replace(text, "-{2,}", "—")
    return F.regexp_replace(c, r"([_*])\1+", "$1")


def _unescape_latex(text: Column) -> Column:
    return replace_all(text, fv.LATEX_ESCAPES)


def _tighten_powers(text: Column) -> Column:
    return F.regexp_replace(text, rf"([a-zA-Z]){S}*\^{S}*([0-9])", r"$1^$2")


def _tighten_indices(text: Column) -> Column:
    return F.regexp_replace(text, rf"([a-zA-Z]){S}*_{S}*([0-9a-zA-Z])", "$1_$2")


def _dot_references(text: Column) -> Column:
    return F.regexp_replace(text, _WRITTEN_REFERENCE, "$1 $2.$3")


def clean_artifacts(text: Column) -> Column:
    """Collapse runs, unescape LaTeX brackets, tighten ``x ^ 2`` and ``Section 5 3``."""
    c = _collapse_rules(_collapse_marks(_collapse_letters(text)))
    c = _unescape_latex(c)
    return _dot_references(_tighten_indices(_tighten_powers(c)))


def fix_abbreviations(text: Column) -> Column:
    """Plain substring expansion; like the published rule it has no word boundary."""
    return replace_all(text, fv.ABBREVIATIONS)


def normalize_whitespace(text: Column) -> Column:
    c = F.regexp_replace(text, rf"\n(?:[{WS_INLINE}]*\n){{2,}}", "\n\n")
    c = F.regexp_replace(c, " {2,}", " ")
    c = F.regexp_replace(c, rf"{S}+(?=[.,;:!?])", "")
    c = F.regexp_replace(c, "[.,;:!?](?=[a-zA-Z])", "$0 ")
    c = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return strip(c)


def artifact_steps() -> list:
    """``clean_artifacts`` as (needles, step)."""
    return [
        ((), _collapse_letters),
        (("...", "!!!", "???"), _collapse_marks),
        (("--", "__", "**"), _collapse_rules),
        (("\\",), _unescape_latex),
        (("^",), _tighten_powers),
        (("_",), _tighten_indices),
        ((), _dot_references),
    ]


def _steps(fix_spaces: bool, fix_encoding: bool, fix_math: bool, normalize_ws: bool):
    """The chain as (needles, step): a step can only change texts with one of its needles."""
    steps: list = []
    if fix_spaces:
        steps.append(((), fix_missing_spaces))
    if fix_encoding:
        steps.append((("Ã", "â€"), fix_encoding_issues))
    if fix_math:
        steps.append((("Ã", "Â", "âˆ", "âŠ", "â‰"), fix_math_symbols))
    steps += [*artifact_steps()[:-1], ((), lambda c: fix_abbreviations(_dot_references(c)))]
    if normalize_ws:
        steps.append(((), normalize_whitespace))
    return steps


def _chain(mode: str):
    if mode == "faithful":
        return _steps
    if mode == "fixed":
        from folioforge.functions import corrected

        return corrected.steps
    raise ValueError(f"mode is 'faithful' or 'fixed', not {mode!r}")


def clean_text(
    text: Column,
    fix_spaces: bool = True,
    fix_encoding: bool = True,
    fix_math: bool = True,
    normalize_ws: bool = True,
    mode: str = "faithful",
) -> Column:
    """The whole cleaning chain as one expression.  Null becomes ``''``.

    ``mode="fixed"`` takes the corrected rules of ``corrected`` instead of the published ones.
    Steps are guarded as in ``clean_column``.
    """
    steps = _chain(mode)(fix_spaces, fix_encoding, fix_math, normalize_ws)
    guarded_step = lambda c, step: let(c, lambda t: _guarded(t, *step)) if step[0] else step[1](c)
    return reduce(guarded_step, steps, F.coalesce(text, F.lit("")))


def clean_column(
    df: DataFrame,
    column: str,
    fix_spaces: bool = True,
    fix_encoding: bool = True,
    fix_math: bool = True,
    normalize_ws: bool = True,
    mode: str = "faithful",
) -> DataFrame:
    """The same chain for a whole corpus: costly rare-case steps run only where needed.

    Looking for a needle is a byte search, far cheaper than the step it may spare.  Each
    guarded step is its own projection so that the text is computed once; Spark keeps the
    projections apart and compiles them into one codegen stage.
    """
    out = df.withColumn(column, F.coalesce(F.col(column), F.lit("")))
    return guarded(out, column, _chain(mode)(fix_spaces, fix_encoding, fix_math, normalize_ws))


def guarded(df: DataFrame, column: str, steps: list) -> DataFrame:
    """Apply ``(needles, step)`` in turn, a step only to texts that hold one of its needles."""
    for needles, step in steps:
        df = df.withColumn(column, _guarded(F.col(column), needles, step))
    return df


def _guarded(c: Column, needles: tuple, step) -> Column:
    if not needles:
        return step(c)
    return F.when(reduce(or_, [F.contains(c, F.lit(n)) for n in needles]), step(c)).otherwise(c)
