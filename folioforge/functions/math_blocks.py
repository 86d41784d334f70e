"""Math blocks: protect, restore, extract, and clean around them."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import corrected
from folioforge.functions import fixed_values as fv
from folioforge.functions.charclass import let, record
from folioforge.functions.cleaning import clean_column, clean_text

_BLOCK_CHARS = 1024
#: What a placeholder of ``preserve_math_blocks`` looks like, and two that overlap.
_PLACEHOLDER = "__[A-Z]+_[A-Z]+_[0-9]+__"
_SHARED = "__[A-Z]+_[A-Z]+_[0-9]+__[A-Z]+_[A-Z]+_[0-9]+__"
#: Pairs of a gap and a match that are summed up at once.
_RUN = 128
#: Different equations up to which a text is searched for one after the other.
FEW_EQUATIONS = 32
_BLOCK = "array<struct<placeholder:string,content:string,type:string>>"
_EQUATION = "array<struct<content:string,type:string,start:int,end:int,context:string>>"


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _protect(state: Column, math_type: str, pattern: str) -> Column:
    """Swap every match of one pattern for a numbered placeholder."""

    def swap(m: Column) -> Column:
        offset = F.size(state["blocks"])
        found = F.transform(
            m,
            lambda block, i: F.struct(
                F.concat(
                    F.lit(f"__{math_type.upper()}_"),
                    (i + offset).cast("string"),
                    F.lit("__"),
                ).alias("placeholder"),
                block.alias("content"),
                F.lit(math_type).alias("type"),
            ),
        ).cast(_BLOCK)
        gaps = F.split(state["text"], pattern, -1)
        # One more gap than matches: join gap i with placeholder i.
        woven = F.zip_with(
            gaps,
            F.transform(found, lambda b: b["placeholder"]),
            lambda gap, mark: F.concat(gap, F.coalesce(mark, F.lit(""))),
        )
        return F.struct(
            F.array_join(woven, "").alias("text"),
            F.concat(state["blocks"], found).alias("blocks"),
        )

    return F.when(
        state["text"].rlike(pattern), let(_matches(state["text"], pattern), swap)
    ).otherwise(state)


def preserve_math_blocks(text: Column) -> Column:
    """Struct ``<text, blocks>``: placeholders in the text, originals in ``blocks``."""
    start = F.struct(text.alias("text"), F.array().cast(_BLOCK).alias("blocks"))
    return reduce(
        lambda acc, kind: let(acc, lambda s: _protect(s, *kind)),
        fv.PROTECTED_BLOCK_PATTERNS,
        start,
    )


def _restored_in_turn(text: Column, blocks: Column) -> Column:
    """Published order of events: each original in its turn, wherever its placeholder is then."""
    return F.aggregate(
        blocks, text, lambda t, b: F.replace(t, b["placeholder"], b["content"])
    )


def restore_math_blocks(text: Column, blocks: Column) -> Column:
    """Put the protected originals back.

    The text is split at its placeholders once, and the number in a placeholder says which
    block to look at; one that names no block stays.  Originals that hold placeholders of
    their own, placeholders that share underscores, and blocks that are not at the place
    their number says are put back in turn instead.
    """

    def woven(b: Column) -> Column:
        def original(mark: Column) -> Column:
            number = F.regexp_extract(mark, r"([0-9]+)__$", 1).try_cast("int")
            block = F.get(b, F.coalesce(number, F.lit(-1)))
            return F.when(block["placeholder"] == mark, block["content"]).otherwise(mark)

        parts = F.zip_with(
            F.split(text, _PLACEHOLDER, -1),
            F.transform(_matches(text, _PLACEHOLDER), original),
            lambda gap, mark: F.concat(gap, F.coalesce(mark, F.lit(""))),
        )
        in_place = F.forall(
            F.transform(b, lambda x, i: x["placeholder"].endswith(F.concat(F.lit("_"), i.cast("string"), F.lit("__")))),
            lambda x: x,
        )
        plain = in_place & ~text.rlike(_SHARED) & ~F.exists(b, lambda x: x["content"].rlike(_PLACEHOLDER))
        return F.when(plain, F.array_join(parts, "")).otherwise(_restored_in_turn(text, b))

    return F.when(F.size(blocks) == 0, text).otherwise(let(blocks, woven))


def _context(blocks: Column, start: Column, end: Column) -> Column:
    """The characters around ``[start, end)``, from the blocks they lie in.

    A substring of the whole text would be searched from its first character each time.
    """
    n = fv.EQUATION_CONTEXT_CHARS
    left = F.greatest(start - n, F.lit(0))
    first = F.floor(left / _BLOCK_CHARS).cast("int")
    last = F.floor((end + n) / _BLOCK_CHARS).cast("int")
    near = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    return F.substring(near, left - first * _BLOCK_CHARS + 1, end + n - left)


def _locate(text: Column, blocks: Column, eq_type: str, pattern: str) -> Column:
    """All matches of one pattern with offsets.

    Gap and match lengths alternate, so a running sum over them yields the offsets
    without searching the text again.  Sums run over pieces of the list and over their
    totals, as a fold copies the list that it has built so far with every step.
    """

    def placed(pairs: Column) -> Column:
        n = F.size(pairs)
        pieces = F.transform(
            F.sequence(F.lit(0), F.floor((n - 1) / _RUN).cast("int")),
            lambda i: F.slice(pairs, i * _RUN + 1, F.lit(_RUN)),
        )
        length = lambda p: F.length(p["gap"]) + F.length(p["hit"])
        totals = F.transform(pieces, lambda piece: _sum(F.transform(piece, length)))
        starts = _sums_before(totals)
        return F.flatten(F.zip_with(pieces, starts, lambda piece, start: rows(piece, start)))

    def rows(piece: Column, start: Column) -> Column:
        lengths = F.transform(piece, lambda p: F.length(p["gap"]) + F.length(p["hit"]))

        def row(pair: Column, before: Column) -> Column:
            at = start + before + F.length(pair["gap"])
            end = at + F.length(pair["hit"])
            return record(
                content=pair["hit"], type=F.lit(eq_type), start=at, end=end, context=_context(blocks, at, end)
            )

        return F.zip_with(piece, _sums_before(lengths), row)

    def found(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        pairs = F.zip_with(gaps, hits, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
        return let(pairs, placed)

    none = F.array().cast(_EQUATION)
    return F.when(text.rlike(pattern), let(_matches(text, pattern), found)).otherwise(none)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda s, x: s + x)


def _sums_before(numbers: Column) -> Column:
    """For each number of a short list, the sum of those before it."""
    return F.aggregate(
        numbers,
        record(sum=F.lit(0), out=F.array().cast("array<int>")),
        lambda acc, x: record(sum=acc["sum"] + x, out=F.concat(acc["out"], F.array(acc["sum"]))),
        lambda acc: acc["out"],
    )


def extract_equations(text: Column) -> Column:
    """Equations as ``array<struct<content,type,start,end,context>>``, pattern by pattern."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK_CHARS}}}"), F.lit(0))
    return let(
        blocks,
        lambda b: F.concat(*[_locate(text, b, t, p) for t, p in fv.EQUATION_PATTERNS]),
    )


def _mark(i: Column) -> Column:
    return F.concat(F.lit("__MATH_BLOCK_"), i.cast("string"), F.lit("__"))


def _hide_in_turn(text: Column, contents: Column) -> Column:
    """Each equation in its turn, replaced wherever it is in what is left of the text."""
    # A content that was hidden can come up again where a placeholder meets what is next to it.
    numbered = F.transform(contents, lambda c, i: F.struct(c.alias("content"), i.alias("number")))
    return F.aggregate(numbered, text, lambda t, c: F.replace(t, c["content"], _mark(c["number"])))


def hide_swept(text: str, contents: list[str]) -> str:
    """The same in one sweep: all places of all contents are found at once, earlier contents
    claim theirs first, and the text is written once."""
    import ahocorasick

    numbers: dict[str, int] = {}
    for i, content in enumerate(contents):
        numbers.setdefault(content, i)
    automaton = ahocorasick.Automaton()
    for content, number in numbers.items():
        automaton.add_word(content, (number, len(content)))
    automaton.make_automaton()
    places = sorted((number, end + 1 - n, end + 1) for end, (number, n) in automaton.iter(text))
    taken, chosen = bytearray(len(text)), []
    for number, start, end in places:
        # Both ends are enough unless an earlier content lies within.
        if not taken[start] and not taken[end - 1] and not any(taken[start:end]):
            taken[start:end] = b"\1" * (end - start)
            chosen.append((start, end, number))
    parts, at = [], 0
    for start, end, number in sorted(chosen):
        parts += [text[at:start], f"__MATH_BLOCK_{number}__"]
        at = end
    return "".join([*parts, text[at:]])


def _equations(text: Column) -> Column:
    return F.concat(*[_matches(text, p) for _, p in fv.EQUATION_PATTERNS])


def _hide(text: Column, contents: Column) -> Column:
    """``text`` with the equations of ``contents`` hidden; ``contents`` is looked at twice."""

    @F.pandas_udf("string")
    def swept(many: pd.DataFrame) -> pd.Series:
        pairs = zip(many["text"], many["contents"], strict=True)
        return pd.Series([None if t is None else hide_swept(t, list(c)) for t, c in pairs], dtype=object)

    def is_many(c: Column) -> Column:
        runs_on = F.exists(c, lambda x: x.rlike("(?:_|__M[A-Z_]*)$")) | text.contains("__MATH_BLOCK_")
        return F.coalesce((F.size(c) > FEW_EQUATIONS) & ~runs_on, F.lit(False))

    many = let(contents, lambda c: F.when(is_many(c), F.struct(text.alias("text"), c.alias("contents"))))
    in_turn = let(contents, lambda c: F.when(~is_many(c), _hide_in_turn(text, c)))
    return F.coalesce(swept(many), in_turn)


def hide_equations(text: Column) -> Column:
    """The text with each distinct equation replaced by its numbered placeholder.

    Texts of many equations are swept in a Python worker, which gets no others.  A content
    that could run on into a placeholder, or a text with placeholders of its own, is left to
    the search in turn, which sees what the placeholders have become part of.
    """
    return _hide(text, _equations(text))


def hide_column(df: DataFrame, column: str) -> DataFrame:
    """The same for a whole corpus: equations are found once, in a column of their own."""
    found = f"{column}_equations_of_text"
    df = df.withColumn(found, _equations(F.col(column)))
    return df.withColumn(column, _hide(F.col(column), F.col(found))).drop(found)


def clean_for_chunking(text: Column, preserve_math: bool = True, mode: str = "faithful") -> Column:
    """Clean with equations hidden behind placeholders.

    With ``mode="fixed"`` the rules are those of ``corrected``, and equations come back.

    Published behaviour: cleaning collapses the double underscores of the placeholders, so
    the step that would put the equations back finds none and is left out here.
    """
    if mode == "fixed":
        return corrected.clean_for_chunking(text, preserve_math)
    return clean_text(hide_equations(text) if preserve_math else text, mode=mode)


def clean_column_for_chunking(
    df: DataFrame, column: str, preserve_math: bool = True, mode: str = "faithful"
) -> DataFrame:
    """The same for a whole corpus, with the guarded cleaning chain."""
    if mode == "fixed":
        return corrected.clean_column_for_chunking(df, column) if preserve_math else clean_column(df, column, mode=mode)
    if preserve_math:
        df = hide_column(df, column)
    return clean_column(df, column, mode=mode)
