"""What the operators of this subpackage share: row ids, words, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of characters that are no ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Number of folds, and the fold that is held out from every fit.
FOLDS, HELD_OUT = 5, 0
ROW = "_row"


def with_row_id(df: DataFrame) -> DataFrame:
    """Add ``_row``, a number of the row that holds for repeated and null ids too.

    It follows from the row's place in the input, so the input has to give the same rows in
    the same order whenever it is read again: files do, and so do checkpoints.
    """
    return df.withColumn(ROW, F.monotonically_increasing_id())


def without_rows(df: DataFrame, gone: DataFrame) -> DataFrame:
    """``df`` without the rows that ``gone`` lists by ``_row``; its own columns may have any name."""
    whole = with_row_id(df.select(F.struct(*[df[c] for c in df.columns]).alias("_whole")))
    left = whole.join(gone, ROW, "left_anti")
    return left.select(*[F.col("_whole")[c].alias(c) for c in df.columns])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the fold that no model learns from; null ids don't."""
    fold = F.crc32(doc_id.cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == HELD_OUT, F.lit(False))


def bounded_sample(df: DataFrame, bound: int, *keys: str) -> DataFrame:
    """``df`` if it has at most ``bound`` rows, else about so many, chosen by a hash of ``keys``.

    A threshold on the hash is a filter: no rows are ranked, and none but the chosen move.
    """
    n = df.count()
    if n <= bound:
        return df
    return df.filter(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < int((1 << 30) * bound / n))


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(df[column].cast("string"), F.lit(""))
