"""Neighbouring chunks of a page: overlaps and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SPAN = 8192  # documents per slice of a page key


def _compared(rows: DataFrame, within: list[str], order: list[str]) -> DataFrame:
    """One row for each group: its own pairs and those of its rows, and its two edges."""
    along = Window.partitionBy(*within).orderBy(*order)
    place = F.struct(*order)
    return (
        rows.withColumn("prev_end", F.lag("last_end").over(along))
        .groupBy(*within)
        .agg(
            (F.sum("overlaps") + F.count_if(F.col("first_start") < F.col("prev_end"))).alias("overlaps"),
            (F.sum("gaps") + F.count_if(F.col("first_start") > F.col("prev_end"))).alias("gaps"),
            F.min_by("first_start", place).alias("first_start"),
            F.max_by("last_end", place).alias("last_end"),
        )
    )


def adjacent_pairs(chunks: DataFrame) -> DataFrame:
    """``(overlap_pairs, gap_pairs)`` between chunks next to each other on a page.

    Order on a page is ``(chunk_index, doc_seq)``.  Page keys are not unique in general, so
    a page is cut into slices along that order, and slices into slices of slices: neighbours
    are compared within a slice, then the edges of slices next to each other, twice.
    """
    rows = chunks.select(
        "book_title",
        "page_number",
        "chunk_index",
        F.floor(F.col("doc_seq") / (_SPAN * _SPAN)).alias("upper"),
        F.floor(F.col("doc_seq") / _SPAN).alias("slice"),
        "doc_seq",
        F.col("start_char").alias("first_start"),
        F.col("end_char").alias("last_end"),
        F.lit(0).cast("long").alias("overlaps"),
        F.lit(0).cast("long").alias("gaps"),
    )
    page = ["book_title", "page_number"]
    slices = _compared(rows, [*page, "chunk_index", "upper", "slice"], ["doc_seq"])
    uppers = _compared(slices, [*page, "chunk_index", "upper"], ["slice"])
    pages = _compared(uppers, page, ["chunk_index", "upper"])
    return pages.agg(
        F.coalesce(F.sum("overlaps"), F.lit(0)).alias("overlap_pairs"),
        F.coalesce(F.sum("gaps"), F.lit(0)).alias("gap_pairs"),
    )
