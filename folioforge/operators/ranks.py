"""Nearest-rank percentiles and row numbers that never put all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.session import cut_lineage

# Values per bucket.  Measures are non-negative ints, so there are at most 2^21 buckets
# for the one window that runs over all buckets, and 2^10 values in any other window.
_BUCKET = 1024


def size_profile(
    df: DataFrame, measures: dict[str, Column], percentiles: dict[str, float]
) -> DataFrame:
    """One row per measure: n, min, max, mean and the value at rank ``min(int(n*p), n-1)``.

    Rows shrink to a histogram in the map-side aggregate; ranks are then found by bucket
    and only after that by value.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("measure"), value.cast("int").alias("value"))
            for name, value in measures.items()
        ]
    )
    counted = df.select(F.inline_outer(pairs)).groupBy("measure", "value").agg(F.count("*").alias("cnt"))
    # Stored: it is joined with itself below, and what it comes from must not run twice.
    hist = cut_lineage(counted, "histogram").withColumn("bucket", F.floor(F.col("value") / _BUCKET))
    by_measure = Window.partitionBy("measure")
    buckets = (
        hist.groupBy("measure", "bucket")
        .agg(F.sum("cnt").alias("b_cnt"))
        .withColumn(
            "base",
            F.sum("b_cnt").over(by_measure.orderBy("bucket")) - F.col("b_cnt"),
        )
        .withColumn("n", F.sum("b_cnt").over(by_measure))
    )
    in_bucket = Window.partitionBy("measure", "bucket").orderBy("value")
    ranked = hist.join(buckets, ["measure", "bucket"]).withColumn(
        "upto", F.col("base") + F.sum("cnt").over(in_bucket)
    )

    def at(p: float) -> Column:
        rank = F.least(F.floor(F.col("n") * F.lit(float(p))), F.col("n") - 1)
        inside = (F.col("upto") - F.col("cnt") <= rank) & (rank < F.col("upto"))
        return F.max(F.when(inside, F.col("value")))

    return ranked.groupBy("measure").agg(
        F.sum("cnt").alias("n"),
        F.min("value").alias("min"),
        *[at(p).alias(name) for name, p in percentiles.items()],
        F.max("value").alias("max"),
        (F.sum(F.col("value") * F.col("cnt")) / F.sum("cnt")).alias("mean"),
    )


def _in_range_order(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` range-partitioned and sorted, with ``_part`` and ``_id``, as a stored table.

    Stored, because partition contents have to be the same when summed up and when numbered,
    whatever executors are lost in between.
    """
    parts = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    return cut_lineage(parts, "numbered").withColumn("_part", F.shiftright("_id", 33))


def _with_base(parts: DataFrame, amount: Column) -> DataFrame:
    """Add ``_base``: the sum of ``amount`` over all partitions before a row's own.

    The sums of partitions are added up on the driver: as many numbers as there are tasks.
    """
    sums = parts.groupBy("_part").agg(F.sum(amount).alias("n")).orderBy("_part").collect()
    bases, total = [], 0
    for row in sums:
        bases.append((row["_part"], total))
        total += row["n"]
    known = parts.sparkSession.createDataFrame(bases, "_part long, _base long")
    return parts.join(F.broadcast(known), "_part")


def number_rows(df: DataFrame, order: list[str], out: str = "row") -> DataFrame:
    """Dense 0-based row numbers in ``order``, by range partitions."""
    parts = _with_base(_in_range_order(df, order), F.lit(1))
    return parts.withColumn(out, F.col("_base") + _position()).drop("_part", "_base", "_id")


def _position() -> Column:
    """A row's place in its partition, from ``_id``."""
    return F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))


def _key(row) -> tuple:
    """A sort key like Spark's: nulls first."""
    return tuple((v is not None, v) for v in row)


def stored_in_order(df: DataFrame, order: list[str]) -> tuple[DataFrame, dict[int, int]]:
    """``df`` stored in ``order`` with ``_id``, and how many rows come before each partition.

    A row's number is that of its partition, ``_id >> 33``, and its place there, the lower bits.
    Where the partitions already hold ranges that do not overlap, rows are sorted within them
    and stay where they are; else they are exchanged by range.  Either way rows are written once
    or, if the partitions turn out to overlap, twice.
    """
    ident = F.monotonically_increasing_id()
    stored = cut_lineage(df.sortWithinPartitions(*order).withColumn("_id", ident), "in-place")

    def ranges(table: DataFrame) -> list:
        key = F.struct(*order)
        # A row for each partition: as many as there are tasks.
        return table.groupBy(F.shiftright("_id", 33).alias("part")).agg(
            F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n")
        ).collect()

    parts = sorted(ranges(stored), key=lambda p: (_key(p.lo), _key(p.hi)))
    if any(_key(a.hi) > _key(b.lo) for a, b in zip(parts, parts[1:], strict=False)):
        stored = cut_lineage(
            stored.drop("_id").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", ident), "in-order"
        )
        parts = sorted(ranges(stored), key=lambda p: p.part)
    before, total = {}, 0
    for p in parts:
        before[p.part] = total
        total += p.n
    return stored, before


def with_numbers(
    stored: DataFrame, before: dict[int, int], out: str = "row", keep_part: bool = False
) -> DataFrame:
    """Number the rows of ``stored_in_order``, or of some of its files; ``_part`` can be kept."""
    bases = stored.sparkSession.createDataFrame(list(before.items()), "_part long, _base long")
    parts = stored.withColumn("_part", F.shiftright("_id", 33)).join(F.broadcast(bases), "_part")
    numbered = parts.withColumn(out, F.col("_base") + _position()).drop("_base", "_id")
    return numbered if keep_part else numbered.drop("_part")


def sum_before(df: DataFrame, order: list[str], amount: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``amount`` over all rows before a row in ``order``.

    Running sums stay within range partitions; no window holds all rows.
    """
    parts = _with_base(_in_range_order(df, order), F.col(amount))
    within = F.sum(amount).over(Window.partitionBy("_part").orderBy("_id")) - F.col(amount)
    return parts.withColumn(out, F.col("_base") + within).drop("_part", "_base", "_id")
