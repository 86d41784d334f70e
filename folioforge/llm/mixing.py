"""Mixing sources to target weights by systematic sampling.

Each source gets a target in words; every document of a source is expected to be taken
target / size-of-source times.  Documents of a source are lined up, the expected copies
before each are its place on a line, shifted by one random offset for the source, and a
document is taken once for each whole number that its stretch of the line crosses.

The line runs by size, so that the words taken keep close to the target.  Places come from
counts by source and size, then by a hash within one size, so no window holds a source: only
a source's different sizes, or the rows of one size and hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.rows import ROW, WORD, text_of, with_row_id
from folioforge.operators.ranks import number_rows
from folioforge.session import cut_lineage

#: Weights by the source's place, repeating; a source grows to so many times its size at most.
WEIGHTS, MOST = (1, 2, 3), 3
SEED = "mix"


def _targets(sources: DataFrame, most: int) -> DataFrame:
    """Add ``target`` to ``(key, source_size, weight)``.

    Shares are capped, and what is above the caps is dealt again by weight, until no share
    is above.  A round adds up the capped sizes and the other weights: two numbers, whatever
    the number of sources.
    """
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    total, capped, left = float(total or 0), 0.0, float(weights or 0)
    cap = (F.col("source_size") * most).cast("double")
    while True:
        above = (total - capped) * F.col("weight") > cap * left
        again = sources.agg(
            F.sum(F.when(above, cap).otherwise(0.0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))
        ).first()
        capped_now, left_now = float(again[0] or 0), float(again[1] or 0)
        if left_now == left:
            break
        capped, left = capped_now, left_now
    share = (total - capped) * F.col("weight") / left if left else F.lit(0.0)
    return sources.withColumn("target", F.when(above, cap).otherwise(share).cast("double"))


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(_row, doc_id, source, size, source_size, target, copies)`` of every document.

    Null texts have size 0.  Sources are weighed in the order of their code points, a null
    source last.  Documents of one size are in the order of a hash and of ``doc_id``; a null
    id counts by its row's place.  Sources of size 0 have target 0 and are not taken.
    """
    rows = with_row_id(
        docs.select("doc_id", F.col("source").cast("string").alias("source"), text_of(docs).alias("t"))
    )
    identity = F.coalesce(F.col("doc_id").cast("string"), F.col(ROW).cast("string"))
    rows = cut_lineage(
        rows.select(
            ROW,
            "doc_id",
            "source",
            F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"),
            F.regexp_count("t", F.lit(WORD)).cast("long").alias("size"),
            F.substring(F.md5(identity), 1, 2).alias("tie"),
        ),
        "sizes",
    )
    sizes = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    placed = number_rows(sizes.withColumn("last", F.col("source").isNull()), ["last", "key"], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = cut_lineage(
        _targets(placed.select("key", "source_size", weight.alias("weight")), most), "targets"
    )

    def before(counts: DataFrame, name: str, by: list[str], order: str) -> DataFrame:
        line = Window.partitionBy(*by).orderBy(order)
        return counts.withColumn(name, F.sum("n").over(line) - F.col("n"))

    by_tie = rows.groupBy("key", "size", "tie").agg(F.count(F.lit(1)).alias("n"))
    by_size = by_tie.groupBy("key", "size").agg(F.sum("n").alias("n"))
    by_size = before(by_size, "smaller", ["key"], "size").drop("n")
    by_tie = before(by_tie, "tied", ["key", "size"], "tie").drop("n").join(by_size, ["key", "size"])
    # One offset for each source, in steps of 2^-20 so that sums with it stay exact.
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(SEED), "key")), 1, 5), 16, 10).cast("double") / (1 << 20)
    by_tie = by_tie.join(
        sources.select(
            "key", "source_size", "target",
            F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("each"),
            offset.alias("offset"),
        ),
        "key",
    )
    same = Window.partitionBy("key", "size", "tie").orderBy("doc_id", ROW)
    place = F.col("smaller") + F.col("tied") + F.col("nth")
    crossed = F.floor((place + 1) * F.col("each") + F.col("offset")) - F.floor(
        place * F.col("each") + F.col("offset")
    )
    return (
        rows.withColumn("nth", F.row_number().over(same) - 1)
        .join(by_tie, ["key", "size", "tie"])
        .select(ROW, "doc_id", "source", "size", "source_size", "target", crossed.cast("long").alias("copies"))
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The documents of the mix, with all their columns, repeated as often as taken.

    Nulls, ties and repeated rows are dealt with as in ``copies``; columns may have any name.
    """
    taken = copies(docs, weights, most).filter("copies > 0").select(ROW, "copies")
    whole = with_row_id(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_whole")))
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    repeated = whole.join(taken, ROW).select("_whole", times.alias("_copy"))
    return repeated.select(*[F.col("_whole")[c].alias(c) for c in docs.columns])
