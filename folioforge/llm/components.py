"""Connected components of an edge table by alternating large and small stars.

Each round points the larger neighbours of every node at the smallest neighbour, then the
smaller ones, until every node points at the smallest node of its component.  The number of
rounds grows with the logarithm of the nodes; only two numbers a round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.session import cut_lineage, drop_table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    pointed = both.join(least, "a").filter("b > a")
    return pointed.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    pointed = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return pointed.filter("a != b").unionByName(own).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``(a, b)``; the root is the component's smallest node.

    Edges may repeat, be given in either direction, and join a node to itself.  An empty
    table gives no rows.
    """
    current = cut_lineage(edges.select("a", "b").filter("a != b").distinct(), "edges")
    seen = None
    while True:
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if state == seen:
            break
        seen = state
        closer = cut_lineage(_small_star(_large_star(current)), "edges")
        drop_table(current)
        current = closer
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    own = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return roots.unionByName(own)
