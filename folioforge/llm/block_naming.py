"""Exact duplicates by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes.  Equal blocks get equal integers,
the places of the blocks in a sort; then pairs of neighbouring integers get integers in the
same way, until one is left for each document.  Integers come from comparing contents, not
from trusting hashes, so two documents have the same identity only if they are identical.

Blocks are dealt to naming buckets by hash and sorted within them, which moves each text
once.  The most frequent blocks are dealt over several buckets and get an integer in each;
these few are then made one by comparing contents again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.rows import ROW, text_of, with_row_id, without_rows
from folioforge.session import cut_lineage

BLOCK_BYTES = 2048
#: Naming buckets; their number and 2^43 integers in each make up a long.
BUCKET_BITS = 20
#: So many of the most frequent blocks are spread over so many buckets each.  A block that is
#: not among them has at most one in HOT_BLOCKS of all rows.
HOT_BLOCKS, SPREAD = 2000, 64
#: No neighbour: the last of an odd number of integers.  Names are not negative.
NONE = -1


def _ranked(df: DataFrame, bucket: Column, *order: str) -> DataFrame:
    """Add ``name``: an integer for each different value of ``order``."""
    width = 63 - BUCKET_BITS
    within = Window.partitionBy("_bucket").orderBy(*order)
    return df.withColumn("_bucket", F.pmod(bucket, F.lit(1 << BUCKET_BITS))).withColumn(
        "name",
        F.shiftleft(F.col("_bucket").cast("long"), width)
        + F.dense_rank().over(within).cast("long"),
    )


def _blocks(docs: DataFrame, size: int) -> DataFrame:
    """``(_row, doc_id, sha, n_blocks, pos, block, h)``, one row per block."""
    rows = with_row_id(docs.select("doc_id", text_of(docs).alias("text"))).select(
        ROW,
        "doc_id",
        F.sha2(F.col("text").cast("binary"), 256).alias("sha"),
        F.col("text").cast("binary").alias("bytes"),
    )
    last = F.expr(f"greatest(octet_length(bytes) - 1, 0) div {size}")
    parts = F.transform(
        F.sequence(F.lit(0).cast("long"), last),
        lambda i: F.substring(F.col("bytes"), (i * size + 1).cast("int"), F.lit(size)),
    )
    cut = rows.select(
        ROW,
        "doc_id",
        "sha",
        (last + 1).alias("n_blocks"),
        F.posexplode(parts).alias("pos", "block"),
    )
    return cut.withColumn("h", F.xxhash64("block")).withColumn(
        "sha", F.when(F.col("pos") == 0, F.col("sha"))
    )


def _name_blocks(docs: DataFrame, size: int) -> DataFrame:
    """``(_row, doc_id, sha, n_blocks, pos, name)``."""
    frequent = (
        _blocks(docs, size).groupBy("h").count().filter("count > 1")
        .orderBy(F.desc("count"), "h").limit(HOT_BLOCKS).collect()
    )
    hot = F.col("h").isin([r["h"] for r in frequent]) if frequent else F.lit(False)
    blocks = _blocks(docs, size).withColumn("hot", hot)
    salt = F.when(F.col("hot"), F.pmod(F.col(ROW), F.lit(SPREAD))).otherwise(F.lit(0))
    before = F.lag("block").over(Window.partitionBy("_bucket").orderBy("block"))
    named = _ranked(blocks, F.xxhash64("h", salt), "block").withColumn(
        "content",
        F.when(
            F.col("hot") & (before.isNull() | (before != F.col("block"))), F.col("block")
        ),
    )
    named = cut_lineage(
        named.select(ROW, "doc_id", "sha", "n_blocks", "pos", "name", "content"), "blocks"
    )
    # At most HOT_BLOCKS * SPREAD rows of two longs, whatever the input: safe to broadcast.
    same = Window.partitionBy("content")
    aliases = named.filter("content IS NOT NULL").select(
        "name", F.min("name").over(same).alias("one")
    )
    return named.join(F.broadcast(aliases), "name", "left").select(
        ROW, "doc_id", "sha", "n_blocks", "pos", F.coalesce("one", "name").alias("name")
    )


def _in_order(rows: DataFrame) -> DataFrame:
    """``(_row, names)``: the integers of each document in their order."""
    listed = rows.groupBy(ROW).agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("l"))
    return listed.select(ROW, F.col("l.name").alias("names"))


def _name_pairs(names: DataFrame) -> DataFrame:
    """Halve the integers of each document: one for each pair of neighbours."""
    pairs = names.select(
        ROW,
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.expr("(size(names) - 1) div 2")),
                lambda i: F.struct(
                    F.get("names", i * 2).alias("a"),
                    F.coalesce(F.get("names", i * 2 + 1), F.lit(NONE)).alias("b"),
                ),
            )
        ).alias("pos", "pair"),
    ).select(ROW, "pos", "pair.a", "pair.b")
    different = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    named = _ranked(different, F.xxhash64("a", "b"), "a", "b").select("a", "b", "name")
    return _in_order(pairs.join(named, ["a", "b"]))


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(_row, doc_id, sha, n_blocks, name)`` of every document.

    Texts are equal if and only if ``n_blocks`` and ``name`` are.  Null texts count as
    empty, rows may repeat, ids may be null, and other columns don't matter.
    """
    named = _name_blocks(docs, block_bytes)
    first = named.filter("pos = 0").select(ROW, "doc_id", "sha", "n_blocks")
    # Documents of one block have their name already.
    done = named.filter("n_blocks = 1").select(ROW, "name")
    left = cut_lineage(_in_order(named.filter("n_blocks > 1")), "names")
    longest = left.agg(F.max(F.size("names"))).first()[0] or 1
    while longest > 1:
        left = cut_lineage(_name_pairs(left), "names")
        done = done.unionByName(left.filter("size(names) = 1").select(ROW, F.col("names")[0].alias("name")))
        left = left.filter("size(names) > 1")
        longest = (longest + 1) // 2
    return first.join(done, ROW)


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(_row, doc_id, keep_id, group_size, kept, text_sha256)`` of every document.

    Of equal texts the row with the largest ``doc_id`` stays; a null id is the smallest, and
    of rows that share the largest id, one stays.  An empty table gives no rows.
    """
    named = cut_lineage(identities(docs, block_bytes), "identities")
    # Written, so that a large group's rows meet its one row in a join that Spark can split.
    groups = cut_lineage(
        named.groupBy("n_blocks", "name").agg(
            F.max(F.struct("doc_id", ROW)).alias("keep"), F.count(F.lit(1)).alias("group_size")
        ),
        "groups",
    )
    return named.join(groups, ["n_blocks", "name"]).select(
        ROW,
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col(f"keep.{ROW}") == F.col(ROW)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that stay, with all their columns, whatever their names."""
    gone = exact_duplicates(docs, block_bytes).filter(~F.col("kept")).select(ROW)
    return without_rows(docs, gone)
