"""The engine's inputs, taken from the given tables.

The tables hold clean prose, so conditions the engine handles (joined words, mis-decoded
characters, headings, paragraphs, captions) are put into the text by literal
replacements.  ``plans.oracle`` states the same derivations in SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Literal replacements, top to bottom, that put defects into every text.
DEFECTS = [
    (" the ", " theFig. 3 "),
    (" and ", "=and(vs)x<y "),
    (" to ", " to--5%6 Table 2 "),
    (" of ", " $a+b$ \\(c_1\\) of "),
    (" in ", " \\[x = 2\\] Section 5  3 "),
    (" on ", " \\begin{align}y=1\\end{align} \\begin{gather}z\\end{gather} "),
    (" de ", " Ã© de "),
    (" la ", " âˆ† la Ō12 "),
    (" le ", " â€™x ^ 2 y _ 3 le "),
    (" un ", " âˆžaaaa√x "),
    (" und ", " Â±und Equation 7 ∑ ≤ "),
    (" er ", " er \n12\n"),
    (" es ", " e.g es!!! algorithm 4"),
    (" el ", " Ã± __el__ **  "),
    (" en ", " ╬en ŽĄz "),
    (". T", " .\n \n\nT"),
    (", ", ","),
    (".\n", ".  \n"),
]

# Page tops, by document.
PAGE_TOPS = [
    "CHAPTER 3 Basics\n3.1 First Steps\n",
    "12\nxiv\n\n",
    "Chapter 7\n7.2.1 Deep Nets\n\n41\n",
    "ABSTRACT VIEW\n",
    "",
]

#: Session setting: tasks over which the queries deal their input first.
PARTITIONS = "folioforge.inputPartitions"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` as it is, or dealt over ``folioforge.inputPartitions`` tasks if that is set.

    The benchmark sets it: its input is one file of one row group, hence one task.
    """
    n = df.sparkSession.conf.get(PARTITIONS, None)
    return df.repartition(int(n), *keys) if n else df


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, source, text)``."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return spread(docs, "doc_id")


def noisy_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with defects."""
    noisy = reduce(
        lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), DEFECTS, F.col("text")
    )
    return texts(spark, sf_dir).withColumn("text", noisy)


def topped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with page tops and every line a paragraph."""
    top = F.element_at(
        F.array(*[F.lit(t) for t in PAGE_TOPS]),
        (F.col("doc_id") % len(PAGE_TOPS) + 1).cast("int"),
    )
    paragraphs = F.replace(F.col("text"), F.lit("\n"), F.lit("\n \n"))
    return texts(spark, sf_dir).withColumn("text", F.concat(top, paragraphs))


def as_documents(texts_: DataFrame) -> DataFrame:
    """Texts as documents: one page each, the source as the book."""
    return texts_.select(
        F.substring(F.md5(F.concat_ws("_", "source", F.col("doc_id").cast("string"))), 1, 12)
        .alias("id"),
        F.col("text").alias("content"),
        F.create_map(F.lit("book_file"), F.col("source")).alias("metadata"),
        F.col("doc_id").alias("page_number"),
        F.col("source").alias("book_title"),
        F.lit("").alias("chapter"),
        F.lit("").alias("section"),
        F.array().cast("array<struct<path:string,xref:int,width:int,height:int,format:string,page:int>>")
        .alias("images"),
        F.col("doc_id").alias("doc_seq"),
    )
