"""From documents to packed sequences: five stages, each written and read again by the next.

Filtering stages return the columns of documents; the last one returns the place of every
piece of every document that the mix takes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm import block_naming, mixing, packing, quality_rules, simhash
from folioforge.session import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep to all quality rules."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts, the document with the largest id."""
    return block_naming.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by similar texts, one document.

    Rows with close SimHash fingerprints meet first, by pigeonhole blocks; what that leaves apart
    meets on its rarest five-word shingles.  Either way all shingles are compared.
    Fingerprints alone differ too much where a stretch of a text was added, cut or replaced, so
    they miss pairs, which the join on shingles finds.
    """
    return simhash.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` of every piece."""
    return packing.packed(docs)


#: Stages in order, by the names they were dealt.
STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL cannot tokenize; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
