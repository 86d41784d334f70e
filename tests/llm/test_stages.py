"""Stages of the pipeline on tables with odd columns and on empty ones."""

from collections import Counter

import pytest

import corpus_pipeline
from folioforge.llm import block_naming, mixing, quality_rules, simhash

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, _row string, _copies string, "
    "_bucket int, _whole string, _copy int, size string, root string, token long, place int, t string"
)
EXTRA = ("r", "c", 7, "w", 1, "s", "o", 5, 3, "x")


def prose(seed):
    return " ".join(f"the w{(seed * 31 + i * 7) % 997} of" for i in range(40))


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    rows = [(i, prose(i), "en", "a", 1, *EXTRA) for i in range(5)]
    rows += [(10, prose(1), "en", "a", 1, *EXTRA), (11, prose(2) + " end", None, None, None, *EXTRA)]
    path = str(tmp_path_factory.mktemp("clashing") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize(
    "stage", [quality_rules.keep_good, block_naming.drop_copies, simhash.drop_near_duplicates, mixing.mix]
)
def test_columns_of_any_name_are_kept(clashing, stage):
    out = stage(clashing)
    assert out.schema.names == clashing.schema.names
    rows = out.collect()
    assert rows and {tuple(r)[5:] for r in rows} == {EXTRA}
    whole = {(r["doc_id"], r["text"], r["source"]) for r in clashing.collect()}
    assert {(r["doc_id"], r["text"], r["source"]) for r in rows} <= whole


def test_copies_and_near_copies_go(clashing):
    kept = Counter(r["doc_id"] for r in block_naming.drop_copies(clashing).collect())
    assert kept == Counter([0, 2, 3, 4, 10, 11])
    left = {r["doc_id"] for r in simhash.drop_near_duplicates(clashing).collect()}
    assert len(left) == 5 and len(left & {1, 10}) == 1 and len(left & {2, 11}) == 1


def test_empty_table_end_to_end(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_bits_say_yes_for_all_values(spark):
    import numpy as np
    from pyspark.sql import functions as F

    values = spark.range(5000).select(F.xxhash64("id").alias("h"))
    own = np.array([r.h for r in values.collect()])
    other = np.array([r.h for r in spark.range(10_000, 30_000).select(F.xxhash64("id").alias("h")).collect()])
    there = simhash.Bits(values).contains()
    assert there(own).all() and there(other).mean() < 0.15
    # A table that is too small keeps everything, and so does not lose anything.
    full = simhash.Bits(values, bound=64).contains()
    assert full(own).all()
    assert not simhash.Bits(values.limit(0)).contains()(other).any()
