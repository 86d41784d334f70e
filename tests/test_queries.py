"""Every registered query against its SQL equivalent, and the plans they run with."""

import math
import os
import re

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract
from folioforge.plans.oracle import ORACLE as CORE_SQL
from folioforge.plans.registry import QUERIES as CORE

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")

# Those of the optional subpackage have tests of their own.
QUERIES, ORACLE = CORE, CORE_SQL


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return c


def plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return bool(v)
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return round(float(v), 9)
    return str(v)


def rows(frame, columns):
    values = frame[columns].itertuples(index=False, name=None)
    return sorted((tuple(plain(x) for x in r) for r in values), key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_result(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.sql(ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_entry(spark):
    assert contract.entry(spark).count() == 2500


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["chunk_documents", "clean_text_full", "extract_equations"])
def test_maps_move_nothing(spark, name):
    p = plan(QUERIES[name](spark, SF))
    assert "Exchange" not in p
    assert "Python" not in p and "Arrow" not in p


@pytest.mark.parametrize("name", ["knn_all_top5", "eval_breakdown", "retrieve_benchmark", "judge_prompts"])
def test_no_cross_join(spark, name):
    p = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_scan_reads_needed_columns_only(spark):
    p = plan(QUERIES["word_counts"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


@pytest.mark.parametrize("name", ["heading_samples", "mojibake_patterns", "knn_all_top5", "knn_blocks_top5"])
def test_group_limits_before_the_shuffle(spark, name):
    assert re.search(r"WindowGroupLimit .*Partial", plan(QUERIES[name](spark, SF)))


@pytest.mark.parametrize("name", sorted(CORE))
def test_texts_are_worked_on_once(spark, name):
    """No pattern of mis-decoded characters and no chunk generator twice in a plan."""
    p = plan(QUERIES[name](spark, SF))
    assert p.count("Ž[\\p") <= 1 and p.count("Generate inline(chunk") <= 1
    assert p.count("CHAPTER|Chapter)\\s+\\d+$") <= 1


def test_many_queries_read_the_index_in_two_rounds(spark):
    """The second round is in the plan; the hits of the first are a table."""
    p = plan(QUERIES["knn_blocks_top5"](spark, SF))
    assert p.count("MapInArrow") == 1 and p.count("FileScan parquet") <= 3


@pytest.mark.parametrize("name", ["index_stats", "cache_stats", "cached_vectors"])
def test_stored_vectors_are_not_exchanged(spark, name):
    p = plan(QUERIES[name](spark, SF))
    assert "Exchange hashpartitioning" not in p and "Exchange rangepartitioning" not in p


def test_workers_get_the_package(tmp_path):
    """In a session started elsewhere, Python workers still find the package."""
    import subprocess
    import sys

    code = (
        f"import sys; sys.path.insert(0, {os.path.dirname(contract.__file__)!r})\n"
        "from pyspark.sql import SparkSession\n"
        "import __spark_entry__ as e\n"
        "print('rows', e.entry(SparkSession.builder.master('local[2]').getOrCreate()).count())\n"
    )
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120
    )
    assert "rows 2500" in done.stdout, done.stderr[-2000:]
