"""The registered queries against their SQL, and their plans."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from folioforge.llm.queries import ORACLE, QUERIES
from tests.test_queries import SF, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return c


def test_all_are_registered():
    assert set(QUERIES) <= set(contract.queries())
    assert len([n for n in QUERIES if n.startswith("op")]) == 13 and "pipeline" in QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_result(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", ["op1_url_filter", "op6_mixing", "op9_license_scan", "op7_quality_rules", "op2_exact_dedup"])
def test_no_python_and_no_cross_join(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan
