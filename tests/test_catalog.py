"""Every query of the core against its SQL, and the driver contract."""

from __future__ import annotations

import pytest
from conftest import duck, rows

from lodestrand.plans import catalog


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, small, con, name):
    found = catalog.QUERIES[name](spark, small)
    expected = con.execute(catalog.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)


def test_entry_names_queries_with_sql(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.QUERIES) <= set(e.queries())


def test_top_k_is_not_sorted_as_a_whole(spark, small):
    plan = catalog.QUERIES["sim_topk"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_filters_reach_the_scan(spark, small):
    from pyspark.sql import functions as F

    from lodestrand.operators.filters import Compiler

    records = spark.read.parquet(f"{small}/records.parquet")
    chosen = Compiler({"lifecycle_state": F.col("lifecycle_state")}).compile({"not": {"eq": {"field": {"kind": "canonical", "name": "lifecycle_state"}, "value": "eligible"}}})
    plan = records.where(chosen).select("record_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualNullSafe(lifecycle_state,eligible)" in plan and "sequence_digest" not in plan
