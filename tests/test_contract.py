"""Every registered query against its SQL, and plan shapes that must not appear."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from check_oracles import compare, open_tables

from conftest import DATA

OWN = {query.__name__ for query in contract.REGISTERED}


@pytest.fixture(scope="module")
def tables():
    return open_tables(DATA)


def test_every_query_has_sql():
    assert OWN <= set(contract.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(OWN))
def test_query_matches_its_sql(spark, tables, name):
    assert compare(spark, tables, DATA, name) == ""


def test_entry(spark):
    result = contract.entry(spark)
    assert result.columns == ["user", "high_risk_events"] and result.count() == 10


@pytest.mark.parametrize("name", ["filter_combined", "flagged_events", "kpis", "risk_score_histogram"])
def test_no_cross_product_and_no_python_in_reports(spark, name):
    plan = contract.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython"):
        assert node not in plan
