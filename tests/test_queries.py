"""Registered queries against their SQL on the smallest tables."""

import math

import pytest
from compare import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# Long fits, covered by tests of their own; here all others run.
SLOW = {"sensitivity_grid", "ml_gbt", "ml_gbt_leaf", "ml_forest_importance",
        "model_comparison", "concordance_models", "deep_cox_history", "protocol", "pipeline",
        *(n for n in QUERIES if n.startswith("op"))}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_query_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_query_runs(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows
    for r in rows:
        assert not any(isinstance(v, float) and math.isinf(v) for v in r)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
