"""Every SQL-checkable query equals its DuckDB oracle (rows, columns, values) on the smallest fixture."""

from __future__ import annotations

import pytest
from conftest import SMALL
from oracle_harness import compare, duck

import __spark_entry__ as E

ORACLES = {k: v for k, v in E.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, QUERIES[name], ORACLES[name], SMALL, con)
    assert r["cols_match"], r
    assert r["types_match"], r
    assert r["values_match"], r


def test_every_query_has_oracle_or_is_model_based():
    rows_only = set(QUERIES) - set(ORACLES)
    assert {k for k in rows_only if not k.startswith("op") and k != "pipeline"} == {"train_lr", "train_rf", "train_gbt", "grid_search", "model_champion", "score_batch", "importances", "vif", "attr_tree", "rescore_stream"}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "target" in df.columns
