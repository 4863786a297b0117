"""Registry of every query (operator exercise) and its DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortflow.plans import (
    cohort_queries,
    eda_queries,
    eval_queries,
    explain_queries,
    oracle_cohort,
    oracle_eda,
    oracle_eval,
    oracle_explain,
    oracle_prep,
    oracle_stats,
    oracle_store,
    prep_queries,
    stats_queries,
    store_queries,
    train_queries,
)

QueryFn = Callable[[SparkSession, str], DataFrame]

_MODULES = [
    (cohort_queries, oracle_cohort), (eda_queries, oracle_eda), (stats_queries, oracle_stats),
    (eval_queries, oracle_eval),
    (prep_queries, oracle_prep),
    (explain_queries, oracle_explain),
    (store_queries, oracle_store),
    (train_queries, train_queries),
]


def all_queries() -> dict[str, QueryFn]:
    out: dict[str, QueryFn] = {}
    for qmod, _ in _MODULES:
        out.update(qmod.QUERIES)
    return out


def all_oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for _, omod in _MODULES:
        out.update(omod.ORACLE)
    return out
