"""Quantiles of whole columns from brackets against the sorted values."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.operators import prep as P
from cohortflow.operators import quantiles as Q

PROBS = {"least": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "most": 1.0}


@pytest.mark.parametrize("n", [1, 2, 7, 5000])
def test_equals_sorted_values(spark, n):
    rnd = random.Random(n)
    rows = [(rnd.gauss(0, 1), float(rnd.randrange(3)), None, rnd.random() if i % 3 == 0 else None, rnd.choice([-1e300, 1e300, 0.0]), i) for i in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, none double, c double, d double, e long")
    got = Q.column_quantiles(df, df.columns, PROBS)
    for at, c in enumerate(df.columns):
        values = sorted(float(r[at]) for r in rows if r[at] is not None)
        for name, q in PROBS.items():
            h = (len(values) - 1) * q
            lo, hi = (values[int(np.floor(h))], values[int(np.ceil(h))]) if values else (0.0, 0.0)
            assert got[c][name] == (lo + (hi - lo) * (h - np.floor(h)) if values else None), (c, name)


def test_a_missed_bracket_is_done_in_full(spark, monkeypatch):
    df = spark.range(1001).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2).alias("b"))
    real = F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda c, ends, accuracy: real(c, [0.9 for _ in ends], accuracy))
    assert Q.column_quantiles(df, ["a", "b"], {"q1": 0.25, "median": 0.5}) == {"a": {"q1": 250.0, "median": 500.0}, "b": {"q1": 500.0, "median": 1000.0}}


def test_fitting_puts_few_rows_in_order(spark, monkeypatch):
    ordered = []
    real = Q.prefix_sums
    monkeypatch.setattr(Q, "prefix_sums", lambda df, *x: ordered.append(df.count()) or real(df, *x))
    df = spark.range(20000).select("id", F.lit(0).alias("label"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    p = P.fit_preprocessor(df, "id", "label", ["a", "b"], [])
    assert abs(p.median["a"] - 0.5) < 0.02 and len(ordered) == 2 and sum(ordered) < 3000  # of 40,000 values, twice
