"""Property tests on random data against brute force, and a hot-group skew check for the distributed path."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortflow.operators import evaluate as EV
from cohortflow.operators import stats as ST
from cohortflow.operators.quantiles import quantiles_wide

values = st.lists(st.integers(min_value=-20, max_value=20), min_size=1, max_size=60)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(a=values, b=values)
def test_quantiles_equal_numpy(spark, a, b):
    rows = [("a", float(v)) for v in a] + [("b", float(v)) for v in b]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in quantiles_wide(df, ["g"], "v", {"q1": 0.25, "med": 0.5, "q3": 0.75}).collect()}
    for g, vals in (("a", a), ("b", b)):
        for name, q in (("q1", 25), ("med", 50), ("q3", 75)):
            assert got[g][name] == pytest.approx(float(np.percentile(vals, q)), abs=1e-12)


@SETTINGS
@given(x0=values, x1=values)
def test_mann_whitney_u_and_auc_equal_pair_counts(spark, x0, x1):
    rows = [("f", float(v), 0) for v in x0] + [("f", float(v), 1) for v in x1]
    df = spark.createDataFrame(rows, "feature string, value double, label int")
    u0 = ST.mann_whitney(df, "label").first()["u0"]
    pairs = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in x0 for b in x1)
    assert u0 == pytest.approx(pairs)
    scored = df.select(F.lit("m").alias("model"), F.monotonically_increasing_id().alias("row_id"),
                       F.col("value").alias("prob"), F.col("label").alias("actual"))
    auc = EV.roc_auc(scored).first()["auc"]
    assert auc == pytest.approx((len(x0) * len(x1) - pairs) / (len(x0) * len(x1)))


def test_hot_group_is_spread_over_slices_and_exact(spark):
    """One group with most of the rows: the two-level path splits it over several range slices and still
    returns the exact order statistics."""
    rnd = np.random.default_rng(1)
    hot = rnd.integers(0, 5000, size=30000).astype(float)
    cold = rnd.integers(0, 50, size=200).astype(float)
    rows = [("hot", float(v)) for v in hot] + [("cold", float(v)) for v in cold]
    df = spark.createDataFrame(rows, "g string, v double")
    counts = df.groupBy("g", "v").count()
    slices = counts.repartitionByRange(8, "g", "v").withColumn("_s", F.spark_partition_id())
    hot_slices = slices.filter(F.col("g") == "hot").select("_s").distinct().count()
    assert hot_slices > 1
    got = {r["g"]: r for r in quantiles_wide(df, ["g"], "v", {"q1": 0.25, "q3": 0.75}).collect()}
    assert got["hot"]["q1"] == pytest.approx(float(np.percentile(hot, 25)))
    assert got["hot"]["q3"] == pytest.approx(float(np.percentile(hot, 75)))
    assert got["cold"]["q3"] == pytest.approx(float(np.percentile(cold, 75)))
