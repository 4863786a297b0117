"""Wording of values: binary features, ages with bands of their own, and z-score bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortflow.operators.explain import describe_value


def test_value_wording(spark):
    want = [
        ("flag", 1.0, 9.0, "yes"), ("flag", 0.0, 9.0, "no"), ("age", 70.0, 1.6, "very old"), ("age", 60.0, 1.5, "old"), ("age", 50.0, 0.5, "middle-aged"),
        ("age", 50.0, 0.0, "middle-aged"), ("age", 40.0, -0.5, "young"), ("age", 20.0, -1.5, "very young"), ("x", 1.0, 1.5, "high"),
        ("x", 1.0, 0.1, "slightly above average"), ("x", 1.0, 0.0, "slightly below average"), ("x", 1.0, -0.5, "low"), ("x", 1.0, -1.5, "very low"),
    ]
    df = spark.createDataFrame(want, "feature string, value double, z double, want string")
    got = describe_value(F.col("feature"), F.col("value"), F.col("z"), {"flag": ("no", "yes")}, ["age"])
    assert df.filter(got != F.col("want")).count() == 0
