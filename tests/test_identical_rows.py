"""Rows that need no neighbour search, and samples over rows without an entity."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortflow.operators.knn import knn_exact
from cohortflow.operators.visits import balanced_sample


def test_null_entities_take_no_place(spark):
    rows = [("p", None, "I21", "")] + [("p", f"n{i}", "I21" if i < 4 else "Z", "") for i in range(8)]
    df = spark.createDataFrame(rows, "panel string, patient_name string, a string, b string")
    out = balanced_sample(df, 8, code_cols=("a", "b"))
    assert out.select("patient_name").distinct().count() == 8 and out.filter(F.col("patient_name").isNull()).count() == 0


def test_identical_rows_are_their_own_neighbours(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("id"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(3.0).alias("z"))
    rows = knn_exact(df, "id", ["x", "y", "z"], k=3).collect()
    assert len(rows) == 30 and {r.dist for r in rows} == {0.0}
