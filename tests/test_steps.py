"""What a step stores on its way is deleted with it, and the fold stage leaves nothing behind but its tables."""

from __future__ import annotations

import os

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from cohortflow.operators import train as T
from cohortflow.plans import prep_queries as PQ
from cohortflow.session import cut_lineage, ensure_checkpoint_dir, step, stored


def _at(path):
    return path.removeprefix("file:")


def _files(spark):
    top = _at(ensure_checkpoint_dir(spark))
    return {os.path.relpath(os.path.join(at, f), top) for at, _, names in os.walk(top) for f in names}


def test_tables_of_a_step_go_and_what_it_returns_stays(spark):
    before, seen = _files(spark), []

    def build():
        df = cut_lineage(spark.range(100).withColumn("none", F.lit("x")))
        seen.extend(_files(spark) - before)
        inner = stored(spark, lambda: cut_lineage(df.filter("id < 50")))
        return inner.join(df, "id").select("id", inner.none)

    out = stored(spark, build)
    assert seen and out.count() == 50 and not _files(spark) & set(seen)


def test_a_failing_step_leaves_nothing_and_other_lineage_is_cut_as_before(spark):
    before = _files(spark)
    with pytest.raises(ValueError), step(spark):
        cut_lineage(spark.range(10))
        raise ValueError
    assert _files(spark) == before
    assert cut_lineage(spark.range(10)).inputFiles() == [] and any("rdd-" in f for f in _files(spark) - before)
    with step(spark):  # Parquet has no type for it
        assert cut_lineage(spark.range(10).withColumn("nothing", F.lit(None))).count() == 10


def test_folds_and_fold_summary_leave_only_their_tables(spark):
    rows = [(i, int(i % 4 == 0), float(i % 17), float(i % 23)) for i in range(200)]
    train = spark.createDataFrame(rows, "row_id long, label int, a double, b double")
    folds = train.select("row_id", (F.col("row_id") % 3).cast("int").alias("fold"))
    before = _files(spark)
    fit = T.rebalanced_folds(train, folds, "row_id", "label", ["a", "b"], 3)
    new = {f.split("/part-")[0] for f in _files(spark) - before if "/part-" in f and not os.path.basename(f).startswith(".")}
    assert {f.rsplit("/", 1)[-1] for f in new} == {"train_fold=0", "train_fold=1", "train_fold=2"} and len({f.rsplit("/", 1)[0] for f in new}) == 1
    counts = {(r.train_fold, r.label): r["count"] for r in fit.groupBy("train_fold", "label").count().collect()}
    assert len(counts) == 6 and all(counts[f, 0] == counts[f, 1] for f in range(3))
    PQ.prepared(spark, SMALL).params
    before = _files(spark)
    assert PQ.q_fold_summary(spark, SMALL).count() == 5
    assert not any("rdd-" in f or "step-" in f for f in _files(spark) - before)
