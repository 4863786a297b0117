"""Re-scoring by a stored model, lookups in the laid-out store, exports with a manifest."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from cohortflow.operators import store as S
from cohortflow.plans import store_queries as Q
from cohortflow.session import scratch_path
from cohortflow.sources import exports as E
from cohortflow.sources import store_files as SF
from cohortflow.streaming import rescoring as R
from cohortflow.streaming.features import changelog_part, compact, current_state, read_changelog

LABS = ["ldl", "hdl"]
VISIT = "patient_id string, visit_id string, visit_date date, ldl double, hdl double, age double, label int"
FEATURES = [f"{lab}_{s}" for lab in LABS for s in ("mean", "max", "min", "std", "last")]


@pytest.fixture(scope="module")
def visits(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):  # a third of the visits are of one patient
        p = 0 if rng.random() < 0.33 else rng.randrange(1, 40)
        rows.append((f"p{p}", f"v{i:04d}", dt.date(2024, 1, 1) + dt.timedelta(days=i // 4), 1e6 + rng.gauss(0, 1) + p % 2, rng.gauss(2, 1) if rng.random() < 0.9 else None, float(30 + p), p % 2))
    return spark.createDataFrame(rows, VISIT)


@pytest.fixture(scope="module")
def fitted(visits):
    feats = S.expanding_features(visits, LABS).join(visits.select("visit_id", "age", "label"), "visit_id")
    return R.fit_visit_model(feats, "visit_id", "label", [*FEATURES, "age"], [])


def test_rescoring_equals_the_batch_over_restarts_and_retries(spark, visits, fitted):
    store, state, source = (scratch_path(spark, x) for x in ("t-store", "t-state", "t-source"))
    R.publish(spark, store, "v1", "lr", fitted)
    loaded = R.champion(spark, store)
    assert loaded.params == fitted.params and loaded.features == fitted.features
    history, later = visits.filter("visit_date < '2024-02-10'"), visits.filter("visit_date >= '2024-02-10'")
    R.seed(history, state, "patient_id", "visit_id", LABS)
    run = lambda: R.run_visit_stream(spark, source, later.schema, loaded, state, LABS, max_files_per_trigger=1)
    days = ["2024-02-10", "2024-02-20", "2024-03-01", "2024-05-01"]
    for i, (a, b) in enumerate(zip(days, days[1:])):
        part = later.filter((F.col("visit_date") >= a) & (F.col("visit_date") < b))
        again = later.filter((F.col("visit_date") == days[i - 1])) if i else part.limit(3)  # visits that come twice
        part.union(again).union(visits.limit(2)).coalesce(1).write.mode("append").parquet(source)
        if i == 0:
            pending = spark.createDataFrame([(None, "x", None, 1.0, 1.0, 1.0, 0), ("p1", None, None, 1.0, 1.0, 1.0, 0)], VISIT)
            pending.coalesce(1).write.mode("append").parquet(source)
        got = run()
        if i == 1:
            compact(spark, state, ["patient_id"], keep_last=1)
            R.seed(history.limit(0), state, "patient_id", "visit_id", LABS)  # stays as it is
    want = S.expanding_features(visits, LABS).join(visits.select("visit_id", "age"), "visit_id").join(later.select("visit_id"), "visit_id", "left_semi")
    want = {r.visit_id: r.prediction_prob for r in fitted.score(want, ["visit_id", "visit_date"]).collect()}
    rows = got.collect()
    assert len(rows) == len(want) and {r.visit_id for r in rows} == set(want)
    assert all(abs(r.prediction_prob - want[r.visit_id]) < 1e-9 for r in rows)
    assert len({round(x, 6) for x in want.values()}) > 50
    # the last batch once more: the same rows
    epoch = max(int(r.epoch) for r in read_changelog(spark, state).select("epoch").distinct().collect())
    before = sorted(map(str, current_state(read_changelog(spark, state), ["patient_id"]).collect()))
    last = spark.read.parquet(f"{state}/scores/epoch={epoch}").select("visit_id").join(later, "visit_id").select(later.columns)
    R.score_batch(last, epoch, loaded, state, "patient_id", "visit_id", "visit_date", LABS)
    assert sorted(map(str, current_state(read_changelog(spark, state), ["patient_id"]).collect())) == before
    assert sorted(map(str, run().collect())) == sorted(map(str, rows))


def test_rescoring_without_history_or_files(spark, tmp_path, visits, fitted):
    (tmp_path / "none").mkdir()
    state = scratch_path(spark, "t-state")
    assert R.run_visit_stream(spark, str(tmp_path / "none"), visits.schema, fitted, state, LABS).count() == 0
    R.score_batch(visits.filter("patient_id = 'p0'"), 0, fitted, state, "patient_id", "visit_id", "visit_date", LABS)
    assert spark.read.parquet(changelog_part(state, "delta", 0)).count() == 1


def test_the_registered_stream_scores_every_new_visit_with_the_fitted_model(spark):
    ex_p, ex_v, nw_p, nw_v = Q.existing_and_incoming(spark, SMALL)
    got = {r.visit_id: r.prediction_prob for r in Q.q_rescore_stream(spark, SMALL).collect()}
    model = R.fit_visit_model(Q.labelled_patients(spark, SMALL, ex_p, ex_v), "patient_id", "label", Q.VISIT_CONTINUOUS, Q.VISIT_BINARY)
    history = ex_v.unionByName(nw_v)
    feats = Q.with_facts(S.expanding_features(history).join(nw_v.select("visit_id"), "visit_id", "left_semi"), nw_p)
    want = {r.visit_id: r.prediction_prob for r in model.score(feats, ["visit_id"]).collect()}
    assert got.keys() == want.keys() and got and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_lookup_reads_one_bucket(spark):
    p, v = Q._load(Q.store_source(spark, SMALL), Q.LOADED_AT)
    path = scratch_path(spark, "t-store")
    SF.write_store(p, v, path)
    some = p.orderBy("id").limit(3).collect()
    for r in some:
        one, its = SF.lookup(spark, path, code=r.patient_code)
        assert [x.patient_code for x in one.collect()] == [r.patient_code] and one.columns == p.columns and its.columns == v.columns
        assert sorted(x.visit_id for x in its.collect()) == sorted(x.visit_id for x in v.filter(F.col("patient_id") == r.id).collect())
        assert [x.id for x in SF.lookup(spark, path, id=r.id)[0].collect()] == [r.id]
        plan = its._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(patient_id," in plan
    for gone in (SF.lookup(spark, path, code="no such code"), SF.lookup(spark, path, code=None), SF.lookup(spark, path, id="")):
        assert [x.count() for x in gone] == [0, 0]


def test_export_verifies_and_notices_changes(spark):
    rows = spark.createDataFrame([(2, None, "a"), (1, 0.5, None), (1, 0.5, None)], "id long, x double, `odd name` string")
    path = scratch_path(spark, "t-export")
    tables = {"rows": (rows, ["odd name", "id", "x"], ["id"]), "none": (rows.limit(0), ["x"], []), "plain": (rows, ["id"], [])}
    listed = {r.table: r for r in E.export(spark, tables, path).collect()}
    assert [listed[t].n_rows for t in tables] == [3, 0, 3] and listed["rows"].columns == ["odd name", "id", "x"] and listed["none"].checksum == "0"
    assert all(r.verified for r in E.verify(spark, path).collect())
    assert [r.id for r in spark.read.parquet(f"{path}/rows").coalesce(1).orderBy("id").collect()] == [1, 1, 2]
    rows.filter("id = 1").select("odd name", "id", "x").write.mode("append").parquet(f"{path}/rows")
    rows.withColumn("id", F.col("id") + 1).select("id").write.mode("overwrite").parquet(f"{path}/plain")
    assert {r.table: r.verified for r in E.verify(spark, path).collect()} == {"rows": False, "none": True, "plain": False}
    assert json.loads(rows.schema.json())["fields"][0]["name"] == "id"
