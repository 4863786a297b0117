"""Invariants for operators without a SQL twin and for the distributed code paths."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from cohortflow.operators import eda
from cohortflow.operators import prep as P
from cohortflow.operators.knn import knn_exact
from cohortflow.operators.prefix import prefix_sums, running_stats
from cohortflow.operators.quantiles import quantiles_wide
from cohortflow.operators.resample import smote


def _values(spark, n=400, seed=7):
    rnd = random.Random(seed)
    rows = [(g, float(rnd.randint(0, 60)), rnd.randint(0, 1)) for g in ("a", "b", "c") for _ in range(n)]
    return spark.createDataFrame(rows, "feature string, value double, label int")


def test_quantiles_equal_numpy(spark):
    df = _values(spark)
    got = {r["feature"]: (r["q1"], r["q3"]) for r in quantiles_wide(df, ["feature"], "value", {"q1": 0.25, "q3": 0.75}).collect()}
    for f in "abc":
        vals = sorted(r["value"] for r in df.filter(F.col("feature") == f).collect())
        assert got[f] == pytest.approx((float(np.percentile(vals, 25)), float(np.percentile(vals, 75))))


def test_running_sums_keep_null_groups_and_need_no_group(spark):
    rows = [(None if i % 3 == 0 else f"g{i % 3}", i, i % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, t int, v long")
    for groups in (["g"], []):
        got = {r["t"]: r for r in prefix_sums(df, groups, ["t"], ["v"], num_partitions=7).collect()}
        assert len(got) == 300
        run, total = {}, {}
        for g, _, v in rows:
            total[g if groups else 0] = total.get(g if groups else 0, 0) + v
        for g, t, v in rows:
            k = g if groups else 0
            assert got[t]["v_before"] == run.get(k, 0) and got[t]["v_total"] == total[k]
            run[k] = run.get(k, 0) + v
            assert got[t]["v_upto"] == run[k]


def test_split_and_folds_keep_rows_without_a_label(spark):
    df = spark.createDataFrame([(i, None if i < 10 else i % 2) for i in range(100)], "row_id long, label int")
    assert P.kfold_assign(df, "row_id", "label", 5, 42).count() == 100
    assert P.stratified_split(df, "row_id", "label", 0.2, 42).count() == 100


def test_running_stats_of_large_values_null_groups_and_null_values(spark):
    rnd = random.Random(5)
    rows = [(None if i % 2 else "g", i, None if i % 11 == 0 else 1e9 + rnd.randint(0, 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "p string, t int, v double")
    got = {r["t"]: r for r in running_stats(df, ["p"], ["t"], ["v"], num_partitions=6).collect()}
    assert len(got) == 400
    seen = {}
    for p, t, v in rows:
        hist = seen.setdefault(p, [])
        hist += [v] if v is not None else []
        r = got[t]
        assert r["v_n"] == len(hist)
        if hist:
            assert r["v_mean"] == pytest.approx(np.mean(hist), rel=1e-15) and r["v_max"] == max(hist) and r["v_min"] == min(hist)
        assert (r["v_std"] is None) == (len(hist) < 2)
        if len(hist) > 1:
            assert r["v_std"] == pytest.approx(np.std(hist, ddof=1), rel=1e-6, abs=1e-7)


def test_vif_of_collinear_features_is_infinite(spark):
    from cohortflow.operators.train import variance_inflation

    rnd = np.random.default_rng(2)
    a, b = rnd.normal(size=(2, 200))
    df = spark.createDataFrame([(float(x), float(2 * x + 1), float(y), float(x + y)) for x, y in zip(a, b)], "a double, twice double, b double, both double")
    got = {r["feature"]: r["vif"] for r in variance_inflation(df, ["a", "twice", "b"]).collect()}
    r2 = np.corrcoef(a, b)[0, 1] ** 2
    assert got["a"] == got["twice"] == math.inf
    assert got["b"] == pytest.approx(1 / (1 - r2))
    free = {r["feature"]: r["vif"] for r in variance_inflation(df, ["a", "b"]).collect()}
    assert free["a"] == free["b"] == pytest.approx(1 / (1 - r2))


def test_running_stats_match_numpy(spark):
    rnd = random.Random(3)
    rows = [(p, i, float(rnd.randint(1, 9))) for p in range(3) for i in range(50)]
    df = spark.createDataFrame(rows, "p int, t int, v double")
    got = {(r["p"], r["t"]): r for r in running_stats(df, ["p"], ["t"], ["v"]).collect()}
    for p in range(3):
        hist = []
        for i in range(50):
            hist.append(next(v for (pp, ii, v) in rows if pp == p and ii == i))
            r = got[(p, i)]
            assert r["v_mean"] == pytest.approx(np.mean(hist))
            assert r["v_max"] == max(hist) and r["v_min"] == min(hist)
            if len(hist) > 1:
                assert r["v_std"] == pytest.approx(np.std(hist, ddof=1))


def test_stratified_split_is_exact_and_disjoint(spark):
    rows = [(i, 1 if i % 17 == 0 else 0) for i in range(2000)]
    df = spark.createDataFrame(rows, "row_id long, label int")
    s = P.stratified_split(df, "row_id", "label", 0.2, 42)
    counts = {(r["label"], r["split"]): r["count"] for r in s.groupBy("label", "split").count().collect()}
    n1 = sum(1 for _, y in rows if y == 1)
    n0 = len(rows) - n1
    assert counts[(1, "test")] == math.floor(n1 * 0.2 + 0.5)
    assert counts[(0, "test")] == math.floor(n0 * 0.2 + 0.5)
    assert s.count() == len(rows) and s.select("row_id").distinct().count() == len(rows)


def test_folds_balanced_per_class(spark):
    rows = [(i, 1 if i % 7 == 0 else 0) for i in range(1003)]
    f = P.kfold_assign(spark.createDataFrame(rows, "row_id long, label int"), "row_id", "label", 5, 42)
    per = {}
    for r in f.groupBy("label", "fold").count().collect():
        per.setdefault(r["label"], []).append(r["count"])
    for counts in per.values():
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_knn_exact_matches_brute_force(spark):
    rnd = np.random.default_rng(5)
    pts = np.round(rnd.normal(size=(120, 4)), 3)
    pts[10] = pts[11]  # a duplicate: distance 0 tie
    pts[20:40] = pts[19]  # a hot spot of 21 identical rows (more than k + 1)
    rows = [(i, *map(float, p)) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    got = {}
    for r in knn_exact(df, "id", ["a", "b", "c", "d"], 5).collect():
        got.setdefault(r["id"], []).append((r["nn_rank"], r["nn_id"]))
    for i, p in enumerate(pts):
        d = np.sqrt(((pts - p) ** 2).sum(axis=1))
        order = sorted((float(d[j]), j) for j in range(len(pts)) if j != i)[:5]
        assert [j for _, j in order] == [j for _, j in sorted(got[i])]


def test_smote_balances_and_stays_in_hull(spark):
    rnd = np.random.default_rng(9)
    rows = [(i, 1 if i < 30 else 0, float(rnd.normal()), float(rnd.normal())) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, label int, a double, b double")
    out = smote(df, "row_id", "label", ["a", "b"], 5, 42)
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts[0] == counts[1] == 170
    mins = np.array([(a, b) for _, y, a, b in rows if y == 1])
    syn = np.array([(r["a"], r["b"]) for r in out.filter(F.col("is_synthetic")).collect()])
    assert (syn.min(axis=0) >= mins.min(axis=0) - 1e-12).all() and (syn.max(axis=0) <= mins.max(axis=0) + 1e-12).all()
    again = sorted(tuple(r) for r in smote(df, "row_id", "label", ["a", "b"], 5, 42).filter(F.col("is_synthetic")).collect())
    assert again == sorted(tuple(r) for r in out.filter(F.col("is_synthetic")).collect())


def test_tree_attributions_add_up(spark):
    import __spark_entry__ as E

    df = E.queries()["attr_tree"](spark, SMALL)
    per = {}
    for r in df.collect():
        per.setdefault(r["row_id"], {"sum": 0.0})
        if r["feature"] == "__base__":
            per[r["row_id"]]["base"] = r["contribution"]
        elif r["feature"] == "__score__":
            per[r["row_id"]]["score"] = r["contribution"]
        else:
            per[r["row_id"]]["sum"] += r["contribution"]
    assert per
    for v in per.values():
        assert v["base"] + v["sum"] == pytest.approx(v["score"], abs=1e-5)  # outputs are rounded to 6 places


def test_model_queries_produce_rows(spark):
    import __spark_entry__ as E

    q = E.queries()
    coef = {r["feature"] for r in q["train_lr"](spark, SMALL).collect()}
    grid = q["grid_search"](spark, SMALL).collect()
    assert {r["family"]: r["is_best"] for r in sorted(grid, key=lambda r: r["is_best"])} == dict.fromkeys(("logistic_regression", "random_forest", "boosted_trees"), True)
    assert sum(r["is_best"] for r in grid) == 3 and all(r["n_folds"] == 5 for r in grid) and sum(r["family"] == "logistic_regression" for r in grid) == 6
    champion = q["model_champion"](spark, SMALL).collect()
    assert len(champion) == 3 and sum(r["is_champion"] for r in champion) == 1 and {"intercept", *champion[0]["features"].split(",")} == coef
    scores = q["score_batch"](spark, SMALL).collect()
    assert scores and all(0.0 <= r["prob"] <= 1.0 for r in scores)
    assert q["importances"](spark, SMALL).count() > 0
    assert {r["feature"] for r in q["vif"](spark, SMALL).collect()} == coef - {"intercept", "flag_urgent"}


def test_partition_independence(spark):
    import __spark_entry__ as E

    q = E.queries()["cohort_select"]
    a = sorted(map(tuple, q(spark, SMALL).collect()), key=str)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        b = sorted(map(tuple, q(spark, SMALL).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a == b


def test_upsert_is_idempotent(spark):
    from cohortflow.operators import store as S
    from cohortflow.plans.store_queries import BATCH_AT, STORE_FLAGS, existing_and_incoming

    ex_p, ex_v, nw_p, nw_v = existing_and_incoming(spark, SMALL)
    p1, v1 = S.upsert(ex_p, ex_v, nw_p, nw_v, STORE_FLAGS, BATCH_AT)
    p2, v2 = S.upsert(p1.drop("status"), v1, nw_p, nw_v, STORE_FLAGS, BATCH_AT)
    assert p1.count() == p2.count() and v1.count() == v2.count()
    assert p2.filter(F.col("status") == "inserted").count() == 0


def test_vectorised_treeshap_equals_recursive(spark):
    from cohortflow.operators import treeshap as TS
    from cohortflow.operators.train import assemble, boosted_trees

    rnd = np.random.default_rng(11)
    rows = [(i, int(rnd.random() < 0.3), *map(float, rnd.normal(size=3))) for i in range(300)]
    df = assemble(spark.createDataFrame(rows, "row_id long, label int, a double, b double, c double"), ["a", "b", "c"])
    model = boosted_trees(max_iter=5, max_depth=3).fit(df)
    ens = TS.extract_ensemble(model)
    tables = [lt for t in ens for lt in TS.leaf_tables(t)]
    xs = np.array([r[2:] for r in rows[:40]])
    phi_v, score_v = TS.shap_batch(tables, xs, 3)
    for r in range(len(xs)):
        phi = np.zeros(3)
        for t in ens:
            TS.tree_shap(t, xs[r], phi)
        assert np.allclose(phi, phi_v[r], atol=1e-10)
        assert score_v[r] == pytest.approx(sum(t.weight * t.predict(xs[r]) for t in ens))


def test_stream_in_several_batches_equals_batch(spark):
    """Several micro-batches (one file each): the latest-per-key changelog state equals the batch aggregate."""
    from cohortflow.operators import cohort as C
    from cohortflow.session import read_table, scratch_path
    from cohortflow.sources import fixtures as FX
    from cohortflow.streaming.features import feature_state, run_feature_stream

    events = read_table(spark, SMALL, "events")
    src = scratch_path(spark, "stream-test-source")
    events.repartition(4).write.parquet(src)

    def derive(ev):
        return C.parse_measurements(FX.lab_rows_from_events(ev))

    streamed = run_feature_stream(spark, src, events.schema, derive, "admission_no", max_files_per_trigger=1)
    batch = feature_state(derive(spark.read.parquet(src)), "admission_no", "panel", "value", "performed_at", "row_id")
    cols = sorted(batch.columns)
    def canon(df):
        return sorted(tuple(None if v is None else (round(v, 9) if isinstance(v, float) else v) for v in r) for r in df.select(*cols).collect())
    assert canon(streamed) == canon(batch)


def test_stream_resumes_and_compacts(spark):
    """A second run with the same folder reads only the new file; compaction leaves the current state as it is."""
    from cohortflow.operators import cohort as C
    from cohortflow.session import read_table, scratch_path
    from cohortflow.sources import fixtures as FX
    from cohortflow.streaming.features import compact, current_state, feature_state, read_changelog, run_feature_stream

    events = read_table(spark, SMALL, "events")
    src, state = scratch_path(spark, "stream-restart-source"), scratch_path(spark, "stream-restart")
    parts = [events.filter(F.col("event_id") % 10 != 0), events.filter(F.col("event_id") % 10 == 0)]
    keys = ["admission_no", "panel"]

    def derive(ev):
        return C.parse_measurements(FX.lab_rows_from_events(ev))

    def canon(df):
        return sorted((tuple(None if v is None else (round(v, 9) if isinstance(v, float) else v) for v in r) for r in df.select(*sorted(df.columns)).collect()), key=str)

    for part in parts:
        part.coalesce(1).write.mode("append").parquet(src)
        got = canon(run_feature_stream(spark, src, events.schema, derive, "admission_no", state_dir=state))
        batch = feature_state(derive(spark.read.parquet(src)), *keys, "value", "performed_at", "row_id")
        assert got == canon(batch)
    log = read_changelog(spark, state)
    last = log.filter(F.col("epoch") == log.agg(F.max("epoch")).first()[0])
    assert last.select(*keys).distinct().count() == derive(parts[1]).select(*keys).distinct().count()
    compact(spark, state, keys)
    log = read_changelog(spark, state)
    assert log.count() == batch.count() and canon(current_state(log, keys)) == canon(batch)


def test_store_keeps_undated_visits_and_rejects_rows_without_a_code(spark):
    from cohortflow.operators import store as S

    rows = [
        ("p", "1", "1980", "Nam", dt.date(2024, 1, 1), 1.0), ("q", "1", "1981", "Nu", dt.date(2024, 1, 1), 2.0),  # one code, one day
        ("p", "2", None, None, None, 3.0), ("p", None, "1980", "Nam", dt.date(2024, 1, 1), 4.0), ("p", "3", "1980", "Nam", dt.date(2024, 1, 2), None),
    ]
    src = spark.createDataFrame(rows, "patient_name string, admission_no string, birth_year string, sex string, visit_date date, ldl double")
    src = src.withColumns({"age": F.lit(40), "diabetes": F.lit(1)})
    pat, vis = S.load_store(src, lab_cols=["ldl"], flag_cols=["diabetes"])
    assert sorted(r["patient_code"] for r in pat.collect()) == ["1", "2"]
    assert sorted((r["ldl"], str(r["visit_date"])) for r in vis.collect()) == [(1.0, "2024-01-01"), (2.0, "2024-01-01"), (3.0, "1970-01-01")]
    assert vis.select("visit_id").distinct().count() == 3
    p2, v2 = S.upsert(pat, vis, pat.union(pat), vis.union(vis), ["diabetes"])
    assert p2.count() == 2 and v2.count() == 3


def test_bands_keep_equal_rows(spark):
    from cohortflow.operators.explain import apply_bands

    bands = [("m", ">", 2.0, 1, "high"), ("m", ">", 5.0, 2, "very high"), ("m", "else", 0.0, 0, "normal"), ("n", "<", 1.0, 3, "low")]
    rows = [("a", "m", 6.0), ("a", "m", 6.0), ("b", "m", 3.0), ("c", "m", 1.0), ("d", "m", None), ("e", "n", 2.0), ("f", "n", 0.5)]
    out = apply_bands(spark.createDataFrame(rows, "k string, metric string, value double"), bands, ["k"])
    assert sorted((r["k"], r["severity"], r["label"]) for r in out.collect()) == [
        ("a", 2, "very high"), ("a", 2, "very high"), ("b", 1, "high"), ("c", 0, "normal"), ("f", 3, "low")]


def _brute_knn(rows, k):
    """{(id, rank): (neighbour, distance)} by all pairs of (id, vector) without a missing value."""
    out = {}
    pts = [(i, v) for i, v in rows if None not in v]
    for i, v in pts:
        near = sorted((math.dist(v, w), j) for j, w in pts if j != i)[:k]
        out.update({(i, r): (j, d) for r, (d, j) in enumerate(near, 1)})
    return out


@pytest.mark.parametrize("kind", ["one feature", "constant leading", "all equal", "far apart", "nulls"])
def test_knn_of_odd_shapes(spark, kind):
    rnd = random.Random(7)
    rows = {
        "one feature": [(i, [rnd.randrange(40) / 4]) for i in range(60)],
        "constant leading": [(i, [1.0, 2.0, 3.0, i * 1e9]) for i in range(12)],
        "all equal": [(i, [1.0, 2.0]) for i in range(9)],
        "far apart": [(i, [rnd.random() * 1e-6 + (i % 3) * 1e6, rnd.random()]) for i in range(40)],
        "nulls": [(i, [rnd.random(), None if i % 4 == 0 else rnd.random(), 5.0]) for i in range(40)],
    }[kind]
    features = [f"x{j}" for j in range(len(rows[0][1]))]
    df = spark.createDataFrame([(i, *v) for i, v in rows], "id long, " + ", ".join(f"{f} double" for f in features))
    got = {(r.id, r.nn_rank): (r.nn_id, r.dist) for r in knn_exact(df, "id", features, 5).collect()}
    want = _brute_knn(rows, 5)
    assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 1e-9 * (1 + want[x][1]) for x in want)


def test_smote_refuses_rows_with_a_missing_feature(spark):
    df = spark.createDataFrame([(i, int(i < 8), float(i), None if i in (1, 3) else 1.0) for i in range(48)], "id long, label int, a double, b double")
    with pytest.raises(ValueError):
        smote(df, "id", "label", ["a", "b"])
    whole = smote(df.fillna(0.0), "id", "label", ["a", "b"]).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in whole} == {0: 40, 1: 40}


def test_kde_equals_the_kernel_sum(spark):
    rnd = random.Random(3)
    data = {"a": [rnd.gauss(5, 2) for _ in range(700)] * 2, "b": [rnd.expovariate(1) * 1e6 for _ in range(300)], "flat": [3.0] * 9, "one": [4.0], "none": [None] * 3}
    df = spark.createDataFrame([(f, v) for f, vs in data.items() for v in vs], "feature string, value double").repartition(7)
    got = {(r.feature, r.i): r for r in eda.kde_curve(df, 101).collect()}
    assert {f for f, _ in got} == {"a", "b", "flat", "one"} and len(got) == 404
    for f in ("a", "b"):
        v = np.array(data[f])
        h, span = len(v) ** -0.2 * v.std(ddof=1), np.ptp(v)
        for i, x in enumerate(np.linspace(v.min() - span / 2, v.max() + span / 2, 101)):
            want = np.exp(-0.5 * ((x - v) / h) ** 2).sum() / (len(v) * h * math.sqrt(2 * math.pi))
            assert got[f, i].x == pytest.approx(x, rel=1e-9, abs=1e-9 * span) and got[f, i].density == pytest.approx(want, rel=1e-9, abs=1e-12 / h)
    assert all(r.density is None for (f, _), r in got.items() if f in ("flat", "one"))


def test_histogram_has_its_empty_bins(spark):
    df = spark.createDataFrame([("a", v) for v in (0.0, 0.1, 9.9, 10.0)] + [("flat", 2.0)] * 3 + [("none", None)], "feature string, value double")
    got = sorted((r.feature, r.bin, r.n) for r in eda.histogram(df, 10).collect())
    assert got == [("a", i, 2 if i in (0, 9) else 0) for i in range(10)] + [("flat", 0, 3)]


def test_stream_of_a_folder_without_files_is_empty(spark, tmp_path):
    from cohortflow.operators import cohort as C
    from cohortflow.session import read_table
    from cohortflow.sources import fixtures as FX
    from cohortflow.streaming.features import feature_state, run_feature_stream

    events = read_table(spark, SMALL, "events")
    derive = lambda ev: C.parse_measurements(FX.lab_rows_from_events(ev))
    got = run_feature_stream(spark, str(tmp_path), events.schema, derive, "admission_no")
    assert got.count() == 0 and got.dtypes == feature_state(derive(events), "admission_no", "panel", "value", "performed_at", "row_id").dtypes


def test_statistics_from_counts_equal_numpy(spark):
    from cohortflow.operators import count_stats as CS
    from cohortflow.operators import eda

    rng = np.random.default_rng(11)
    rows = [(i, int(rng.integers(0, 2)), "hot", float(np.round(rng.normal(1e7, 2), 2))) for i in range(3000)]
    rows += [(i, 0, "few", 1.0) for i in range(2)] + [(9, 1, "few", 5.0), (7, None, "few", 3.0), (8, 0, "few", None), (6, 1, "none", None), (5, 0, "one", 4.0)]
    rows += [(i, 0, "far", float(x)) for i, x in enumerate([1, 2, 2, 3, 100, float("inf")])] + [(20, 1, "far", 2.0)]
    tall = spark.createDataFrame(rows, "row_id long, label int, feature string, value double")
    got = {(r.feature, r.grp): r for r in CS.group_statistics(tall, "label").collect()}
    boxes = {(r.feature, r.grp): r for r in CS.box_statistics(tall, "label").collect()}
    want = {}
    for _, label, feature, value in rows:
        for g in ("All", str(label)):
            if value is not None and g != "None":
                want.setdefault((feature, g), []).append(value)
    assert got.keys() == want.keys() == boxes.keys()
    for key, values in want.items():
        r, b, v = got[key], boxes[key], np.array(values)
        q1, q2, q3 = np.quantile(v, [0.25, 0.5, 0.75], method="linear")
        assert (r.n, r.min, r.max) == (len(v), v.min(), v.max())
        if np.isfinite(v).all():
            assert abs(r.mean - v.mean()) < 1e-9 * max(1, abs(v.mean()))
            assert r.std is None if len(v) == 1 else abs(r.std - v.std(ddof=1)) < 1e-7
        assert np.allclose([r.q1, r.median, r.q3, b.q1, b.median, b.q3], [q1, q2, q3] * 2, rtol=1e-12)
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        assert (b.whisker_lo, b.whisker_hi, b.n_fliers) == (inside.min(), inside.max(), len(v) - len(inside))
    wide = {r.feature: r for r in eda.describe_wide(tall, "label").collect()}
    assert set(wide) == {"hot", "few", "one", "far"} and wide["one"]["1_n"] == 0 and wide["one"]["1_mean"] is None and wide["few"]["All_n"] == 4
    assert CS.group_statistics(tall.limit(0), "label").count() == 0
