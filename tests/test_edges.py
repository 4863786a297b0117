"""Hand-built edge cases: lenient casts, NULL keys, single-row groups, constant columns, ties, empty panels."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortflow.functions.scalar import clip_keep_null, lenient_double
from cohortflow.operators import cohort as C
from cohortflow.operators import eda, visits
from cohortflow.sources.fixtures import FIXTURE_RULES


def test_lenient_double(spark):
    df = spark.createDataFrame([("NaN",), ("1e3d",), (" 5.2 ",), ("<0.3",), ("1e3",), (None,), ("-.5",)], "t string")
    got = [r[0] for r in df.select(lenient_double("t")).collect()]
    assert got == [None, None, 5.2, None, 1000.0, None, -0.5]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (5.0,), (-3.0,)], "x double")
    assert [r[0] for r in df.select(clip_keep_null("x", 0.0, 1.0)).collect()] == [None, 1.0, 0.0]


def _tall(spark, rows):
    schema = (
        "patient_name string, admission_no string, birth_year string, sex string, performed_at timestamp_ntz, "
        "panel string, value double, icd_inpatient string, icd_outpatient string, row_id long"
    )
    return spark.createDataFrame(rows, schema)


def test_rollup_last_single_std_null_keys_and_codes(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [
        # NULL entity key forms its own group
        (None, "1", "1980", "Nam", t0, "a", 1.0, " I10 ", None, 1),
        (None, "1", "1980", "Nam", t0 + dt.timedelta(days=1), "a", 3.0, "I10", None, 2),
        # ties on the timestamp: the larger row id is the later row; NULL value is skipped by 'last'
        ("p", "2", "1990", "Nu", t0, "a", 5.0, "E11", "N18", 3),
        ("p", "2", "1990", "Nu", t0, "a", 7.0, None, "E11", 4),
        ("p", "2", "1990", "Nu", t0 + dt.timedelta(days=2), "a", None, None, None, 5),
        ("p", "2", "1990", "Nu", t0, "b", 9.0, None, None, 6),
    ]
    out = {r["patient_name"]: r for r in C.entity_rollup(_tall(spark, rows), panels=["a", "b"]).collect()}
    assert out[None]["a_mean"] == 2.0 and out[None]["icd_inpatient"] == "I10"
    assert out["p"]["a_last"] == 7.0
    assert out["p"]["b_std"] == 0.0  # one measurement -> 0, not NULL
    assert out["p"]["icd_outpatient"] == "N18, E11"  # first-seen order
    assert out[None]["b_mean"] is None and out[None]["b_std"] is None  # no measurement -> stays NULL


def test_code_rules_unanchored_label_and_word_bounded_flags(spark):
    df = spark.createDataFrame(
        [("xI10 I500", "e11.9"), ("I10", "C22"), ("I13", None)], "icd_inpatient string, icd_outpatient string"
    )
    df = df.withColumns({"first_at": F.lit(dt.datetime(2024, 1, 1)), "last_at": F.lit(dt.datetime(2024, 3, 1)),
                         "birth_year": F.lit("1950")})
    out = C.apply_cohort_rules(df, FIXTURE_RULES).collect()
    assert len(out) == 2  # the C22 row is excluded
    by_in = {r["icd_inpatient"]: r for r in out}
    assert by_in["xI10 I500"]["target"] == 1  # I500 contains I50 (unanchored)
    assert by_in["xI10 I500"]["diabetes"] == 1  # e11.9, case-insensitive with sub-code
    assert by_in["I13"]["target"] == 0


def test_iqr_bounds_from_whole_panel_and_empty_panel(spark):
    df = spark.createDataFrame(
        [("a", float(v)) for v in [1, 2, 3, 4, 100]] + [("empty", None)], "panel string, value double"
    )
    b = {r["panel"]: r for r in C.iqr_bounds(df).collect()}
    assert set(b) == {"a"}
    assert (b["a"]["q1"], b["a"]["q3"]) == (2.0, 4.0)
    out = C.iqr_nullout(df).collect()
    assert sum(1 for r in out if r["is_outlier"]) == 1
    assert [r["value"] for r in out if r["panel"] == "empty"] == [None]


def test_harmonize_backfills_missing_result(spark):
    df = spark.createDataFrame([("x",)], "`Inpatient ICD` string")
    h = C.harmonize(df, {"Inpatient ICD": "icd_inpatient"})
    assert "icd_inpatient" in h.columns and "result" in h.columns
    assert h.first()["result"] is None


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 1.0), (None, 1.0)], "a double, b double")
    r = eda.correlation_pairs(df, ["a", "b"]).first()
    assert r["r"] is None


def test_present_filter(spark):
    df = spark.createDataFrame([(1.0, None, None), (1.0, 2.0, None), (1.0, 2.0, 3.0)], "a double, b double, c double")
    out = visits.present_filter(df, ["a", "b", "c"], 2).collect()
    assert [r["all_present"] for r in out] == [0, 1]


@pytest.mark.parametrize("method", ["exact", "approx"])
def test_quantiles_methods_agree_on_small_groups(spark, method):
    from cohortflow.operators.quantiles import quantiles_wide

    df = spark.createDataFrame([("g", float(v)) for v in range(1, 11)], "g string, v double")
    r = quantiles_wide(df, ["g"], "v", {"q1": 0.25, "q3": 0.75}, method).first()
    if method == "exact":
        assert (r["q1"], r["q3"]) == (3.25, 7.75)
    else:
        assert 2.0 <= r["q1"] <= 4.0 and 7.0 <= r["q3"] <= 8.0
