"""Published numbers re-derived with our operators (contingency tests, confusion-derived metrics, champion)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortflow.operators import evaluate as EV
from cohortflow.operators import stats as ST

# Published 2x2 tables (value -> (label 1 count, label 0 count)) and their chi-square results.
PUBLISHED_TABLES = {
    "sex": ({0: (179, 4328), 1: (455, 7393)}, 19.2361, 0.000012),
    "diabetes": ({0: (492, 8161), 1: (142, 3560)}, 17.8522, 0.000024),
    "dyslipidemia": ({0: (585, 9887), 1: (49, 1834)}, 28.5843, 0.0),
    "ckd": ({0: (587, 11174), 1: (47, 547)}, 9.3218, 0.002264),
    "cad": ({0: (633, 11708), 1: (1, 13)}, 0.0, 1.0),
}


def test_chi_square_with_yates_matches_published(spark):
    rows = []
    for feat, (table, _, _) in PUBLISHED_TABLES.items():
        for value, (pos, neg) in table.items():
            rows += [(feat, str(value), 1, pos), (feat, str(value), 0, neg)]
    counts = spark.createDataFrame(rows, "feature string, value string, label int, n long")
    got = {r["feature"]: r for r in ST.chi_square_counts(counts, "label").collect()}
    for feat, (_, chi2, p) in PUBLISHED_TABLES.items():
        assert got[feat]["dof"] == 1
        assert round(got[feat]["chi2"], 4) == pytest.approx(chi2, abs=1e-4), feat
        assert got[feat]["p_value"] == pytest.approx(p, abs=2e-6), feat


def test_yates_clamp_when_expected_is_within_half_of_observed(spark):
    # expected - observed = 0.25 in every cell: the correction moves each cell onto its expectation -> chi2 = 0
    counts = spark.createDataFrame(
        [("f", "a", 1, 1), ("f", "a", 0, 1), ("f", "b", 1, 1), ("f", "b", 0, 2)], "feature string, value string, label int, n long"
    )
    r = ST.chi_square_counts(counts, "label").first()
    assert r["chi2"] == pytest.approx(0.0, abs=1e-12)
    assert r["p_value"] == pytest.approx(1.0, abs=1e-6)


# Confusion cells implied by the published metrics (test set 2,344 / 127) and those metrics.
PUBLISHED_CELLS = {
    "XGBoost": ((32, 218, 95, 2126), (0.8733, 0.128, 0.252, 0.1698)),
    "Logistic Regression": ((66, 709, 61, 1635), (0.6884, 0.0852, 0.5197, 0.1463)),
    "Random Forest": ((35, 374, 92, 1970), (0.8114, 0.0856, 0.2756, 0.1306)),
}


def _scored_from_cells(spark):
    rows = []
    rid = 0
    for model, ((tp, fp, fn, tn), _) in PUBLISHED_CELLS.items():
        for actual, prob, n in ((1, 0.9, tp), (0, 0.9, fp), (1, 0.1, fn), (0, 0.1, tn)):
            for _ in range(n):
                rows.append((model, rid, prob, actual))
                rid += 1
    return spark.createDataFrame(rows, "model string, row_id long, prob double, actual int")


def test_metrics_reproduce_published_table(spark):
    m = {r["model"]: r for r in EV.binary_metrics(_scored_from_cells(spark)).collect()}
    for model, (_, (acc, prec, rec, f1)) in PUBLISHED_CELLS.items():
        assert round(m[model]["accuracy"], 4) == pytest.approx(acc, abs=1e-4)
        assert round(m[model]["precision"], 4) == pytest.approx(prec, abs=1e-4)
        assert round(m[model]["recall"], 4) == pytest.approx(rec, abs=1e-4)
        assert round(m[model]["f1"], 4) == pytest.approx(f1, abs=1e-4)


def test_champion_is_best_f1(spark):
    comp = EV.model_comparison(_scored_from_cells(spark))
    best = comp.filter(F.col("is_champion")).select("model").first()[0]
    assert best == "XGBoost"


def test_confusion_grid_is_dense(spark):
    s = spark.createDataFrame([("m", 1, 0.9, 1), ("m", 2, 0.8, 1)], "model string, row_id long, prob double, actual int")
    cells = {(r["actual"], r["pred"]): r["n"] for r in EV.confusion(s).collect()}
    assert cells == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 2}


def test_student_t_tail_matches_closed_forms(spark):
    import math

    import duckdb

    from cohortflow.functions.pvalues import student_t_two_sided, student_t_two_sided_sql

    # df = 1 (Cauchy) and df = 2 have closed forms; df = 10 is the tabulated 0.0733880348
    cases = [(1.0, 1.0, 0.5), (2.0, 2.0, 1 - 2 / math.sqrt(6)), (2.0, 10.0, 0.0733880348), (0.0, 5.0, 1.0)]
    df = spark.createDataFrame([(t, d) for t, d, _ in cases], "t double, df double")
    got = [r[0] for r in df.select(student_t_two_sided(F.col("t"), F.col("df"))).collect()]
    con = duckdb.connect()
    for (t, d, want), g in zip(cases, got):
        assert g == pytest.approx(want, abs=1e-10)
        s = con.execute(f"SELECT {student_t_two_sided_sql(f'{t}::double', f'{d}::double')}").fetchone()[0]
        assert s == pytest.approx(g, abs=1e-13)


def test_chi_square_tail_matches_closed_forms(spark):
    import math

    from cohortflow.functions.pvalues import chi2_sf

    # dof 1: erfc(sqrt(x/2)); dof 2: exp(-x/2); dof 4: exp(-x/2) (1 + x/2)
    cases = [(19.2361, 1, math.erfc(math.sqrt(19.2361 / 2))), (3.0, 2, math.exp(-1.5)), (7.5, 4, math.exp(-3.75) * 4.75)]
    df = spark.createDataFrame([(x, k) for x, k, _ in cases], "x double, dof int")
    got = [r[0] for r in df.select(chi2_sf(F.col("x"), F.col("dof"))).collect()]
    for (_, _, want), g in zip(cases, got):
        assert g == pytest.approx(want, rel=1e-12)


def test_tails_at_many_degrees_of_freedom(spark):
    import math

    import duckdb

    from cohortflow.functions.pvalues import chi2_sf, chi2_sf_sql, student_t_two_sided, student_t_two_sided_sql

    # t: the normal tail and its first correction phi(t) (t^3 + t) / (2 df); the next is of order 1 / df^2
    def t_tail(t, d):
        return math.erfc(t / math.sqrt(2)) + math.exp(-t * t / 2) / math.sqrt(2 * math.pi) * (t**3 + t) / (2 * d)

    # chi-square with even dof: the Poisson sum
    def chi(x, k):
        return math.fsum(math.exp(-x / 2 + j * math.log(x / 2) - math.lgamma(j + 1)) for j in range(k // 2))

    con = duckdb.connect()
    ts = [(2.0, 1e5), (0.3, 1e5), (4.0, 1e8), (1.5, 1e8)]
    got = [r[0] for r in spark.createDataFrame(ts, "t double, df double").select(student_t_two_sided(F.col("t"), F.col("df"))).collect()]
    for (t, d), g in zip(ts, got):
        assert g == pytest.approx(t_tail(t, d), abs=1e-9 if d < 1e6 else 1e-12)
        assert con.execute(f"SELECT {student_t_two_sided_sql(f'{t}::double', f'{d}::double')}").fetchone()[0] == pytest.approx(g, abs=1e-12)
    xs = [(5000.0, 5000), (5200.0, 5000), (4800.0, 5000), (1.2, 2000)]
    got = [r[0] for r in spark.createDataFrame(xs, "x double, dof int").select(chi2_sf(F.col("x"), F.col("dof"))).collect()]
    for (x, k), g in zip(xs, got):
        assert g == pytest.approx(chi(x, k), abs=1e-10)
        assert con.execute(f"SELECT {chi2_sf_sql(f'{x}::double', str(k))}").fetchone()[0] == pytest.approx(g, abs=1e-11)
