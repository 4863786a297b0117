"""Registered explanation queries over fixture D (linear attributions of fixture B) and fixture A bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortflow.operators import evaluate as EV
from cohortflow.operators import explain as X
from cohortflow.plans.cohort_queries import cohort
from cohortflow.plans.common import round_doubles
from cohortflow.plans.eda_queries import b_table
from cohortflow.sources import fixtures as FX

INTERCEPT = -1.5
BINARY_LABELS = {"flag_urgent": ("no urgent finished order", "has an urgent finished order")}
GROUPS = {"qty": "quantity", "price": "price", "disc": "discount", "balance": "balance"}
DISPLAY = {"quantity": ("qty_mean", "qty"), "price": ("price_mean", "price"), "discount": ("disc_mean", "disc"), "balance": ("balance", "balance")}
FLAG_GROUPS = {"flag_urgent": "urgent finished orders on record"}
# stands for the condition that ranks one step below the others
FLAG_SEVERITY = {"flag_urgent": 2}

# Fixture band table for the commentary (metric, op, threshold, severity, label).
FIXTURE_BANDS = [
    ("qty", ">", 30.0, 3, "large average quantity"), ("qty", ">", 27.0, 2, "raised average quantity"),
    ("qty", ">", 25.5, 1, "borderline average quantity"), ("qty", "else", 0.0, 0, "typical average quantity"),
    ("price", ">", 45000.0, 3, "very high average price"), ("price", ">", 40000.0, 2, "high average price"),
    ("price", ">", 36000.0, 1, "borderline average price"), ("price", "else", 0.0, 0, "typical average price"),
    ("disc", ">", 0.06, 3, "deep average discount"), ("disc", ">", 0.055, 2, "raised average discount"),
    ("disc", ">", 0.05, 1, "borderline average discount"), ("disc", "else", 0.0, 0, "typical average discount"),
    ("balance", "<", 0.0, 3, "negative balance"), ("balance", "<", 2000.0, 2, "low balance"),
    ("balance", "<", 5000.0, 1, "moderate balance"), ("balance", "else", 0.0, 0, "comfortable balance"),
]

# Clinical bands (LDL, HDL, triglyceride in mmol/L; age in years) and their severities.
CLINICAL_BANDS = [
    ("ldl", ">", 4.12, 3, "LDL very high"), ("ldl", ">", 3.35, 2, "LDL high"), ("ldl", ">", 2.6, 1, "LDL borderline"),
    ("ldl", "else", 0.0, 0, "LDL well controlled"),
    ("hdl", "<", 1.0, 3, "HDL low"), ("hdl", "<", 1.3, 2, "HDL insufficient"), ("hdl", "<", 1.55, 1, "HDL acceptable"),
    ("hdl", "else", 0.0, 0, "HDL protective"),
    ("triglyceride", ">", 5.65, 3, "triglyceride very high"), ("triglyceride", ">", 2.26, 2, "triglyceride high"),
    ("triglyceride", ">", 1.7, 1, "triglyceride borderline"), ("triglyceride", "else", 0.0, 0, "triglyceride normal"),
    ("age", ">=", 75.0, 3, "age very high"), ("age", ">=", 65.0, 2, "elderly"), ("age", ">=", 45.0, 1, "middle-aged"),
    ("age", "else", 0.0, 0, "age not a main factor"),
]
# fixture A panels standing in for the clinical metrics
BAND_METRICS = {"ldl": "view_last", "hdl": "click_min", "triglyceride": "purchase_min", "age": "age"}


def attr_table(spark, sf_dir):
    return X.linear_attributions(b_table(spark, sf_dir), "row_id", FX.ATTR_WEIGHTS, "label")


def linear_scored(spark, sf_dir):
    s = X.linear_scores(attr_table(spark, sf_dir), "row_id", INTERCEPT, "label")
    return s.select(F.lit("linear").alias("model"), "row_id", "prob", "actual")


def q_attr_linear(spark, sf_dir):
    return round_doubles(attr_table(spark, sf_dir))


def q_attr_global(spark, sf_dir):
    return round_doubles(X.global_importance(attr_table(spark, sf_dir), 2))


def q_attr_direction(spark, sf_dir):
    return round_doubles(X.direction(attr_table(spark, sf_dir)))


def q_attr_dependence(spark, sf_dir):
    attr = attr_table(spark, sf_dir)
    top = X.global_importance(attr, 2).filter(F.col("is_top"))
    return round_doubles(X.dependence(attr, top, 20))


def q_case_explain(spark, sf_dir):
    cases = EV.case_select(linear_scored(spark, sf_dir))
    return round_doubles(X.waterfall(attr_table(spark, sf_dir), cases))


def _risk_rows(spark, sf_dir):
    return EV.risk_topk(linear_scored(spark, sf_dir), 10)


def q_reasons(spark, sf_dir):
    return round_doubles(X.reasons(attr_table(spark, sf_dir), _risk_rows(spark, sf_dir), BINARY_LABELS, 0.05))


def q_group_attr(spark, sf_dir):
    return round_doubles(X.group_attribution(attr_table(spark, sf_dir), _risk_rows(spark, sf_dir), 0.02))


def q_ranked_reasons(spark, sf_dir):
    out = X.ranked_commentary(attr_table(spark, sf_dir), b_table(spark, sf_dir), GROUPS, DISPLAY, FIXTURE_BANDS, FLAG_GROUPS, 5,
                              flag_severity=FLAG_SEVERITY)
    return round_doubles(out)


def q_value_bands(spark, sf_dir):
    c = cohort(spark, sf_dir)
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(col).cast("double").alias("value")) for m, col in BAND_METRICS.items()])
    values = c.select(*FX.PATIENT_KEYS, F.inline(cells))
    return round_doubles(X.apply_bands(values, CLINICAL_BANDS, FX.PATIENT_KEYS))


QUERIES = {
    "attr_linear": q_attr_linear,
    "attr_global": q_attr_global,
    "attr_direction": q_attr_direction,
    "attr_dependence": q_attr_dependence,
    "case_explain": q_case_explain,
    "reasons": q_reasons,
    "group_attr": q_group_attr,
    "ranked_reasons": q_ranked_reasons,
    "value_bands": q_value_bands,
}
