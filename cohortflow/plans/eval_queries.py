"""Registered evaluation queries over fixture C (several deterministic scores of fixture B)."""

from __future__ import annotations

from cohortflow.operators import evaluate as EV
from cohortflow.plans.common import round_doubles
from cohortflow.plans.eda_queries import b_table
from cohortflow.sources import fixtures as FX
from cohortflow.sources.sinks import roundtrip_json

MIN_PRECISION = 0.3
MIN_RECALL = 0.5


def scored(spark, sf_dir):
    return FX.scored(spark, sf_dir, b_table(spark, sf_dir))


def q_confusion(spark, sf_dir):
    return EV.confusion(scored(spark, sf_dir))


def q_binary_metrics(spark, sf_dir):
    return round_doubles(EV.binary_metrics(scored(spark, sf_dir)))


def q_class_report(spark, sf_dir):
    return round_doubles(EV.class_report(scored(spark, sf_dir)))


def q_roc_curve(spark, sf_dir):
    return round_doubles(EV.roc_curve(scored(spark, sf_dir)), exclude=("threshold",))


def q_roc_auc(spark, sf_dir):
    return round_doubles(EV.roc_auc(scored(spark, sf_dir)))


def q_calibration(spark, sf_dir):
    return round_doubles(EV.calibration(scored(spark, sf_dir)))


def q_pr_curve(spark, sf_dir):
    return round_doubles(EV.pr_curve(scored(spark, sf_dir)), exclude=("threshold",))


def q_threshold_scan(spark, sf_dir):
    return EV.threshold_scan(EV.pr_curve(scored(spark, sf_dir)), MIN_PRECISION, MIN_RECALL)


def q_score_summary(spark, sf_dir):
    return round_doubles(EV.score_summary(scored(spark, sf_dir)))


def q_risk_topk(spark, sf_dir):
    return EV.risk_topk(scored(spark, sf_dir), 10)


def q_case_select(spark, sf_dir):
    return EV.case_select(scored(spark, sf_dir))


def q_champion(spark, sf_dir):
    """EVL-9 / SRT-8; the comparison (with the champion flag) is persisted as JSON (SNK-3) and read back."""
    return roundtrip_json(round_doubles(EV.model_comparison(scored(spark, sf_dir))), "champion")


QUERIES = {
    "confusion": q_confusion,
    "binary_metrics": q_binary_metrics,
    "class_report": q_class_report,
    "roc_curve": q_roc_curve,
    "roc_auc": q_roc_auc,
    "calibration": q_calibration,
    "pr_curve": q_pr_curve,
    "threshold_scan": q_threshold_scan,
    "score_summary": q_score_summary,
    "risk_topk": q_risk_topk,
    "case_select": q_case_select,
    "champion": q_champion,
}
