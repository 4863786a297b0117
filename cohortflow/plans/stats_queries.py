"""Registered hypothesis-test queries over fixture B (labelled customer features)."""

from __future__ import annotations

from cohortflow.operators import eda, stats
from cohortflow.plans.common import round_doubles
from cohortflow.plans.eda_queries import CORR_COLS, b_table, b_tall, b_tall_cat
from cohortflow.sources import fixtures as FX
from cohortflow.sources.sinks import roundtrip_json

CANDIDATES = FX.B_CONTINUOUS + ["flag_urgent", "segment", "zero_var"]


def q_normality_gate(spark, sf_dir):
    return round_doubles(stats.normality_gate(b_tall(spark, sf_dir), "label"))


def q_welch_t(spark, sf_dir):
    return round_doubles(stats.welch_t(b_tall(spark, sf_dir), "label"))


def q_mann_whitney(spark, sf_dir):
    return round_doubles(stats.mann_whitney(b_tall(spark, sf_dir), "label"))


def q_chi_square(spark, sf_dir):
    return round_doubles(stats.chi_square(b_tall_cat(spark, sf_dir), "label"))


def results_table(spark, sf_dir):
    return stats.hypothesis_tests(b_tall(spark, sf_dir), b_tall_cat(spark, sf_dir), "label")


def q_hypothesis_tests(spark, sf_dir):
    return results_table(spark, sf_dir)


def q_top_features(spark, sf_dir):
    return stats.top_features(results_table(spark, sf_dir), 10)


def _zero_var(spark, sf_dir):
    return eda.zero_variance(b_table(spark, sf_dir), CANDIDATES)


def q_feature_select(spark, sf_dir):
    """TRN-1 with the selection persisted as JSON (SNK-3) and read back."""
    return roundtrip_json(stats.feature_select(results_table(spark, sf_dir), _zero_var(spark, sf_dir), CANDIDATES), "selection")


def q_eda_summary(spark, sf_dir):
    pairs = eda.high_correlation(eda.correlation_pairs(b_table(spark, sf_dir), CORR_COLS), 0.9)
    return round_doubles(stats.run_summary(results_table(spark, sf_dir), pairs, _zero_var(spark, sf_dir)))


QUERIES = {
    "normality_gate": q_normality_gate,
    "welch_t": q_welch_t,
    "mann_whitney": q_mann_whitney,
    "chi_square": q_chi_square,
    "hypothesis_tests": q_hypothesis_tests,
    "top_features": q_top_features,
    "feature_select": q_feature_select,
    "eda_summary": q_eda_summary,
}

