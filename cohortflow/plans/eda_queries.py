"""Registered descriptive-statistics and visit-view queries (fixtures A and B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.functions.scalar import recode
from cohortflow.operators import eda, visits
from cohortflow.plans.cohort_queries import RULES, _parsed, entity_features, q_code_flags
from cohortflow.plans.common import round_doubles
from cohortflow.session import is_materialized, materialized
from cohortflow.sources import fixtures as FX

CATEGORICAL = ["flag_urgent", "segment"]
FREQ_COLS = ["segment", "flag_urgent", "label"]
KDE_FEATURES = FX.B_CONTINUOUS
CORR_COLS = FX.B_CONTINUOUS + ["zero_var"]
MISSING_COLS = FX.B_CONTINUOUS + ["flag_urgent", "segment"]
FLAG_COLS = [*RULES.flags.keys(), "target"]
SAMPLE_PER_PANEL = 30
MATRIX_WANT = ["row_id", "segment", "balance", "qty_mean", "price_mean", "not_a_column", "disc_mean", "flag_urgent", "label"]
ID_COLS = ["row_id", "c_name", "label"]


def b_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized(spark, f"fixture-b:{sf_dir}", lambda: FX.customer_features(spark, sf_dir))


def b_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of `b_table` for one reader: kept only where a query has kept them already."""
    kept = is_materialized(spark, f"fixture-b:{sf_dir}")
    return b_table(spark, sf_dir) if kept else FX.customer_features(spark, sf_dir)


def b_tall(spark: SparkSession, sf_dir: str, features=None) -> DataFrame:
    return eda.to_tall(b_table(spark, sf_dir), "row_id", "label", features or FX.B_CONTINUOUS)


def b_tall_cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.to_tall(b_table(spark, sf_dir), "row_id", "label", CATEGORICAL, value_type="string")


def q_dataset_profile(spark, sf_dir):
    return eda.profile(_parsed(spark, sf_dir), "panel", "admission_no", "value", "performed_at")


def q_class_balance(spark, sf_dir):
    return round_doubles(eda.class_balance(b_table(spark, sf_dir), "label"))


def q_freq_table(spark, sf_dir):
    return eda.frequency_table(b_table(spark, sf_dir), FREQ_COLS)


def q_crosstab_margins(spark, sf_dir):
    return eda.crosstab_margins(b_tall_cat(spark, sf_dir), "label")


def q_crosstab_pct(spark, sf_dir):
    return round_doubles(eda.crosstab_pct(b_tall_cat(spark, sf_dir), "label"))


def q_describe_by_group(spark, sf_dir):
    return eda.describe_by_group(b_tall(spark, sf_dir), "label")


def q_describe_wide(spark, sf_dir):
    return eda.describe_wide(b_tall(spark, sf_dir), "label")


def q_missing_ratio(spark, sf_dir):
    return round_doubles(eda.missing_ratio(b_table(spark, sf_dir), MISSING_COLS))


def q_corr_matrix(spark, sf_dir):
    return round_doubles(eda.correlation_matrix(b_table(spark, sf_dir), CORR_COLS))


def q_corr_pairs(spark, sf_dir):
    pairs = eda.correlation_pairs(b_table(spark, sf_dir), CORR_COLS)
    return round_doubles(eda.high_correlation(pairs, 0.9))


def q_histogram(spark, sf_dir):
    return round_doubles(eda.histogram(b_tall(spark, sf_dir), 40))


def q_kde_curve(spark, sf_dir):
    return round_doubles(eda.kde_curve(b_tall(spark, sf_dir, KDE_FEATURES), 1000))


def q_box_stats(spark, sf_dir):
    return round_doubles(eda.box_stats(b_tall(spark, sf_dir), "label"))


def q_flag_prevalence(spark, sf_dir):
    return round_doubles(eda.flag_prevalence(q_code_flags(spark, sf_dir), FLAG_COLS))


def q_present_filter(spark, sf_dir):
    feats = entity_features(spark, sf_dir)
    means = [f"{p}_mean" for p in FX.PANELS]
    return round_doubles(visits.present_filter(feats.select(*FX.PATIENT_KEYS, *means), means, 5))


def visit_table(spark, sf_dir):
    return materialized(spark, f"visits:{sf_dir}", lambda: visits.visit_wide(_parsed(spark, sf_dir), FX.PANELS))


def q_visit_wide(spark, sf_dir):
    """SRT-1: visits ordered by (name, admission, visit day), NULLs last (a range-partitioned sort)."""
    order = [F.col(c).asc_nulls_last() for c in ["patient_name", "admission_no", "visit_date"]]
    return round_doubles(visit_table(spark, sf_dir)).orderBy(*order)


def q_visit_codes(spark, sf_dir):
    return round_doubles(visits.patient_codes_over_visits(visit_table(spark, sf_dir), label_codes=RULES.label_codes))


def q_cohort_sample(spark, sf_dir):
    raw = FX.lab_raw(spark, sf_dir)
    return visits.balanced_sample(raw, SAMPLE_PER_PANEL, label_codes=RULES.label_codes)


def q_recode_flags(spark, sf_dir):
    feats = entity_features(spark, sf_dir).select(*FX.PATIENT_KEYS)
    return feats.select(
        *FX.PATIENT_KEYS,
        recode("sex", {"Nam": 1, "Nữ": 0, "Nu": 0}, default=0).alias("sex_code"),
        recode("sex", {"nam": 1, "nữ": 0, "nu": 0}, default=1, normalize=True).alias("sex_code_store"),
    )


def q_feature_matrix(spark, sf_dir):
    b = b_table(spark, sf_dir)
    keep = [c for c in MATRIX_WANT if c in b.columns]
    return round_doubles(b.select(*keep).drop(*ID_COLS))


QUERIES = {
    "dataset_profile": q_dataset_profile,
    "class_balance": q_class_balance,
    "freq_table": q_freq_table,
    "crosstab_margins": q_crosstab_margins,
    "crosstab_pct": q_crosstab_pct,
    "describe_by_group": q_describe_by_group,
    "describe_wide": q_describe_wide,
    "missing_ratio": q_missing_ratio,
    "corr_matrix": q_corr_matrix,
    "corr_pairs": q_corr_pairs,
    "histogram": q_histogram,
    "kde_curve": q_kde_curve,
    "box_stats": q_box_stats,
    "flag_prevalence": q_flag_prevalence,
    "present_filter": q_present_filter,
    "visit_wide": q_visit_wide,
    "visit_codes": q_visit_codes,
    "cohort_sample": q_cohort_sample,
    "recode_flags": q_recode_flags,
    "feature_matrix": q_feature_matrix,
}

