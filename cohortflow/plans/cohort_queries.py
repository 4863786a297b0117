"""Registered queries over fixture A (panels -> entity rows -> cohort)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortflow.operators import cohort as C
from cohortflow.plans.common import round_doubles
from cohortflow.session import materialized, scratch_path
from cohortflow.sources import fixtures as FX
from cohortflow.sources.panels import panel_path, stored_panels, write_panels

RULES = FX.FIXTURE_RULES


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_panels(spark, sf_dir, "lab-parsed", ["events"], lambda: C.parse_measurements(FX.lab_raw(spark, sf_dir)))


def _windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds from whole panels in a first pass; in the second the time range is filtered by the reader."""
    parsed = _parsed(spark, sf_dir)
    return C.iqr_nullout(C.time_window(parsed, "performed_at", RULES.start, RULES.end), bounds=C.iqr_bounds(parsed))


def entity_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized(
        spark, f"entities:{sf_dir}", lambda: C.entity_rollup(_windowed(spark, sf_dir), panels=FX.PANELS)
    )


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.apply_cohort_rules(entity_features(spark, sf_dir), RULES)


def q_panel_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-1..3 / SET-1: the panels are stored in one pass over the source, a folder each, and read as sources of their
    own with their own header spellings; one listed source does not exist.  The readable ones are harmonised and
    unioned by name."""
    base = scratch_path(spark, "panels")
    write_panels(FX.lab_raw(spark, sf_dir), base)
    paths = {name: panel_path(base, name) for name in [*FX.PANELS, "absent_panel"]}  # the last is unreadable: skipped
    sheets = {name: df.withColumnsRenamed(FX.PANEL_HEADER_VARIANTS[name]) for name, df in C.read_panels(spark, paths).items()}
    return C.union_panels(sheets, FX.HEADER_SYNONYMS)


def q_lenient_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("row_id", "panel", "result", "value", "performed_at")


def q_iqr_nullout(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _parsed(spark, sf_dir)
    bounds = C.iqr_bounds(parsed)
    flagged = C.iqr_nullout(parsed, bounds=bounds)
    counts = C.outlier_counts(flagged)
    return round_doubles(bounds.join(counts, "panel"))


def q_patient_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(entity_features(spark, sf_dir))


def q_code_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = entity_features(spark, sf_dir)
    return feats.select(*FX.PATIENT_KEYS, *FX.CODE_COLS)


def q_cohort_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(cohort(spark, sf_dir))


def q_code_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = entity_features(spark, sf_dir).select(*FX.PATIENT_KEYS, *FX.CODE_COLS)
    from cohortflow.functions.scalar import any_code_pattern, rule_text

    labelled = feats.withColumn(
        "target", rule_text(*FX.CODE_COLS, "None").rlike(any_code_pattern(RULES.label_codes)).cast("int")
    )
    return C.code_flags(labelled, RULES.flags)


QUERIES = {
    "panel_union": q_panel_union,
    "lenient_cast": q_lenient_cast,
    "iqr_nullout": q_iqr_nullout,
    "patient_features": q_patient_features,
    "code_rollup": q_code_rollup,
    "cohort_select": q_cohort_select,
    "code_flags": q_code_flags,
}

