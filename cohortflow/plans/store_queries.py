"""Registered store, incremental re-scoring, sink and stream queries (fixtures A / E / F)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.functions.scalar import lenient_double
from cohortflow.operators import cohort as C
from cohortflow.operators import prep as P
from cohortflow.operators import store as S
from cohortflow.plans.cohort_queries import RULES, q_code_flags, q_cohort_select
from cohortflow.plans.common import round_doubles
from cohortflow.plans.eda_queries import q_describe_by_group, visit_table
from cohortflow.plans.prep_queries import MODEL_FEATURES, prepared
from cohortflow.plans.stats_queries import results_table
from cohortflow.session import cut_lineage, materialized, read_table, scratch_path
from cohortflow.sources import fixtures as FX
from cohortflow.sources.exports import export, verify
from cohortflow.sources.sinks import roundtrip_csv, roundtrip_parquet
from cohortflow.sources.store_files import lookup, write_store
from cohortflow.streaming import rescoring as R
from cohortflow.streaming.features import run_feature_stream

STORE_LABS = {"ldl": "view", "hdl": "click", "triglycerid": "purchase"}
STORE_FLAGS = ["diabetes", "dyslipidemia", "ckd"]
CUTOFF = "2024-01-28"
LOADED_AT = "2024-01-28 00:00:00"
BATCH_AT = "2024-02-01 00:00:00"
SCORE_WEIGHTS = {"ldl_mean": 0.6, "ldl_last": 0.3, "hdl_mean": -0.5, "triglycerid_max": 0.4, "age": 0.7, "diabetes": 0.5}
SCORE_CONTINUOUS = ["ldl_mean", "ldl_last", "hdl_mean", "triglycerid_max", "age"]
SCORE_INTERCEPT = -1.0
VISIT_CONTINUOUS = [f"{lab}_{s}" for lab in STORE_LABS for s in ("mean", "max", "min", "std", "last")] + ["age"]
VISIT_BINARY = ["gender", *STORE_FLAGS]


def store_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (patient, visit day): three panels as lab values plus patient-level flags and age."""
    return materialized(spark, f"store-source:{sf_dir}", lambda: _store_source(spark, sf_dir))


def _store_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = visit_table(spark, sf_dir)
    flags = q_code_flags(spark, sf_dir).select(*FX.PATIENT_KEYS, *STORE_FLAGS)
    flags = flags.withColumnsRenamed({k: f"_{k}" for k in FX.PATIENT_KEYS})
    same = F.lit(True)
    for k in FX.PATIENT_KEYS:  # NULL keys meet; visits of entities without flags are kept
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    j = v.join(flags, same, "left")
    return j.select(
        *FX.PATIENT_KEYS,
        "visit_date",
        (F.lit(RULES.reference_year) - lenient_double("birth_year")).cast("int").alias("age"),
        *[F.col(p).alias(lab) for lab, p in STORE_LABS.items()],
        *STORE_FLAGS,
    )


def _load(src: DataFrame, at: str):
    return S.load_store(src, lab_cols=list(STORE_LABS), flag_cols=STORE_FLAGS, reference_year=RULES.reference_year, loaded_at=at)


def existing_and_incoming(spark, sf_dir):
    src = store_source(spark, sf_dir)
    cut = F.lit(CUTOFF).cast("date")
    later = F.coalesce(F.col("visit_date") >= cut, F.lit(False))  # visits without a date are old ones
    ex_p, ex_v = _load(src.filter(~later), LOADED_AT)
    nw_p, nw_v = _load(src.filter(later), BATCH_AT)
    return ex_p, ex_v, nw_p, nw_v


def q_store_load(spark, sf_dir):
    p, v = _load(store_source(spark, sf_dir), LOADED_AT)
    n = v.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n_visits"))
    return p.join(n, p.id == n.patient_id, "left").drop("patient_id")


def q_store_upsert(spark, sf_dir):
    ex_p, ex_v, nw_p, nw_v = existing_and_incoming(spark, sf_dir)
    p, _ = S.upsert(ex_p, ex_v, nw_p, nw_v, STORE_FLAGS, BATCH_AT)
    return p


def q_constraint_check(spark, sf_dir):
    """Checks on the raw visit rows (before dedupe / filters) and on the loaded store (all zero)."""
    src = store_source(spark, sf_dir)
    cohort_ids = q_cohort_select(spark, sf_dir).select(S.surrogate_id("admission_no").alias("id"))
    raw_v = src.select(S.surrogate_id("admission_no").alias("patient_id"), "visit_date", *STORE_LABS)
    raw = (
        S.duplicate_keys(src.withColumnRenamed("admission_no", "patient_code"), "patient_code", "duplicate patient_code")
        .unionByName(S.null_counts(raw_v, ["visit_date", *STORE_LABS], "null visits."))
        .unionByName(S.orphans(raw_v, cohort_ids, "patient_id", "id", "visits outside the cohort"))
        .select(F.lit("raw").alias("table"), "check", "n_violations")
    )
    p, v = _load(src, LOADED_AT)
    return raw.unionByName(S.constraint_violations(p, v, "store"))


def _rescored(spark, sf_dir):
    ex_p, ex_v, nw_p, nw_v = existing_and_incoming(spark, sf_dir)
    affected = nw_v.select("patient_id").distinct()
    history = ex_v.join(affected, "patient_id", "left_semi").unionByName(nw_v)
    feats = S.expanding_features(history).join(nw_v.select("visit_id"), "visit_id", "left_semi")
    feats = feats.join(nw_p.select(F.col("id").alias("patient_id"), "patient_code", "birth_year", *STORE_FLAGS), "patient_id")
    feats = feats.withColumn("age", (F.lit(RULES.reference_year) - F.col("birth_year")).cast("double"))
    # fit cap / scale on each existing patient's latest feature row
    ex_f = S.expanding_features(ex_v)
    latest = ex_f.groupBy("patient_id").agg(F.max_by(F.struct(*ex_f.columns), F.struct("visit_date", "visit_id")).alias("_r"))
    last = latest.select("_r.*").join(ex_p.select(F.col("id").alias("patient_id"), "birth_year"), "patient_id")
    last = last.withColumn("age", (F.lit(RULES.reference_year) - F.col("birth_year")).cast("double")).withColumn("_l", F.lit(0))
    params = P.fit_preprocessor(last, "patient_id", "_l", SCORE_CONTINUOUS, [])
    bounds = {f: (params.lo[f], params.hi[f]) for f in SCORE_CONTINUOUS if f in params.lo}
    scaler = {f: (params.mean[f], params.scale[f]) for f in SCORE_CONTINUOUS}
    scored = S.score_visits(feats, bounds, scaler, SCORE_WEIGHTS, SCORE_INTERCEPT)
    return ex_p, ex_v, nw_p, nw_v, scored


def q_rescore_visits(spark, sf_dir):
    *_, scored = _rescored(spark, sf_dir)
    return round_doubles(scored.select("patient_code", "visit_id", "visit_date", "prediction_prob"))


def with_facts(visits: DataFrame, patients: DataFrame) -> DataFrame:
    """Visit rows with what the model takes of their patient: age, gender and flags."""
    facts = patients.select(F.col("id").alias("patient_id"), (F.lit(RULES.reference_year) - F.col("birth_year")).cast("double").alias("age"),
                            *[F.col(c).cast("double").alias(c) for c in VISIT_BINARY])
    return visits.join(facts, "patient_id")


def labelled_patients(spark, sf_dir, patients: DataFrame, visits: DataFrame) -> DataFrame:
    """One row per stored patient: the features at the last visit, and the label from the patient's codes."""
    feats = S.expanding_features(visits)
    last = feats.groupBy("patient_id").agg(F.max_by(F.struct(*feats.columns), F.struct("visit_date", "visit_id")).alias("_r")).select("_r.*")
    label = q_code_flags(spark, sf_dir).groupBy(S.surrogate_id("admission_no").alias("patient_id")).agg(F.max("target").alias("label"))
    return with_facts(last, patients).join(label, "patient_id", "left")


def q_rescore_stream(spark, sf_dir):
    """INC-3 by the stored model: fitted on the stored patients, saved, made champion, loaded, and applied by a stream to the
    visits that arrive after the cut, in several files."""
    ex_p, ex_v, nw_p, nw_v = existing_and_incoming(spark, sf_dir)
    ex_v = cut_lineage(ex_v)
    store, state, arriving = (scratch_path(spark, f"rescore-{x}") for x in ("store", "state", "arriving"))
    fitted = R.fit_visit_model(labelled_patients(spark, sf_dir, ex_p, ex_v), "patient_id", "label", VISIT_CONTINUOUS, VISIT_BINARY)
    R.publish(spark, store, "v1", "logistic_regression", fitted)
    R.seed(ex_v, state, "patient_id", "visit_id", list(STORE_LABS))
    incoming = with_facts(nw_v.select("patient_id", "visit_id", "visit_date", *STORE_LABS), nw_p)
    incoming.repartitionByRange("visit_date", "visit_id").write.parquet(arriving)
    scores = R.run_visit_stream(spark, arriving, incoming.schema, R.champion(spark, store), state, list(STORE_LABS))
    codes = nw_p.select(F.col("id").alias("patient_id"), "patient_code")
    return round_doubles(scores.join(codes, "patient_id").select("patient_code", "visit_id", "visit_date", "prediction_prob"))


def q_patient_lookup(spark, sf_dir):
    """JN-5: the store in buckets of the id; the patient of the smallest code found by code, that of the largest by id."""
    p, v = _load(store_source(spark, sf_dir), LOADED_AT)
    p = cut_lineage(p)
    path = scratch_path(spark, "store")
    write_store(p, v, path)
    first, last = p.agg(F.min("patient_code"), F.max(F.struct("patient_code", "id"))["id"]).first()
    out = None
    for how, found in (("code", lookup(spark, path, code=first)), ("id", lookup(spark, path, id=last))):
        part = S.visit_history(*found).withColumn("found_by", F.lit(how))
        out = part if out is None else out.unionByName(part)
    return round_doubles(out)


def q_visit_history(spark, sf_dir):
    ex_p, ex_v, nw_p, nw_v, scored = _rescored(spark, sf_dir)
    probs = scored.select("visit_id", F.col("prediction_prob").alias("_p"))
    new_v = nw_v.join(probs, "visit_id", "left").withColumn("prediction_prob", F.col("_p")).drop("_p")
    p, v = S.upsert(ex_p, ex_v, nw_p, new_v, STORE_FLAGS, BATCH_AT)
    return round_doubles(S.visit_history(p, v)).orderBy("patient_code", "visit_rank")


def q_expanding_features(spark, sf_dir):
    _, v = _load(store_source(spark, sf_dir), LOADED_AT)
    return round_doubles(S.expanding_features(v))


def q_sink_roundtrip(spark, sf_dir):
    """SNK-1/2: cohort table written as parquet, read back, written as CSV with header, read back."""
    c = q_cohort_select(spark, sf_dir)
    back = roundtrip_parquet(c, "cohort-parquet")
    return roundtrip_csv(back, "cohort-csv")


def q_export_tables(spark, sf_dir):
    """SNK-2: train and test matrices and the statistics tables as files; per table and column its place, the rows that
    the manifest lists, and whether the files read back agree with it."""
    pr = prepared(spark, sf_dir)
    ready = pr.applied()
    tables = {}
    for part in ("train", "test"):
        rows = ready.filter(F.col("split") == part)
        tables[f"X_{part}"] = (rows, ["row_id", *MODEL_FEATURES], ["row_id"])
        tables[f"y_{part}"] = (rows, ["row_id", "label"], ["row_id"])
    for name, stats, order in (("descriptive", q_describe_by_group(spark, sf_dir), ["feature", "grp"]), ("tests", results_table(spark, sf_dir), ["feature"])):
        tables[name] = (stats, stats.columns, order)
    path = scratch_path(spark, "exports")
    export(spark, tables, path)
    return verify(spark, path).select("table", F.posexplode("columns").alias("position", "column"), "n_rows", "verified")


def q_stream_features(spark, sf_dir):
    """INC-4 on the given events table: the pattern finds one file as well as a folder of files."""
    events = read_table(spark, sf_dir, "events")
    src = os.path.join(sf_dir, "events.parque[t]")

    def derive(ev: DataFrame) -> DataFrame:
        return C.parse_measurements(FX.lab_rows_from_events(ev))

    out = run_feature_stream(spark, src, events.schema, derive, "admission_no")
    return round_doubles(out)


QUERIES = {
    "store_load": q_store_load,
    "store_upsert": q_store_upsert,
    "constraint_check": q_constraint_check,
    "rescore_visits": q_rescore_visits,
    "rescore_stream": q_rescore_stream,
    "patient_lookup": q_patient_lookup,
    "visit_history": q_visit_history,
    "expanding_features": q_expanding_features,
    "sink_roundtrip": q_sink_roundtrip,
    "export_tables": q_export_tables,
    "stream_features": q_stream_features,
}
