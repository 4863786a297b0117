"""DuckDB oracle SQL for the store, incremental re-scoring, sink and stream queries."""

from __future__ import annotations

from cohortflow.plans.common import rounded_sql
from cohortflow.plans.oracle_cohort import FEATURE_DOUBLES, KEYS, flag_cols_sql, lab_parts
from cohortflow.plans.oracle_eda import DESCRIBE, VISIT_PARTS
from cohortflow.plans.oracle_prep import SPLIT
from cohortflow.plans.oracle_stats import ORACLE as STAT_ORACLE
from cohortflow.plans.prep_queries import MODEL_FEATURES
from cohortflow.plans.store_queries import (
    BATCH_AT,
    CUTOFF,
    LOADED_AT,
    SCORE_CONTINUOUS,
    SCORE_INTERCEPT,
    SCORE_WEIGHTS,
    STORE_FLAGS,
    STORE_LABS,
)
from cohortflow.sources import fixtures as FX

RY = FX.FIXTURE_RULES.reference_year
LABS = list(STORE_LABS)


def _sid(*cols: str) -> str:
    return "md5(concat_ws('|', " + ", ".join(f"COALESCE(CAST({c} AS VARCHAR), '<null>')" for c in cols) + "))"


def _base() -> dict[str, str]:
    parts = lab_parts("cohort")
    parts.update(VISIT_PARTS)
    parts["cf"] = f"SELECT {KEYS}, {flag_cols_sql()} FROM features"
    parts["src"] = f"""SELECT v.patient_name, v.admission_no, v.birth_year, v.sex, v.visit_date,
                              CAST(trunc({RY} - TRY_CAST(v.birth_year AS DOUBLE)) AS INTEGER) AS age,
                              {", ".join(f"v.{p} AS {lab}" for lab, p in STORE_LABS.items())},
                              {", ".join(f"cf.{f}" for f in STORE_FLAGS)}
                       FROM visits v LEFT JOIN cf ON {" AND ".join(f"v.{k} IS NOT DISTINCT FROM cf.{k}" for k in FX.PATIENT_KEYS)}"""
    return parts


def _load(prefix: str, where: str, at: str) -> dict[str, str]:
    ts = f"TIMESTAMP '{at}'"
    return {
        f"{prefix}_s": f"""SELECT * REPLACE (COALESCE(visit_date, DATE '1970-01-01') AS visit_date) FROM src
                             WHERE admission_no IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in LABS)} AND ({where})""",
        f"{prefix}_first": f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY admission_no
                                   ORDER BY patient_name, admission_no, birth_year, sex, visit_date) AS rn FROM {prefix}_s) x WHERE rn = 1""",
        f"{prefix}_p": f"""SELECT {_sid('admission_no')} AS id, CAST(admission_no AS VARCHAR) AS patient_code,
                                  COALESCE(patient_name, '') AS name, COALESCE(CAST({RY} - age AS INTEGER), 1900) AS birth_year,
                                  CASE WHEN lower(trim(sex)) = 'nam' THEN 1 WHEN lower(trim(sex)) = 'nữ' THEN 0 ELSE 1 END AS gender,
                                  {", ".join(f"COALESCE(CAST({f} AS INTEGER), 0) AS {f}" for f in STORE_FLAGS)},
                                  {ts} AS created_at, {ts} AS updated_at
                           FROM {prefix}_first""",
        f"{prefix}_v": f"""SELECT {_sid(*(f"s.{c}" for c in ("patient_name", "admission_no", "birth_year", "sex")), "strftime(s.visit_date, '%Y-%m-%d')")} AS visit_id,
                                  p.id AS patient_id, s.visit_date,
                                  {", ".join(f"CAST(s.{c} AS DOUBLE) AS {c}" for c in LABS)},
                                  NULL::double AS prediction_prob, {ts} AS created_at
                           FROM {prefix}_s s JOIN {prefix}_p p ON CAST(s.admission_no AS VARCHAR) = p.patient_code""",
    }


def _expanding(src: str) -> str:
    cols = []
    for c in LABS:
        cols += [
            f"avg({c}) OVER w AS {c}_mean",
            f"max({c}) OVER w AS {c}_max",
            f"min({c}) OVER w AS {c}_min",
            f"CASE WHEN count({c}) OVER w = 1 THEN 0.0::double ELSE stddev_samp({c}) OVER w END AS {c}_std",
            f"{c} AS {c}_last",
        ]
    return (
        f"SELECT patient_id, visit_id, visit_date, {', '.join(cols)} FROM {src} "
        "WINDOW w AS (PARTITION BY patient_id ORDER BY visit_date, visit_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )


EXP_DOUBLES = [f"{c}_{s}" for c in LABS for s in ("mean", "max", "min", "std", "last")]


def _with(*dicts: dict[str, str], **extra: str) -> str:
    parts: dict[str, str] = {}
    for d in dicts:
        parts.update(d)
    parts.update(extra)
    return FX.cte(**parts)


ALL = _load("all", "true", LOADED_AT)
EX = _load("ex", f"visit_date IS NULL OR visit_date < DATE '{CUTOFF}'", LOADED_AT)
NW = _load("nw", f"visit_date >= DATE '{CUTOFF}'", BATCH_AT)

UPSERT = {
    "ins": "SELECT *, 'inserted' AS status FROM nw_p WHERE patient_code NOT IN (SELECT patient_code FROM ex_p)",
    "upd": f"""SELECT e.id, e.patient_code, e.name, e.birth_year, e.gender, e.created_at,
                      {", ".join(f"COALESCE(n.{f}, e.{f}) AS {f}" for f in STORE_FLAGS)},
                      CASE WHEN n.{STORE_FLAGS[0]} IS NOT NULL THEN TIMESTAMP '{BATCH_AT}' ELSE e.updated_at END AS updated_at,
                      CASE WHEN n.{STORE_FLAGS[0]} IS NOT NULL THEN 'updated' ELSE 'unchanged' END AS status
               FROM ex_p e LEFT JOIN nw_p n ON e.patient_code = n.patient_code""",
    "up_p": f"""SELECT id, patient_code, name, birth_year, gender, created_at, {", ".join(STORE_FLAGS)}, updated_at, status FROM upd
                UNION ALL SELECT id, patient_code, name, birth_year, gender, created_at, {", ".join(STORE_FLAGS)}, updated_at, status FROM ins""",
}


def _cap_scale() -> dict[str, str]:
    q = ", ".join(
        f"quantile_cont({f}, 0.25) - 1.5 * (quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25)) AS lo_{f}, "
        f"quantile_cont({f}, 0.75) + 1.5 * (quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25)) AS hi_{f}"
        for f in SCORE_CONTINUOUS
    )
    capped = ", ".join(f"CASE WHEN {f} IS NULL THEN NULL ELSE least(greatest({f}, lo_{f}), hi_{f}) END AS {f}" for f in SCORE_CONTINUOUS)
    ms = ", ".join(
        f"avg({f}) AS mean_{f}, CASE WHEN stddev_pop({f}) IS NULL OR stddev_pop({f}) = 0 THEN 1.0::double ELSE stddev_pop({f}) END AS scale_{f}"
        for f in SCORE_CONTINUOUS
    )
    terms = []
    for f, w in SCORE_WEIGHTS.items():
        x = f"CAST({f} AS DOUBLE)"
        if f in SCORE_CONTINUOUS:
            x = f"((CASE WHEN {x} IS NULL THEN NULL ELSE least(greatest({x}, lo_{f}), hi_{f}) END - mean_{f}) / scale_{f})"
        terms.append(f"{w!r}::double * {x}")
    z = " + ".join(terms)
    return {
        "hist": "SELECT * FROM ex_v WHERE patient_id IN (SELECT patient_id FROM nw_v) UNION ALL SELECT * FROM nw_v",
        "hf": _expanding("hist"),
        "feats": f"""SELECT hf.*, n.patient_code, n.birth_year, {", ".join(f"n.{f}" for f in STORE_FLAGS)},
                            CAST({RY} - n.birth_year AS DOUBLE) AS age
                     FROM hf JOIN nw_p n ON hf.patient_id = n.id WHERE hf.visit_id IN (SELECT visit_id FROM nw_v)""",
        "exf": _expanding("ex_v"),
        "last": f"""SELECT l.*, CAST({RY} - p.birth_year AS DOUBLE) AS age FROM (
                      SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY visit_date DESC, visit_id DESC) AS rn FROM exf) x
                      WHERE rn = 1) l JOIN ex_p p ON l.patient_id = p.id""",
        "pq": f"SELECT {q} FROM last",
        "lastc": f"SELECT {capped} FROM last, pq",
        "pm": f"SELECT {ms} FROM lastc",
        "scored": f"""SELECT patient_code, visit_id, visit_date,
                             1.0::double / (1.0::double + exp(-({SCORE_INTERCEPT!r}::double + {z}))) AS prediction_prob
                      FROM feats, pq, pm""",
    }


RESCORE = _cap_scale()

_PCT = "printf('%.1f%%', floor(prediction_prob * 100.0::double * 10.0::double + 0.5) / 10.0::double)"


def _checks_store() -> str:
    rows = [
        "SELECT 'duplicate patient_code' AS \"check\", CAST(COALESCE(sum(CASE WHEN n > 1 THEN n - 1 END), 0) AS BIGINT) AS n_violations "
        "FROM (SELECT patient_code, count(*) AS n FROM all_p GROUP BY 1) d",
        "SELECT 'duplicate visit_id', count(*) - count(DISTINCT visit_id) FROM all_v",
    ]
    rows += [f"SELECT 'null patients.{c}', CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) FROM all_p" for c in ("patient_code", "name", "birth_year", "gender")]
    rows += [f"SELECT 'null visits.{c}', CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) FROM all_v" for c in ("patient_id", "visit_date", *LABS)]
    rows += ["SELECT 'orphan visits', count(*) FROM all_v v WHERE NOT EXISTS (SELECT 1 FROM all_p p WHERE p.id = v.patient_id)"]
    return "SELECT 'store' AS \"table\", * FROM (" + " UNION ALL ".join(rows) + ") s"


def _checks_raw() -> str:
    rows = [
        "SELECT 'duplicate patient_code' AS \"check\", CAST(COALESCE(sum(CASE WHEN n > 1 THEN n - 1 END), 0) AS BIGINT) AS n_violations "
        "FROM (SELECT admission_no, count(*) AS n FROM src GROUP BY 1) d"
    ]
    rows += [f"SELECT 'null visits.{c}', CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) FROM src" for c in ("visit_date", *LABS)]
    rows += [
        f"SELECT 'visits outside the cohort', count(*) FROM src s WHERE NOT EXISTS (SELECT 1 FROM cohort c "
        f"WHERE {_sid('c.admission_no')} = {_sid('s.admission_no')})"
    ]
    return "SELECT 'raw' AS \"table\", * FROM (" + " UNION ALL ".join(rows) + ") r"


_EXPORTED = {f"{k}_{part}": (["row_id", *cols], f"SELECT count(*) FROM split WHERE split = '{part}'")
             for part in ("train", "test") for k, cols in (("X", MODEL_FEATURES), ("y", ["label"]))}
_EXPORTED["descriptive"] = (["feature", "grp", "n", "mean", "median", "std", "min", "max", "iqr"], f"SELECT count(*) FROM ({DESCRIBE}) d")
STAT_COLUMNS = ["feature", "type", "normal", "test", "statistic", "p_value", "significant", "mean_group0", "mean_group1", "median_group0", "median_group1", "neg_log10_p"]
_EXPORTED["tests"] = (STAT_COLUMNS, f"SELECT count(*) FROM ({STAT_ORACLE['hypothesis_tests']}) h")

ORACLE = {
    "export_tables": FX.cte(**SPLIT)
    + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", CAST(i AS INTEGER) AS position, c AS \"column\", ({n}) AS n_rows, true AS verified "
                         f"FROM (VALUES {', '.join(f'({i}, {c!r})' for i, c in enumerate(cols))}) x(i, c)" for t, (cols, n) in _EXPORTED.items()),
    "store_load": _with(_base(), ALL)
    + "SELECT p.*, n.n_visits FROM all_p p LEFT JOIN (SELECT patient_id, count(*) AS n_visits FROM all_v GROUP BY 1) n ON p.id = n.patient_id",
    "store_upsert": _with(_base(), EX, NW, UPSERT) + "SELECT * FROM up_p",
    "constraint_check": _with(_base(), ALL) + _checks_raw() + " UNION ALL " + _checks_store(),
    "rescore_visits": _with(_base(), EX, NW, RESCORE) + rounded_sql("SELECT * FROM scored", ["prediction_prob"]),
    "visit_history": _with(
        _base(), EX, NW, UPSERT, RESCORE,
        nv2="SELECT v.* REPLACE (s.prediction_prob AS prediction_prob) FROM nw_v v LEFT JOIN scored s USING (visit_id)",
        up_v="SELECT * FROM ex_v UNION ALL SELECT * FROM nv2 WHERE visit_id NOT IN (SELECT visit_id FROM ex_v)",
    )
    + rounded_sql(
        f"""SELECT p.patient_code, row_number() OVER (PARTITION BY p.patient_code ORDER BY v.visit_date, v.visit_id) AS visit_rank,
                   strftime(v.visit_date, '%Y-%m-%d') AS visit_date, v.ldl, v.hdl, v.triglycerid,
                   CASE WHEN v.prediction_prob IS NULL THEN '-' ELSE {_PCT} END AS prob_text
            FROM up_v v JOIN up_p p ON v.patient_id = p.id""",
        LABS,
    ),
    "patient_lookup": _with(_base(), ALL)
    + rounded_sql(
        f"""SELECT p.patient_code, row_number() OVER (PARTITION BY w.found_by ORDER BY v.visit_date, v.visit_id) AS visit_rank,
                   strftime(v.visit_date, '%Y-%m-%d') AS visit_date, v.ldl, v.hdl, v.triglycerid, '-' AS prob_text, w.found_by
            FROM (SELECT min(patient_code) AS patient_code, 'code' AS found_by FROM all_p
                  UNION ALL SELECT max(patient_code), 'id' FROM all_p) w
            JOIN all_p p ON p.patient_code = w.patient_code JOIN all_v v ON v.patient_id = p.id""",
        LABS,
    ),
    "expanding_features": _with(_base(), ALL, ef=_expanding("all_v")) + rounded_sql("SELECT * FROM ef", EXP_DOUBLES),
    "sink_roundtrip": _with(lab_parts("cohort")) + rounded_sql("SELECT * FROM cohort", FEATURE_DOUBLES),
    "stream_features": _with(lab_parts("lab_parsed"))
    + rounded_sql(
        """SELECT admission_no, panel, count(*) AS n_rows, count(value) AS n_values, avg(value) AS mean,
                  stddev_samp(value) AS std, min(value) AS "min", max(value) AS "max",
                  arg_max(value, (performed_at, row_id)) FILTER (WHERE value IS NOT NULL) AS "last"
           FROM lab_parsed GROUP BY admission_no, panel""",
        ["mean", "std", "min", "max", "last"],
    ),
}
