"""DuckDB oracle SQL for the fixture-A queries (same derivations written independently in SQL)."""

from __future__ import annotations

from cohortflow.functions.scalar import NUMERIC_PATTERN, any_code_pattern, word_flag_pattern
from cohortflow.plans.common import rounded_sql
from cohortflow.sources import fixtures as FX

RULES = FX.FIXTURE_RULES
KEYS = ", ".join(FX.PATIENT_KEYS)
KEYS_JOIN = " AND ".join(f"f.{k} IS NOT DISTINCT FROM c.{k}" for k in FX.PATIENT_KEYS)


def _q(s: str) -> str:
    return s.replace("'", "''")


PARSED = f"""
SELECT row_id, patient_name, admission_no, birth_year, sex, performed_at, panel, result,
       icd_inpatient, icd_outpatient,
       CASE WHEN regexp_matches(trim(result), '{_q(NUMERIC_PATTERN)}') THEN TRY_CAST(trim(result) AS DOUBLE) END AS value
FROM lab_raw
"""

BOUNDS = """
SELECT panel, q1, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
FROM (SELECT panel, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
      FROM lab_parsed WHERE value IS NOT NULL GROUP BY panel) q
"""

CLEANED = """
SELECT p.* REPLACE (CASE WHEN p.value < b.lo OR p.value > b.hi THEN NULL ELSE p.value END AS value),
       COALESCE(p.value < b.lo OR p.value > b.hi, false) AS is_outlier
FROM lab_parsed p LEFT JOIN lab_bounds b USING (panel)
"""

WINDOWED = f"""
SELECT * FROM lab_clean
WHERE performed_at IS NOT NULL
  AND performed_at >= TIMESTAMP '{RULES.start}' AND performed_at <= TIMESTAMP '{RULES.end}'
"""


def _code_list(kind: str) -> str:
    return f"""
SELECT {KEYS}, string_agg(code, ', ' ORDER BY first_ts, first_rid) AS {kind}
FROM (SELECT {KEYS}, trim({kind}) AS code, min(performed_at) AS first_ts,
             arg_min(row_id, (performed_at, row_id)) AS first_rid
      FROM lab_win WHERE {kind} IS NOT NULL GROUP BY {KEYS}, trim({kind})) x
GROUP BY {KEYS}
"""


def _panel_aggs() -> str:
    parts = []
    for p in FX.PANELS:
        f = f"FILTER (WHERE panel = '{p}')"
        parts += [
            f"avg(value) {f} AS {p}_mean",
            f"max(value) {f} AS {p}_max",
            f"min(value) {f} AS {p}_min",
            f"stddev_samp(value) {f} AS {p}_std",
            f"arg_max(value, (performed_at, row_id)) FILTER (WHERE panel = '{p}' AND value IS NOT NULL) AS {p}_last",
        ]
    return ",\n       ".join(parts)


FEATURES = f"""
SELECT f.* REPLACE ({", ".join(f"CASE WHEN f.{p}_mean IS NOT NULL AND f.{p}_std IS NULL THEN 0.0::double ELSE f.{p}_std END AS {p}_std" for p in FX.PANELS)}),
       ci.icd_inpatient, co.icd_outpatient
FROM (SELECT {KEYS},
       {_panel_aggs()},
       min(performed_at) AS first_at, max(performed_at) AS last_at
      FROM lab_win GROUP BY {KEYS}) f
LEFT JOIN codes_in ci ON {KEYS_JOIN.replace("c.", "ci.")}
LEFT JOIN codes_out co ON {KEYS_JOIN.replace("c.", "co.")}
"""

RULE_TEXT = "concat_ws(' ', COALESCE(icd_inpatient, 'None'), COALESCE(icd_outpatient, 'None'))"
FLAG_TEXT = "concat_ws(' ', COALESCE(icd_inpatient, ''), COALESCE(icd_outpatient, ''))"


def flag_cols_sql() -> str:
    return ", ".join(
        f"CAST(regexp_matches({FLAG_TEXT}, '{_q(word_flag_pattern(core))}') AS INTEGER) AS {name}"
        for name, core in RULES.flags.items()
    )


TARGET_SQL = f"CAST(regexp_matches({RULE_TEXT}, '{_q(any_code_pattern(RULES.label_codes))}') AS INTEGER)"

COHORT = f"""
SELECT * EXCLUDE (first_at, last_at),
       {TARGET_SQL} AS target,
       {flag_cols_sql()}
FROM (SELECT *, CAST(trunc({RULES.reference_year} - TRY_CAST(birth_year AS DOUBLE)) AS INTEGER) AS age FROM features) a
WHERE age >= {RULES.min_age}
  AND datesub('day', first_at, last_at) >= {RULES.min_followup_days}
  AND regexp_matches({RULE_TEXT}, '{_q(RULES.include)}')
  AND NOT regexp_matches({RULE_TEXT}, '{_q(RULES.exclude)}')
"""


def lab_parts(upto: str = "features") -> dict[str, str]:
    """The fixture-A CTE chain up to (and including) ``upto``."""
    parts = [
        ("lab_raw", FX.LAB_RAW_SQL),
        ("lab_parsed", PARSED),
        ("lab_bounds", BOUNDS),
        ("lab_clean", CLEANED),
        ("lab_win", WINDOWED),
        ("codes_in", _code_list("icd_inpatient")),
        ("codes_out", _code_list("icd_outpatient")),
        ("features", FEATURES),
        ("cohort", COHORT),
    ]
    names = [n for n, _ in parts]
    stop = names.index(upto) + 1
    return dict(parts[:stop])


def with_lab(upto: str = "features") -> str:
    return FX.cte(**lab_parts(upto))


FEATURE_DOUBLES = [f"{p}_{s}" for p in FX.PANELS for s in FX.B_STATS]

UNION_SQL = with_lab("lab_raw") + "SELECT * FROM lab_raw"

ORACLE = {
    "panel_union": UNION_SQL,
    "lenient_cast": with_lab("lab_parsed") + "SELECT row_id, panel, result, value, performed_at FROM lab_parsed",
    "iqr_nullout": with_lab("lab_clean")
    + rounded_sql(
        """SELECT b.*, c.n_rows, c.n_outliers FROM lab_bounds b JOIN
           (SELECT panel, count(*) AS n_rows, CAST(count(*) FILTER (WHERE is_outlier) AS BIGINT) AS n_outliers
            FROM lab_clean GROUP BY panel) c USING (panel)""",
        ["q1", "q3", "lo", "hi"],
    ),
    "patient_features": with_lab("features") + rounded_sql("SELECT * FROM features", FEATURE_DOUBLES),
    "code_rollup": with_lab("features") + f"SELECT {KEYS}, icd_inpatient, icd_outpatient FROM features",
    "cohort_select": with_lab("cohort") + rounded_sql("SELECT * FROM cohort", FEATURE_DOUBLES),
    "code_flags": with_lab("features")
    + f"SELECT {KEYS}, icd_inpatient, icd_outpatient, {TARGET_SQL} AS target, {flag_cols_sql()} FROM features",
}
