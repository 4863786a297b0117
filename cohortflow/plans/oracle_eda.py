"""DuckDB oracle SQL for the descriptive-statistics and visit-view queries."""

from __future__ import annotations

from cohortflow.functions.pvalues import r6_sql, rdp_sql
from cohortflow.plans import eda_queries as EQ
from cohortflow.plans.common import rounded_sql
from cohortflow.plans.oracle_cohort import KEYS, RULE_TEXT, TARGET_SQL, _q, flag_cols_sql, with_lab
from cohortflow.functions.scalar import any_code_pattern
from cohortflow.sources import fixtures as FX

RULES = FX.FIXTURE_RULES


def tall_sql(src: str, features: list[str], vtype: str = "DOUBLE") -> str:
    return "\nUNION ALL\n".join(
        f"SELECT row_id, label, '{f}' AS feature, CAST({f} AS {vtype}) AS value FROM {src}" for f in features
    )


def with_b(**extra: str) -> str:
    parts = {"fx_b": FX.CUSTOMER_FEATURES_SQL}
    parts.update(extra)
    return FX.cte(**parts)


B_TALL = tall_sql("fx_b", FX.B_CONTINUOUS)
B_GRP = "SELECT *, 'All' AS grp FROM b_tall UNION ALL SELECT *, CAST(label AS VARCHAR) AS grp FROM b_tall"
B_TALL_CAT = tall_sql("fx_b", EQ.CATEGORICAL, "VARCHAR")

# --- dataset_profile -------------------------------------------------------------------------
PROFILE = with_lab("lab_parsed") + """
SELECT panel, count(*) AS n_rows, count(DISTINCT admission_no) AS n_entities, count(value) AS n_values,
       CAST(count(*) FILTER (WHERE value IS NULL) AS BIGINT) AS n_missing,
       min(performed_at) AS first_at, max(performed_at) AS last_at
FROM lab_parsed GROUP BY panel
"""

CLASS_BALANCE = with_b() + f"""
SELECT label, CASE WHEN label = 0 THEN 'No Complication' WHEN label = 1 THEN 'Complication' END AS class_name,
       count(*) AS n, {r6_sql("count(*) / sum(count(*)) OVER ()")} AS share
FROM fx_b GROUP BY label
"""

_FREQ_TALL = "\nUNION ALL\n".join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM fx_b" for c in EQ.FREQ_COLS)
FREQ = with_b(ft=_FREQ_TALL) + f"""
SELECT feature, value, n, {rdp_sql("n * 100.0::double / sum(n) OVER (PARTITION BY feature)", 2)} AS pct
FROM (SELECT feature, value, count(*) AS n FROM ft GROUP BY feature, value) c
"""

MARGINS = with_b(b_cat=B_TALL_CAT) + """
SELECT feature,
       CASE WHEN grouping(value) = 1 THEN 'All' ELSE COALESCE(value, 'NULL') END AS value,
       CASE WHEN grouping(lbl) = 1 THEN 'All' ELSE lbl END AS label,
       count(*) AS n
FROM (SELECT feature, value, CAST(label AS VARCHAR) AS lbl FROM b_cat) t
GROUP BY GROUPING SETS ((feature, value, lbl), (feature, value), (feature, lbl), (feature))
"""

PCT = with_b(
    b_cat=B_TALL_CAT,
    cnt="SELECT feature, COALESCE(value, 'NULL') AS value, label, count(*) AS n FROM b_cat GROUP BY ALL",
    grid="SELECT d.feature, d.value, l.label FROM (SELECT DISTINCT feature, value FROM cnt) d CROSS JOIN (VALUES (0), (1)) l(label)",
    dense="SELECT g.feature, g.value, g.label, COALESCE(c.n, 0) AS n FROM grid g LEFT JOIN cnt c USING (feature, value, label)",
) + rounded_sql(
    """SELECT feature, value, CAST(label AS INTEGER) AS label, CAST(n AS BIGINT) AS n,
       COALESCE(n * 100.0::double / NULLIF(sum(n) OVER (PARTITION BY feature, label), 0), 0.0::double) AS pct_of_label,
       COALESCE(n * 100.0::double / NULLIF(sum(n) OVER (PARTITION BY feature, value), 0), 0.0::double) AS pct_of_value
       FROM dense""",
    ["pct_of_label", "pct_of_value"],
)

DESCRIBE = with_b(b_tall=B_TALL, b_grp=B_GRP) + f"""
SELECT feature, grp, count(*) AS n,
       {rdp_sql("avg(value)", 4)} AS mean,
       {rdp_sql("quantile_cont(value, 0.5)", 4)} AS median,
       {rdp_sql("stddev_samp(value)", 4)} AS std,
       {rdp_sql("min(value)", 4)} AS min,
       {rdp_sql("max(value)", 4)} AS max,
       {rdp_sql("quantile_cont(value, 0.75) - quantile_cont(value, 0.25)", 4)} AS iqr
FROM b_grp WHERE value IS NOT NULL GROUP BY feature, grp
"""

_WIDE = ", ".join(
    f"max({c}) FILTER (WHERE grp = '{g}') AS \"{g}_{c}\"" if c != "n" else f"COALESCE(max(n) FILTER (WHERE grp = '{g}'), 0) AS \"{g}_n\""
    for g in ("All", "0", "1") for c in ("n", "mean", "median", "std", "min", "max", "iqr")
)
DESCRIBE_WIDE = f"SELECT feature, {_WIDE} FROM ({DESCRIBE}) d GROUP BY feature"

MISSING = with_b() + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, {r6_sql(f'avg(CASE WHEN {c} IS NULL THEN 1.0::double ELSE 0.0::double END)')} AS missing_ratio FROM fx_b"
    for c in EQ.MISSING_COLS
)


def _pairs(cols: list[str], diagonal: bool) -> list[tuple[str, str]]:
    out = [(cols[i], cols[j]) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    if diagonal:
        out += [(c, c) for c in cols]
    return out


def _corr_sql(diagonal: bool) -> str:
    pairs = _pairs(EQ.CORR_COLS, diagonal)
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
        am, bm = f"CASE WHEN {both} THEN {a}::double END", f"CASE WHEN {both} THEN {b}::double END"
        aggs.append(f"covar_pop({am}, {bm}) AS c{i}, stddev_pop({am}) * stddev_pop({bm}) AS d{i}")
    one = "SELECT " + ",\n ".join(aggs) + " FROM fx_b"
    rows = "\nUNION ALL\n".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, CASE WHEN d{i} = 0 OR d{i} IS NULL THEN NULL ELSE c{i} / d{i} END AS r FROM cm"
        for i, (a, b) in enumerate(pairs)
    )
    return one, rows


_one_full, _rows_full = _corr_sql(True)
CORR_MATRIX = with_b(cm=_one_full, up=_rows_full) + rounded_sql(
    "SELECT * FROM up UNION ALL SELECT feature_b AS feature_a, feature_a AS feature_b, r FROM up WHERE feature_a <> feature_b",
    ["r"],
)
_one_up, _rows_up = _corr_sql(False)
CORR_PAIRS = with_b(cm=_one_up, up=_rows_up) + rounded_sql(
    """SELECT feature_a, feature_b, r, abs(r) AS abs_r,
              row_number() OVER (ORDER BY abs(r) DESC, feature_a, feature_b) AS rank
       FROM up WHERE abs(r) > 0.9::double""",
    ["r", "abs_r"],
)

HIST = with_b(
    b_tall=B_TALL,
    rng="SELECT feature, min(value) AS lo, max(value) AS hi, count(*) AS total FROM b_tall WHERE value IS NOT NULL GROUP BY feature",
) + rounded_sql(
    """SELECT feature, bin, lo + bin * ((hi - lo) / 40.0::double) AS bin_lo, lo + (bin + 1) * ((hi - lo) / 40.0::double) AS bin_hi, n,
              CASE WHEN (hi - lo) / 40.0::double > 0 THEN n / (total * ((hi - lo) / 40.0::double)) END AS density
       FROM (SELECT r.feature, CAST(i.range AS INTEGER) AS bin, r.lo, r.hi, r.total,
                    count(value) FILTER (WHERE CASE WHEN r.hi > r.lo THEN least(floor((value - r.lo) * 40.0::double / (r.hi - r.lo)), 39) ELSE 0 END = i.range) AS n
             FROM rng r CROSS JOIN range(0, 40) i JOIN b_tall t ON t.feature = r.feature
             WHERE i.range = 0 OR r.hi > r.lo GROUP BY ALL) b""",
    ["bin_lo", "bin_hi", "density"],
)

KDE = with_b(
    kt=tall_sql("fx_b", EQ.KDE_FEATURES),
    st="SELECT feature, min(value) AS lo, max(value) AS hi, count(*) AS n, stddev_samp(value) AS sd FROM kt WHERE value IS NOT NULL GROUP BY feature",
    cells="SELECT feature, value AS centre, count(*) AS c FROM kt WHERE value IS NOT NULL GROUP BY feature, value",
    grid="""SELECT feature, n, pow(n::double, -0.2::double) * sd AS h, lo - 0.5::double * (hi - lo) AS g0,
                   (2.0::double * (hi - lo)) / 999.0::double AS step, CAST(i AS INTEGER) AS i
            FROM st CROSS JOIN range(0, 1000) r(i)""",
) + rounded_sql(
    """SELECT g.feature, g.i, g.g0 + g.i * g.step AS x,
              CASE WHEN g.h > 0 THEN sum(c.c * exp(-0.5::double * pow(((g.g0 + g.i * g.step) - c.centre) / g.h, 2))) / (g.n * g.h * 2.5066282746310002) END AS density
       FROM grid g JOIN cells c USING (feature) GROUP BY g.feature, g.i, g.g0, g.step, g.h, g.n""",
    ["x", "density"],
)

BOX = with_b(
    b_tall=B_TALL,
    b_grp=B_GRP,
    q="""SELECT feature, grp, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
         FROM b_grp WHERE value IS NOT NULL GROUP BY feature, grp""",
    f="SELECT *, q1 - 1.5 * (q3 - q1) AS lo_fence, q3 + 1.5 * (q3 - q1) AS hi_fence FROM q",
) + rounded_sql(
    """SELECT feature, grp, q1, median, q3,
              min(value) FILTER (WHERE value >= lo_fence AND value <= hi_fence) AS whisker_lo,
              max(value) FILTER (WHERE value >= lo_fence AND value <= hi_fence) AS whisker_hi,
              CAST(count(*) FILTER (WHERE NOT (value >= lo_fence AND value <= hi_fence)) AS BIGINT) AS n_fliers
       FROM b_grp JOIN f USING (feature, grp) WHERE value IS NOT NULL
       GROUP BY feature, grp, q1, median, q3, lo_fence, hi_fence""",
    ["q1", "median", "q3", "whisker_lo", "whisker_hi"],
)

_CODE_FLAGS = f"SELECT {KEYS}, icd_inpatient, icd_outpatient, {TARGET_SQL} AS target, {flag_cols_sql()} FROM features"
FLAG_PREV = with_lab("features")[:-1] + f",\ncf AS MATERIALIZED ({_CODE_FLAGS})\n" + "\nUNION ALL\n".join(
    f"SELECT '{f}' AS flag, CAST(sum({f}) AS BIGINT) AS n_positive, {r6_sql(f'avg({f}::double) * 100.0::double')} AS pct_positive FROM cf"
    for f in EQ.FLAG_COLS
)

_MEANS = [f"{p}_mean" for p in FX.PANELS]
PRESENT = with_lab("features") + rounded_sql(
    f"""SELECT {KEYS}, {", ".join(_MEANS)},
               CAST({" AND ".join(f"{m} IS NOT NULL" for m in _MEANS)} AS INTEGER) AS all_present
        FROM features WHERE ({" + ".join(f"CASE WHEN {m} IS NOT NULL THEN 1 ELSE 0 END" for m in _MEANS)}) >= 5""",
    _MEANS,
)

# --- visits ----------------------------------------------------------------------------------
_VKEYS = f"{KEYS}, visit_date"
_VJOIN = " AND ".join(f"v.{k} IS NOT DISTINCT FROM {{a}}.{k}" for k in [*FX.PATIENT_KEYS, "visit_date"])
VISIT_PARTS = {
    "vt": "SELECT *, CAST(performed_at AS DATE) AS visit_date FROM lab_parsed",
    "vcodes": f"""SELECT {_VKEYS}, kind, code, min(row_id) AS first FROM (
                    SELECT {_VKEYS}, row_id, 'icd_inpatient' AS kind, trim(icd_inpatient) AS code FROM vt
                    UNION ALL SELECT {_VKEYS}, row_id, 'icd_outpatient', trim(icd_outpatient) FROM vt) x
                  WHERE code IS NOT NULL AND length(code) > 0 GROUP BY ALL""",
    "vagg": f"SELECT {_VKEYS}, "
    + ", ".join(f"arg_min(value, row_id) FILTER (WHERE panel = '{p}' AND value IS NOT NULL) AS {p}" for p in FX.PANELS)
    + " FROM vt GROUP BY ALL",
    "vci": f"SELECT {_VKEYS}, string_agg(code, ', ' ORDER BY first) AS codes FROM vcodes WHERE kind = 'icd_inpatient' GROUP BY ALL",
    "vco": f"SELECT {_VKEYS}, string_agg(code, ', ' ORDER BY first) AS codes FROM vcodes WHERE kind = 'icd_outpatient' GROUP BY ALL",
    "visits": f"""SELECT v.*, ci.codes AS icd_inpatient, co.codes AS icd_outpatient FROM vagg v
                  LEFT JOIN vci ci ON {_VJOIN.format(a="ci")} LEFT JOIN vco co ON {_VJOIN.format(a="co")}""",
}


def with_visits(**extra: str) -> str:
    head = with_lab("lab_parsed")[:-1]
    parts = dict(VISIT_PARTS)
    parts.update(extra)
    return head + ",\n" + ",\n".join(f"{n} AS MATERIALIZED ({b})" for n, b in parts.items()) + "\n"


VISIT_WIDE = with_visits() + rounded_sql("SELECT * FROM visits", list(FX.PANELS))

VISIT_CODES = with_visits(
    pfirst="""SELECT patient_name, admission_no, kind, s, min((birth_year, sex, visit_date)) AS first FROM (
                SELECT patient_name, admission_no, birth_year, sex, visit_date, 'icd_inpatient' AS kind, icd_inpatient AS s FROM visits
                UNION ALL SELECT patient_name, admission_no, birth_year, sex, visit_date, 'icd_outpatient', icd_outpatient FROM visits) x
              WHERE s IS NOT NULL GROUP BY ALL""",
    pcodes="""SELECT patient_name, admission_no,
                     string_agg(s, ', ' ORDER BY first) FILTER (WHERE kind = 'icd_inpatient') AS icd_inpatient,
                     string_agg(s, ', ' ORDER BY first) FILTER (WHERE kind = 'icd_outpatient') AS icd_outpatient
              FROM pfirst GROUP BY ALL""",
    vj="""SELECT v.* EXCLUDE (icd_inpatient, icd_outpatient), p.icd_inpatient, p.icd_outpatient FROM visits v
          LEFT JOIN pcodes p ON v.patient_name IS NOT DISTINCT FROM p.patient_name AND v.admission_no IS NOT DISTINCT FROM p.admission_no""",
) + rounded_sql(f"SELECT *, {TARGET_SQL} AS target FROM vj", list(FX.PANELS))

_N = EQ.SAMPLE_PER_PANEL
SAMPLE = FX.cte(
    lab_raw=FX.LAB_RAW_SQL,
    ent=f"""SELECT panel, patient_name, max(CAST(regexp_matches({RULE_TEXT}, '{_q(any_code_pattern(RULES.label_codes))}') AS INTEGER)) AS tgt
            FROM lab_raw GROUP BY panel, patient_name""",
    sizes="SELECT panel, count(*) FILTER (WHERE tgt = 1) AS n_pos, count(*) FILTER (WHERE tgt = 0) AS n_neg FROM ent GROUP BY panel",
    takes=f"""SELECT panel, CASE WHEN a + b < {_N} THEN least(n_pos, {_N} - b) ELSE a END AS take_pos, b AS take_neg
              FROM (SELECT panel, n_pos, a, least(n_neg, {_N} - a) AS b FROM (SELECT panel, n_pos, n_neg, least(n_pos, {_N // 2}) AS a FROM sizes) s1) s2""",
    ranked="SELECT *, row_number() OVER (PARTITION BY panel, tgt ORDER BY patient_name) AS rn FROM ent",
    chosen="""SELECT r.panel, r.patient_name, r.tgt FROM ranked r JOIN takes t USING (panel)
              WHERE rn <= CASE WHEN tgt = 1 THEN take_pos ELSE take_neg END""",
) + "SELECT l.*, c.tgt FROM lab_raw l JOIN chosen c USING (panel, patient_name)"

RECODE = with_lab("features") + f"""
SELECT {KEYS},
       CASE WHEN sex = 'Nam' THEN 1 WHEN sex = 'Nữ' THEN 0 WHEN sex = 'Nu' THEN 0 ELSE 0 END AS sex_code,
       CASE WHEN lower(trim(sex)) = 'nam' THEN 1 WHEN lower(trim(sex)) = 'nữ' THEN 0 WHEN lower(trim(sex)) = 'nu' THEN 0 ELSE 1 END AS sex_code_store
FROM features
"""

MATRIX = with_b() + rounded_sql(
    "SELECT segment, balance, qty_mean, price_mean, disc_mean, flag_urgent FROM fx_b", ["balance", "qty_mean", "price_mean", "disc_mean"]
)

ORACLE = {
    "dataset_profile": PROFILE,
    "class_balance": CLASS_BALANCE,
    "freq_table": FREQ,
    "crosstab_margins": MARGINS,
    "crosstab_pct": PCT,
    "describe_by_group": DESCRIBE,
    "describe_wide": DESCRIBE_WIDE,
    "missing_ratio": MISSING,
    "corr_matrix": CORR_MATRIX,
    "corr_pairs": CORR_PAIRS,
    "histogram": HIST,
    "kde_curve": KDE,
    "box_stats": BOX,
    "flag_prevalence": FLAG_PREV,
    "present_filter": PRESENT,
    "visit_wide": VISIT_WIDE,
    "visit_codes": VISIT_CODES,
    "cohort_sample": SAMPLE,
    "recode_flags": RECODE,
    "feature_matrix": MATRIX,
}

