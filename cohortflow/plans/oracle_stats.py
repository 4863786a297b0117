"""DuckDB oracle SQL for the hypothesis-test queries (raw moments written out; DuckDB's own skewness and
kurtosis are bias-corrected, Spark's are population moments)."""

from __future__ import annotations

from cohortflow.functions.pvalues import chi2_sf_sql, normal_two_sided_sql, rdp_sql, student_t_two_sided_sql
from cohortflow.plans.oracle_eda import B_TALL, B_TALL_CAT, _corr_sql
from cohortflow.plans.common import rounded_sql
from cohortflow.plans.stats_queries import CANDIDATES
from cohortflow.sources import fixtures as FX

GATE_PARTS = {
    "g_per": "SELECT feature, label, count(*) AS n, avg(value) AS m FROM b_tall WHERE value IS NOT NULL AND label IS NOT NULL GROUP BY ALL",
    "g_mom": """SELECT t.feature, t.label, p.n, avg(pow(t.value - p.m, 2)) AS m2, avg(pow(t.value - p.m, 3)) AS m3, avg(pow(t.value - p.m, 4)) AS m4
                FROM b_tall t JOIN g_per p USING (feature, label) WHERE t.value IS NOT NULL GROUP BY t.feature, t.label, p.n""",
    "g_jb": """SELECT feature, label, n,
                      exp(-(n / 6.0::double * (s * s + k * k / 4.0::double)) / 2.0::double) AS jb_p
               FROM (SELECT feature, label, n,
                            CASE WHEN m2 = 0 THEN NULL ELSE m3 / pow(m2, 1.5) END AS s,
                            CASE WHEN m2 = 0 THEN NULL ELSE m4 / (m2 * m2) - 3.0::double END AS k FROM g_mom) x""",
    "gate": """SELECT feature, COALESCE(n0, 0) AS n0, COALESCE(n1, 0) AS n1, jb_p0, jb_p1,
                      COALESCE(jb_p0 > 0.05 AND jb_p1 > 0.05, false) AS normal,
                      COALESCE(n0, 0) >= 8 AND COALESCE(n1, 0) >= 8 AS tested
               FROM (SELECT feature, max(n) FILTER (WHERE label = 0) AS n0, max(n) FILTER (WHERE label = 1) AS n1,
                            max(jb_p) FILTER (WHERE label = 0) AS jb_p0, max(jb_p) FILTER (WHERE label = 1) AS jb_p1
                     FROM g_jb GROUP BY feature) w""",
}

_A = "(sd0 * sd0 / n0)"
_B = "(sd1 * sd1 / n1)"
WELCH_PARTS = {
    "w_per": """SELECT feature, count(value) FILTER (WHERE label = 0) AS n0, count(value) FILTER (WHERE label = 1) AS n1,
                       avg(value) FILTER (WHERE label = 0) AS mean0, avg(value) FILTER (WHERE label = 1) AS mean1,
                       stddev_samp(value) FILTER (WHERE label = 0) AS sd0, stddev_samp(value) FILTER (WHERE label = 1) AS sd1
                FROM b_tall WHERE value IS NOT NULL AND label IS NOT NULL GROUP BY feature""",
    "w_t": f"""SELECT *, CASE WHEN sqrt({_A} + {_B}) = 0 THEN NULL ELSE (mean0 - mean1) / sqrt({_A} + {_B}) END AS t_stat,
                      CASE WHEN ({_A} * {_A} / (n0 - 1) + {_B} * {_B} / (n1 - 1)) = 0 THEN NULL
                           ELSE (({_A} + {_B}) * ({_A} + {_B})) / ({_A} * {_A} / (n0 - 1) + {_B} * {_B} / (n1 - 1)) END AS df
               FROM w_per""",
    "welch": f"SELECT *, {student_t_two_sided_sql('t_stat', 'df')} AS p_value FROM w_t",
}

_N = "(n0::double + n1::double)"
_VAR = f"(n0::double * n1::double / 12.0::double * (({_N} + 1.0::double) - tie_sum / ({_N} * ({_N} - 1.0::double))))"
_Z = f"(CASE WHEN sqrt({_VAR}) = 0 THEN NULL ELSE (greatest(u0, n0::double * n1::double - u0) - n0::double * n1::double / 2.0::double - 0.5::double) / sqrt({_VAR}) END)"
MWU_PARTS = {
    "m_cnt": """SELECT feature, value, count(*) FILTER (WHERE label = 0) AS c0, count(*) FILTER (WHERE label = 1) AS c1
                FROM b_tall WHERE value IS NOT NULL AND label IS NOT NULL GROUP BY feature, value""",
    "m_pre": """SELECT *, COALESCE(sum(c1) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c1_before
                FROM m_cnt""",
    "m_per": """SELECT feature, sum(c0 * (c1_before + c1 / 2.0::double)) AS u0, CAST(sum(c0) AS BIGINT) AS n0, CAST(sum(c1) AS BIGINT) AS n1,
                       sum(pow((c0 + c1)::double, 3) - (c0 + c1)) AS tie_sum FROM m_pre GROUP BY feature""",
    "mwu": f"SELECT feature, n0, n1, u0, {_Z} AS z, COALESCE({normal_two_sided_sql(_Z)}, 1.0::double) AS p_value FROM m_per",
}

CHI_PARTS = {
    "c_obs": "SELECT feature, value, label, count(*)::double AS o FROM b_cat WHERE value IS NOT NULL AND label IS NOT NULL GROUP BY ALL",
    "c_grid": """SELECT v.feature, v.value, l.label FROM (SELECT DISTINCT feature, value FROM c_obs) v
                 JOIN (SELECT DISTINCT feature, label FROM c_obs) l USING (feature)""",
    "c_dense": "SELECT g.feature, g.value, g.label, COALESCE(o.o, 0.0::double) AS o FROM c_grid g LEFT JOIN c_obs o USING (feature, value, label)",
    "c_cells": """SELECT *, (count(DISTINCT value) OVER (PARTITION BY feature) - 1) * (count(DISTINCT label) OVER (PARTITION BY feature) - 1) AS dof,
                         sum(o) OVER (PARTITION BY feature, value) * sum(o) OVER (PARTITION BY feature, label) / sum(o) OVER (PARTITION BY feature) AS e
                  FROM c_dense""",
    "c_adj": """SELECT *, CASE WHEN dof = 1 THEN o + sign(e - o) * least(0.5::double, abs(e - o)) ELSE o END AS oa FROM c_cells""",
    "chi": f"""SELECT feature, CAST(dof AS INTEGER) AS dof, CASE WHEN dof = 0 THEN 0.0::double ELSE chi2 END AS chi2,
                      CASE WHEN dof = 0 THEN 1.0::double ELSE {chi2_sf_sql('chi2', 'dof')} END AS p_value
               FROM (SELECT feature, dof, sum(pow(oa - e, 2) / e) AS chi2 FROM c_adj GROUP BY feature, dof) x""",
}

RESULT_PARTS = {
    "means": """SELECT feature, avg(value) FILTER (WHERE label = 0) AS mean_group0, avg(value) FILTER (WHERE label = 1) AS mean_group1,
                       quantile_cont(value, 0.5) FILTER (WHERE label = 0) AS median_group0, quantile_cont(value, 0.5) FILTER (WHERE label = 1) AS median_group1
                FROM b_tall WHERE value IS NOT NULL AND label IS NOT NULL GROUP BY feature""",
    "cont": """SELECT g.feature, 'Continuous' AS type, g.normal,
                      CASE WHEN g.normal THEN 'Welch t-test' ELSE 'Mann-Whitney U' END AS test,
                      CASE WHEN g.normal THEN w.t_stat ELSE m.u0 END AS statistic,
                      CASE WHEN g.normal THEN w.p_value ELSE m.p_value END AS p_value,
                      mean_group0, mean_group1, median_group0, median_group1
               FROM gate g JOIN welch w USING (feature) JOIN mwu m USING (feature) JOIN means USING (feature)
               WHERE g.tested""",
    "allt": """SELECT * FROM cont UNION ALL
               SELECT feature, 'Categorical', NULL::boolean, 'Chi-square', chi2, p_value, NULL::double, NULL::double, NULL::double, NULL::double FROM chi""",
    "results": f"""SELECT feature, type, normal, test, {rdp_sql('statistic', 4)} AS statistic, {rdp_sql('p_value', 6)} AS p_value,
                          p_value < 0.05 AS significant,
                          {rdp_sql('mean_group0', 4)} AS mean_group0, {rdp_sql('mean_group1', 4)} AS mean_group1,
                          {rdp_sql('median_group0', 4)} AS median_group0, {rdp_sql('median_group1', 4)} AS median_group1,
                          {rdp_sql('-log10(greatest(p_value, 1e-300))', 4)} AS neg_log10_p
                   FROM allt""",
}


def with_tests(*groups: dict, **extra: str) -> str:
    parts = {"fx_b": FX.CUSTOMER_FEATURES_SQL, "b_tall": B_TALL, "b_cat": B_TALL_CAT}
    for g in groups:
        parts.update(g)
    parts.update(extra)
    return FX.cte(**parts)


_ALL = (GATE_PARTS, WELCH_PARTS, MWU_PARTS, CHI_PARTS, RESULT_PARTS)
_CANDS = ", ".join(f"('{c}')" for c in CANDIDATES)
_ZV = "\nUNION ALL\n".join(f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_distinct FROM fx_b" for c in CANDIDATES)
_one_up, _rows_up = _corr_sql(False)

ORACLE = {
    "normality_gate": with_tests(GATE_PARTS) + rounded_sql("SELECT * FROM gate", ["jb_p0", "jb_p1"]),
    "welch_t": with_tests(WELCH_PARTS) + rounded_sql("SELECT * FROM welch", ["mean0", "mean1", "sd0", "sd1", "t_stat", "df", "p_value"]),
    "mann_whitney": with_tests(MWU_PARTS) + rounded_sql("SELECT * FROM mwu", ["u0", "z", "p_value"]),
    "chi_square": with_tests(CHI_PARTS) + rounded_sql("SELECT * FROM chi", ["chi2", "p_value"]),
    "hypothesis_tests": with_tests(*_ALL) + "SELECT * FROM results",
    "top_features": with_tests(*_ALL)
    + """SELECT rank, feature, replace(regexp_replace(feature, '_(mean|max|min|std|last)$', ' (\\1)'), '_', ' ') AS display_name,
                test, statistic, p_value
         FROM (SELECT *, row_number() OVER (ORDER BY p_value, feature) AS rank FROM results WHERE significant) r WHERE rank <= 10""",
    "feature_select": with_tests(*_ALL, zv=_ZV)
    + f"""SELECT c.feature, r.p_value, COALESCE(z.n_distinct <= 1, false) AS zero_variance,
                 CASE WHEN COALESCE(z.n_distinct <= 1, false) THEN NULL WHEN r.p_value IS NULL THEN NULL
                      WHEN r.p_value >= 0.05 THEN NULL ELSE 1 END IS NOT NULL AS keep,
                 CASE WHEN COALESCE(z.n_distinct <= 1, false) THEN 'zero variance' WHEN r.p_value IS NULL THEN 'not tested'
                      WHEN r.p_value >= 0.05 THEN 'p=' || printf('%.6f', r.p_value) END AS reason
          FROM (VALUES {_CANDS}) c(feature) LEFT JOIN results r USING (feature) LEFT JOIN zv z USING (feature)""",
    "eda_summary": with_tests(*_ALL, zv=_ZV, cm=_one_up, up=_rows_up)
    + rounded_sql(
        """SELECT t.n_tested, t.n_significant, h.n_high_corr_pairs, z.n_zero_variance,
                  CASE WHEN t.n_tested = 0 THEN NULL ELSE t.n_significant::double / t.n_tested::double END AS share_significant
           FROM (SELECT count(*) AS n_tested, CAST(count(*) FILTER (WHERE significant) AS BIGINT) AS n_significant FROM results) t,
                (SELECT count(*) AS n_high_corr_pairs FROM up WHERE abs(r) > 0.9::double) h,
                (SELECT CAST(count(*) FILTER (WHERE n_distinct <= 1) AS BIGINT) AS n_zero_variance FROM zv) z""",
        ["share_significant"],
    ),
}

