"""DuckDB oracle SQL for the explanation queries."""

from __future__ import annotations

from cohortflow.plans.common import rounded_sql
from cohortflow.plans.explain_queries import (
    BAND_METRICS,
    BINARY_LABELS,
    CLINICAL_BANDS,
    DISPLAY,
    FIXTURE_BANDS,
    FLAG_GROUPS,
    GROUPS,
    INTERCEPT,
)
from cohortflow.plans.oracle_cohort import KEYS, with_lab
from cohortflow.operators.explain import Z_BANDS, Z_FLOOR_LABEL
from cohortflow.sources import fixtures as FX

W = FX.ATTR_WEIGHTS


def _q(s: str) -> str:
    return s.replace("'", "''")


ATTR = {
    "fx_b": FX.CUSTOMER_FEATURES_SQL,
    "st": "SELECT " + ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in W) + " FROM fx_b",
    "attr0": "\nUNION ALL\n".join(
        f"""SELECT row_id, label, '{f}' AS feature, CAST({f} AS DOUBLE) AS value,
                   CASE WHEN s_{f} = 0 THEN NULL ELSE (CAST({f} AS DOUBLE) - m_{f}) / s_{f} END AS z, {w!r}::double AS w
            FROM fx_b, st WHERE {f} IS NOT NULL"""
        for f, w in W.items()
    ),
    "attr": "SELECT row_id, label, feature, value, z, w * z AS contribution FROM attr0",
    "sc": f"""SELECT 'linear' AS model, row_id, 1.0::double / (1.0::double + exp(-({INTERCEPT!r}::double + sum(contribution)))) AS prob, label AS actual
              FROM attr GROUP BY row_id, label""",
}
GLOBAL = dict(ATTR)
GLOBAL["gi"] = """SELECT feature, mean_abs, row_number() OVER (ORDER BY mean_abs DESC, feature) AS rank
                  FROM (SELECT feature, avg(abs(contribution)) AS mean_abs FROM attr GROUP BY feature) g"""

RISK = dict(ATTR)
RISK["rows"] = """SELECT * FROM (
           SELECT model, row_id, prob, actual, list, tag,
                  row_number() OVER (PARTITION BY model, list ORDER BY CASE WHEN tag IN ('TP', 'TN') THEN 0 ELSE 1 END,
                                     CASE WHEN list = 'high' THEN -prob ELSE prob END, row_id) AS rank
           FROM (SELECT *, CASE WHEN prob >= 0.5 THEN 'high' WHEN prob < 0.5 THEN 'low' END AS list,
                        CASE WHEN prob >= 0.5 AND actual = 1 THEN 'TP' WHEN prob >= 0.5 AND actual = 0 THEN 'FP'
                             WHEN prob < 0.5 AND actual = 0 THEN 'TN' ELSE 'FN' END AS tag
                 FROM sc) t) r WHERE rank <= 10"""

_Z = "CASE " + " ".join(f"WHEN z > {t!r}::double THEN '{_q(lbl)}'" for t, lbl in Z_BANDS) + f" ELSE '{_q(Z_FLOOR_LABEL)}' END"
_DESC = (
    "CASE "
    + " ".join(
        f"WHEN feature = '{f}' THEN (CASE WHEN round(value) >= 1 THEN '{_q(yes)}' ELSE '{_q(no)}' END)"
        for f, (no, yes) in BINARY_LABELS.items()
    )
    + f" ELSE {_Z} END"
)


def _bands_sql(rows) -> str:
    vals = ", ".join(f"('{m}', '{op}', {t!r}::double, {s}, '{_q(lbl)}')" for m, op, t, s, lbl in rows)
    return f"SELECT * FROM (VALUES {vals}) b(metric, op, threshold, severity, label)"


def _apply_bands(values: str, bands: str, keys: str) -> str:
    return f"""SELECT {keys}, metric, value, max(severity) AS severity, arg_max(label, severity) AS label
               FROM (SELECT *, row_number() OVER () AS line FROM {values} x) v JOIN {bands} b USING (metric)
               WHERE value IS NOT NULL AND ((op = '>' AND value > threshold) OR (op = '<' AND value < threshold)
                     OR (op = '>=' AND value >= threshold) OR op = 'else')
               GROUP BY {keys}, metric, value, line"""


_GRP = (
    "CASE "
    + " ".join(f"WHEN starts_with(feature, '{p}') THEN '{g}'" for p, g in GROUPS.items())
    + " "
    + " ".join(f"WHEN feature = '{f}' THEN '{f}'" for f in FLAG_GROUPS)
    + " END"
)
COMMENT = dict(ATTR)
COMMENT["bands"] = _bands_sql(FIXTURE_BANDS)
COMMENT["rep"] = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id, grp ORDER BY abs(contribution) DESC, feature) AS r
                     FROM (SELECT *, {_GRP} AS grp FROM attr) a WHERE grp IS NOT NULL) x WHERE r = 1"""
COMMENT["disp"] = "\nUNION ALL\n".join(
    [f"SELECT row_id, '{g}' AS grp, '{m}' AS metric, CAST({c} AS DOUBLE) AS value FROM fx_b" for g, (c, m) in DISPLAY.items()]
    + [f"SELECT row_id, '{f}', '{f}', CAST({f} AS DOUBLE) FROM fx_b" for f in FLAG_GROUPS]
)
_FLAG_TEXT = "CASE " + " ".join(f"WHEN grp = '{f}' THEN '{_q(t)}'" for f, t in FLAG_GROUPS.items()) + " END"
COMMENT["banded"] = _apply_bands(
    f"(SELECT * FROM disp WHERE grp NOT IN ({', '.join(repr(f) for f in FLAG_GROUPS)}))", "bands", "row_id, grp"
)
COMMENT["lines"] = f"""SELECT * FROM banded UNION ALL
    SELECT row_id, grp, metric, value, 2 AS severity, {_FLAG_TEXT} AS label FROM disp
    WHERE grp IN ({', '.join(repr(f) for f in FLAG_GROUPS)}) AND value = 1"""

_BAND_VALUES = "\nUNION ALL\n".join(f"SELECT {KEYS}, '{m}' AS metric, CAST({c} AS DOUBLE) AS value FROM cohort" for m, c in BAND_METRICS.items())

ORACLE = {
    "attr_linear": FX.cte(**ATTR) + rounded_sql("SELECT * FROM attr", ["value", "z", "contribution"]),
    "attr_global": FX.cte(**GLOBAL) + rounded_sql("SELECT feature, mean_abs, rank, rank <= 2 AS is_top FROM gi", ["mean_abs"]),
    "attr_direction": FX.cte(**ATTR)
    + rounded_sql(
        """SELECT feature, CASE WHEN d = 0 OR d IS NULL THEN NULL ELSE c / d END AS r FROM (
             SELECT feature, covar_pop(a, b) AS c, stddev_pop(a) * stddev_pop(b) AS d FROM (
               SELECT feature, CASE WHEN value IS NOT NULL AND contribution IS NOT NULL THEN value END AS a,
                      CASE WHEN value IS NOT NULL AND contribution IS NOT NULL THEN contribution END AS b FROM attr) x
             GROUP BY feature) y""",
        ["r"],
    ),
    "attr_dependence": FX.cte(**GLOBAL)
    + rounded_sql(
        """SELECT feature, bin, count(*) AS n, avg(value) AS mean_value, avg(contribution) AS mean_contribution,
                  min(contribution) AS min_contribution, max(contribution) AS max_contribution
           FROM (SELECT a.*, CAST(CASE WHEN hi > lo THEN least(floor((value - lo) * 20.0::double / (hi - lo)), 19) ELSE 0 END AS INTEGER) AS bin
                 FROM attr a JOIN (SELECT feature, min(value) AS lo, max(value) AS hi FROM attr
                                   WHERE feature IN (SELECT feature FROM gi WHERE rank <= 2) GROUP BY feature) r USING (feature)) b
           GROUP BY feature, bin""",
        ["mean_value", "mean_contribution", "min_contribution", "max_contribution"],
    ),
    "case_explain": FX.cte(
        **ATTR,
        cases="""SELECT 'high_risk' AS "case", min(row_id) AS row_id FROM sc WHERE prob > 0.8 AND actual = 1 GROUP BY model
                 UNION ALL SELECT 'low_risk', min(row_id) FROM sc WHERE prob < 0.1 AND actual = 0 GROUP BY model
                 UNION ALL SELECT 'false_negative', min(row_id) FROM sc WHERE prob < 0.3 AND actual = 1 GROUP BY model""",
    )
    + rounded_sql(
        """SELECT c."case", a.row_id, a.feature, a.value, a.contribution,
                  row_number() OVER w AS step,
                  sum(a.contribution) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative
           FROM attr a JOIN cases c USING (row_id)
           WINDOW w AS (PARTITION BY c."case", a.row_id ORDER BY abs(a.contribution) DESC, a.feature)""",
        ["value", "contribution", "cumulative"],
    ),
    "reasons": FX.cte(**RISK)
    + rounded_sql(
        f"""SELECT list, row_id, direction,
                   row_number() OVER (PARTITION BY row_id, direction ORDER BY CASE WHEN direction = 'raises' THEN -contribution ELSE contribution END, feature) AS rank,
                   feature, contribution, {_DESC} AS description
            FROM (SELECT a.*, r.list, CASE WHEN a.contribution > 0 THEN 'raises' ELSE 'lowers' END AS direction
                  FROM attr a JOIN rows r USING (row_id) WHERE abs(a.contribution) >= 0.05::double) x""",
        ["contribution"],
    ),
    "group_attr": FX.cte(**RISK)
    + rounded_sql(
        """SELECT list, feature, mean_contribution,
                  row_number() OVER (PARTITION BY list ORDER BY CASE WHEN list = 'high' THEN -mean_contribution ELSE mean_contribution END, feature) AS rank
           FROM (SELECT r.list, a.feature, avg(a.contribution) AS mean_contribution FROM attr a JOIN rows r USING (row_id) GROUP BY ALL) g
           WHERE (list = 'high' AND mean_contribution > 0.02::double) OR (list = 'low' AND mean_contribution < -0.02::double)""",
        ["mean_contribution"],
    ),
    "ranked_reasons": FX.cte(**COMMENT)
    + rounded_sql(
        """SELECT * FROM (
             SELECT rep.row_id, rep.grp, rep.feature, rep.contribution, l.value AS display_value, l.severity, l.label,
                    row_number() OVER (PARTITION BY rep.row_id ORDER BY abs(rep.contribution) DESC, rep.grp) AS rank
             FROM rep JOIN lines l ON rep.row_id = l.row_id AND rep.grp = l.grp) x WHERE rank <= 5""",
        ["contribution", "display_value"],
    ),
    "value_bands": with_lab("cohort")[:-1]
    + f",\nbv AS MATERIALIZED ({_BAND_VALUES}),\ncb AS MATERIALIZED ({_bands_sql(CLINICAL_BANDS)})\n"
    + rounded_sql(_apply_bands("bv", "cb", KEYS), ["value"]),
}
