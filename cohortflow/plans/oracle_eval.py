"""DuckDB oracle SQL for the evaluation queries."""

from __future__ import annotations

from cohortflow.plans.common import rounded_sql
from cohortflow.plans.eval_queries import MIN_PRECISION, MIN_RECALL
from cohortflow.sources import fixtures as FX


def with_scored(**extra: str) -> str:
    parts = {"fx_b": FX.CUSTOMER_FEATURES_SQL, "sc": FX.SCORED_SQL}
    parts.update(extra)
    return FX.cte(**parts)


def _ratio(a: str, b: str) -> str:
    return f"COALESCE(CASE WHEN ({b}) = 0 THEN NULL ELSE ({a})::double / ({b})::double END, 0.0::double)"


METRICS = {
    "bm0": """SELECT model, count(*) AS n,
                     CAST(count(*) FILTER (WHERE actual = 1 AND prob >= 0.5) AS BIGINT) AS tp,
                     CAST(count(*) FILTER (WHERE actual = 0 AND prob >= 0.5) AS BIGINT) AS fp,
                     CAST(count(*) FILTER (WHERE actual = 1 AND prob < 0.5) AS BIGINT) AS fn,
                     CAST(count(*) FILTER (WHERE actual = 0 AND prob < 0.5) AS BIGINT) AS tn,
                     avg(pow(prob - actual, 2)) AS brier
              FROM sc GROUP BY model""",
    "bm1": f"""SELECT *, {_ratio('tp + tn', 'n')} AS accuracy, {_ratio('tp', 'tp + fp')} AS precision,
                      {_ratio('tp', 'tp + fn')} AS recall FROM bm0""",
    "bm": f"SELECT *, {_ratio('2.0::double * precision * recall', 'precision + recall')} AS f1 FROM bm1",
}

_CNT = "SELECT model, prob, CAST(count(*) FILTER (WHERE actual = 1) AS BIGINT) AS pos, CAST(count(*) FILTER (WHERE actual = 0) AS BIGINT) AS neg FROM sc GROUP BY model, prob"
CUM = {
    "cnt": _CNT,
    "tot": "SELECT model, sum(pos) AS P, sum(neg) AS N FROM cnt GROUP BY model",
    "cum": """SELECT c.*, t.P, t.N,
                     sum(pos) OVER (PARTITION BY model ORDER BY prob DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pos_upto,
                     sum(neg) OVER (PARTITION BY model ORDER BY prob DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_upto
              FROM cnt c JOIN tot t USING (model)""",
}
AUC = {
    "cnt": _CNT,
    "auc": """SELECT model, CASE WHEN sum(pos) * sum(neg) = 0 THEN NULL ELSE sum(pos * (neg_before + neg / 2.0::double)) / (sum(pos) * sum(neg)) END AS auc
              FROM (SELECT *, COALESCE(sum(neg) OVER (PARTITION BY model ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_before FROM cnt) x
              GROUP BY model""",
}
PR = dict(CUM)
PR["pts"] = f"""SELECT model, prob AS threshold, {_ratio('pos_upto', 'pos_upto + neg_upto')} AS precision,
                       {_ratio('pos_upto', 'P')} AS recall, {_ratio('pos', 'P')} AS dr FROM cum"""
PR["pr"] = """SELECT p.model, p.threshold, p.precision, p.recall, a.average_precision FROM pts p
              JOIN (SELECT model, sum(dr * precision) AS average_precision FROM pts GROUP BY model) a USING (model)"""


def _class_rows() -> str:
    rows = []
    for cls, tp, fp, fn in (("1", "tp", "fp", "fn"), ("0", "tn", "fn", "fp")):
        pr, rc = _ratio(tp, f"{tp} + {fp}"), _ratio(tp, f"{tp} + {fn}")
        rows.append(
            f"SELECT model, '{cls}' AS cls, {pr} AS precision, {rc} AS recall, "
            f"{_ratio(f'2.0::double * ({pr}) * ({rc})', f'({pr}) + ({rc})')} AS f1, {tp} + {fn} AS support FROM bm"
        )
    return " UNION ALL ".join(rows)


_STEP = 1.0 / 10
_BIN = " + ".join(f"CAST({float(i)!r}::double * {_STEP!r}::double < prob AS INTEGER)" for i in range(1, 10))

ORACLE = {
    "confusion": with_scored()
    + """SELECT m.model, g.actual, g.pred, CAST(COALESCE(c.n, 0) AS BIGINT) AS n
         FROM (SELECT DISTINCT model FROM sc) m CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) g(actual, pred)
         LEFT JOIN (SELECT model, actual, CAST(prob >= 0.5 AS INTEGER) AS pred, count(*) AS n FROM sc GROUP BY ALL) c
           ON c.model = m.model AND c.actual = g.actual AND c.pred = g.pred""",
    "binary_metrics": with_scored(**METRICS) + rounded_sql("SELECT * FROM bm", ["brier", "accuracy", "precision", "recall", "f1"]),
    "class_report": with_scored(**METRICS, per=_class_rows())
    + rounded_sql(
        """SELECT * FROM per
           UNION ALL SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM per GROUP BY model
           UNION ALL SELECT model, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                            sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per GROUP BY model
           UNION ALL SELECT model, 'accuracy', NULL::double, NULL::double, accuracy, n FROM bm""",
        ["precision", "recall", "f1"],
    ),
    "roc_curve": with_scored(**CUM)
    + rounded_sql(
        f"""SELECT model, prob AS threshold, {_ratio('neg_upto', 'N')} AS fpr, {_ratio('pos_upto', 'P')} AS tpr FROM cum
            UNION ALL SELECT DISTINCT model, NULL::double, 0.0::double, 0.0::double FROM sc""",
        ["fpr", "tpr"],
    ),
    "roc_auc": with_scored(**AUC) + rounded_sql("SELECT * FROM auc", ["auc"]),
    "calibration": with_scored()
    + rounded_sql(
        f"""SELECT model, {_BIN} AS bin, count(*) AS n, avg(prob) AS mean_prob, avg(actual::double) AS frac_positive
            FROM sc GROUP BY ALL""",
        ["mean_prob", "frac_positive"],
    ),
    "pr_curve": with_scored(**PR) + rounded_sql("SELECT * FROM pr", ["precision", "recall", "average_precision"]),
    "threshold_scan": with_scored(**PR)
    + f"""SELECT model, min(threshold) FILTER (WHERE precision >= {MIN_PRECISION!r}::double) AS lowest_threshold_precision,
                 max(threshold) FILTER (WHERE recall >= {MIN_RECALL!r}::double) AS highest_threshold_recall
          FROM pr GROUP BY model""",
    "score_summary": with_scored()
    + rounded_sql(
        """SELECT model, count(*) AS n, avg(CAST(prob >= 0.5 AS INTEGER)::double) AS predicted_positive_rate,
                  avg(actual::double) AS actual_positive_rate,
                  avg(CAST(CAST(prob >= 0.5 AS INTEGER) = actual AS INTEGER)::double) AS accuracy,
                  CAST(count(*) FILTER (WHERE prob >= 0.7) AS BIGINT) AS n_high,
                  CAST(count(*) FILTER (WHERE prob < 0.7 AND prob >= 0.3) AS BIGINT) AS n_watch,
                  CAST(count(*) FILTER (WHERE prob < 0.3) AS BIGINT) AS n_low
           FROM sc GROUP BY model""",
        ["predicted_positive_rate", "actual_positive_rate", "accuracy"],
    ),
    "risk_topk": with_scored()
    + """SELECT * FROM (
           SELECT model, row_id, prob, actual, list, tag,
                  row_number() OVER (PARTITION BY model, list ORDER BY CASE WHEN tag IN ('TP', 'TN') THEN 0 ELSE 1 END,
                                     CASE WHEN list = 'high' THEN -prob ELSE prob END, row_id) AS rank
           FROM (SELECT *, CASE WHEN prob >= 0.5 THEN 'high' WHEN prob < 0.5 THEN 'low' END AS list,
                        CASE WHEN prob >= 0.5 AND actual = 1 THEN 'TP' WHEN prob >= 0.5 AND actual = 0 THEN 'FP'
                             WHEN prob < 0.5 AND actual = 0 THEN 'TN' ELSE 'FN' END AS tag
                 FROM sc WHERE prob IS NOT NULL) t) r WHERE rank <= 10""",
    "case_select": with_scored()
    + """SELECT model, 'high_risk' AS "case", min(row_id) AS row_id, arg_min(prob, row_id) AS prob, arg_min(actual, row_id) AS actual FROM sc WHERE prob > 0.8 AND actual = 1 GROUP BY model
         UNION ALL SELECT model, 'low_risk', min(row_id), arg_min(prob, row_id), arg_min(actual, row_id) FROM sc WHERE prob < 0.1 AND actual = 0 GROUP BY model
         UNION ALL SELECT model, 'false_negative', min(row_id), arg_min(prob, row_id), arg_min(actual, row_id) FROM sc WHERE prob < 0.3 AND actual = 1 GROUP BY model""",
    "champion": with_scored(**METRICS, **AUC)
    + rounded_sql(
        """SELECT model, accuracy, precision, recall, f1, auc, brier, rank, rank = 1 AS is_champion FROM (
             SELECT b.*, a.auc, row_number() OVER (ORDER BY floor(f1 * 1e4::double + 0.5) DESC, floor(auc * 1e4::double + 0.5) DESC, floor(recall * 1e4::double + 0.5) DESC, model) AS rank
             FROM bm b JOIN auc a USING (model)) r""",
        ["accuracy", "precision", "recall", "f1", "auc", "brier"],
    ),
}
