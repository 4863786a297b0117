"""Evaluation of any scored table ``(model, row_id, prob, actual)`` -- model-independent.

Curve operators (ROC, PR, AUC) first collapse rows to one per distinct score with positive / negative
counts (a large reduction: scores repeat) and then use the distributed running sum; there is no
global-order window.  Per-model results are small (<= #models x #distinct scores).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.functions.scalar import rdp
from cohortflow.operators.prefix import prefix_sums


def with_pred(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """FLT-8: class = prob >= threshold."""
    return scored.withColumn("pred", (F.col("prob") >= F.lit(threshold)).cast("int"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


# EVL-1 --------------------------------------------------------------------------------------
def confusion(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    p = with_pred(scored, threshold)
    counts = p.groupBy("model", "actual", "pred").agg(F.count(F.lit(1)).alias("n"))
    cells = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(b).alias("pred")) for a in (0, 1) for b in (0, 1)])
    grid = p.select("model").distinct().select("model", F.inline(cells))  # the 4 fixed cells of each model
    return grid.join(counts, ["model", "actual", "pred"], "left").select(
        "model", "actual", "pred", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


# EVL-2 / EVL-6 ------------------------------------------------------------------------------
def binary_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    p = with_pred(scored, threshold)
    a, y = F.col("actual"), F.col("pred")
    m = p.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((a == 1) & (y == 1)).cast("bigint").alias("tp"),
        F.count_if((a == 0) & (y == 1)).cast("bigint").alias("fp"),
        F.count_if((a == 1) & (y == 0)).cast("bigint").alias("fn"),
        F.count_if((a == 0) & (y == 0)).cast("bigint").alias("tn"),
        F.avg(F.pow(F.col("prob") - a, 2)).alias("brier"),
    )
    prec = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    m = m.withColumns(
        {
            "accuracy": _ratio(F.col("tp") + F.col("tn"), F.col("n")),
            "precision": prec,
            "recall": rec,
        }
    )
    return m.withColumn("f1", _ratio(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


# EVL-3 --------------------------------------------------------------------------------------
def class_report(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per class precision / recall / F1 / support, plus macro and weighted averages and accuracy."""
    m = binary_metrics(scored, threshold)
    rows = []
    for cls, tp, fp, fn in (("1", "tp", "fp", "fn"), ("0", "tn", "fn", "fp")):
        pr = _ratio(F.col(tp), F.col(tp) + F.col(fp))
        rc = _ratio(F.col(tp), F.col(tp) + F.col(fn))
        rows.append(
            m.select(
                "model",
                F.lit(cls).alias("cls"),
                pr.alias("precision"),
                rc.alias("recall"),
                _ratio(F.lit(2.0) * pr * rc, pr + rc).alias("f1"),
                (F.col(tp) + F.col(fn)).alias("support"),
            )
        )
    per = rows[0].unionByName(rows[1])
    avg = per.groupBy("model").agg(
        F.avg("precision").alias("mp"),
        F.avg("recall").alias("mr"),
        F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"),
        F.sum("support").alias("support"),
    )
    macro = avg.select("model", F.lit("macro avg").alias("cls"), F.col("mp").alias("precision"), F.col("mr").alias("recall"), F.col("mf").alias("f1"), "support")
    weighted = avg.select("model", F.lit("weighted avg").alias("cls"), F.col("wp").alias("precision"), F.col("wr").alias("recall"), F.col("wf").alias("f1"), "support")
    acc = m.select(
        "model", F.lit("accuracy").alias("cls"), F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"), F.col("accuracy").alias("f1"), F.col("n").alias("support"),
    )
    return per.unionByName(macro).unionByName(weighted).unionByName(acc)


# score collapse shared by ROC / PR / AUC ------------------------------------------------------
def score_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("model", "prob").agg(
        F.count_if(F.col("actual") == 1).cast("bigint").alias("pos"),
        F.count_if(F.col("actual") == 0).cast("bigint").alias("neg"),
    )


def _descending_cumulative(scored: DataFrame) -> DataFrame:
    counts = score_counts(scored)
    pre = prefix_sums(counts, ["model"], ["prob"], ["pos", "neg"], descending=True)
    return pre.withColumnsRenamed({"pos_total": "P", "neg_total": "N"})


# EVL-4 / WIN-4 ------------------------------------------------------------------------------
def roc_curve(scored: DataFrame) -> DataFrame:
    """Points (fpr, tpr) at every distinct threshold (descending) plus the (0, 0) start (threshold NULL)."""
    c = _descending_cumulative(scored)
    pts = c.select(
        "model",
        F.col("prob").alias("threshold"),
        _ratio(F.col("neg_upto"), F.col("N")).alias("fpr"),
        _ratio(F.col("pos_upto"), F.col("P")).alias("tpr"),
    )
    start = scored.select("model").distinct().select(
        "model", F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return pts.unionByName(start)


# EVL-5 --------------------------------------------------------------------------------------
def roc_auc(scored: DataFrame) -> DataFrame:
    """AUC = P(score_pos > score_neg) + 0.5 P(tie): the Mann-Whitney form, exact with ties."""
    counts = score_counts(scored)
    pre = prefix_sums(counts, ["model"], ["prob"], ["neg"])
    per = pre.groupBy("model").agg(
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / F.lit(2.0))).alias("u"),
        F.sum("pos").alias("P"),
        F.sum("neg").alias("N"),
    )
    return per.select("model", F.try_divide(F.col("u"), F.col("P") * F.col("N")).alias("auc"))


# EVL-7 --------------------------------------------------------------------------------------
def calibration(scored: DataFrame, n_bins: int = 10) -> DataFrame:
    """Uniform bins on [0, 1], right-closed (first includes 0); empty bins absent.
    The bin index counts the inner edges i/n (computed as i * (1/n), like an evenly spaced grid) below p."""
    step = 1.0 / n_bins
    idx = sum(((F.lit(float(i)) * F.lit(step)) < F.col("prob")).cast("int") for i in range(1, n_bins))
    return scored.withColumn("bin", idx).groupBy("model", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("prob").alias("mean_prob"), F.avg(F.col("actual").cast("double")).alias("frac_positive")
    )


# EVL-10 -------------------------------------------------------------------------------------
def pr_curve(scored: DataFrame) -> DataFrame:
    """Precision / recall at each distinct threshold (descending) and average precision per model:
    AP = sum_n (R_n - R_{n-1}) * P_n."""
    c = _descending_cumulative(scored)
    pts = c.select(
        "model",
        F.col("prob").alias("threshold"),
        _ratio(F.col("pos_upto"), F.col("pos_upto") + F.col("neg_upto")).alias("precision"),
        _ratio(F.col("pos_upto"), F.col("P")).alias("recall"),
        _ratio(F.col("pos"), F.col("P")).alias("_dr"),
    )
    ap = pts.groupBy("model").agg(F.sum(F.col("_dr") * F.col("precision")).alias("average_precision"))
    return pts.drop("_dr").join(F.broadcast(ap), "model")


# EVL-11 -------------------------------------------------------------------------------------
def threshold_scan(pr: DataFrame, min_precision: float, min_recall: float) -> DataFrame:
    return pr.groupBy("model").agg(
        F.min(F.when(F.col("precision") >= F.lit(min_precision), F.col("threshold"))).alias("lowest_threshold_precision"),
        F.max(F.when(F.col("recall") >= F.lit(min_recall), F.col("threshold"))).alias("highest_threshold_recall"),
    )


# EVL-8 / SCL-12 -----------------------------------------------------------------------------
def risk_band(prob: Column, high: float = 0.7, watch: float = 0.3) -> Column:
    return F.when(prob >= high, F.lit("high")).when(prob >= watch, F.lit("watch")).otherwise(F.lit("low"))


def score_summary(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    p = with_pred(scored, threshold).withColumn("band", risk_band(F.col("prob")))
    return p.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("pred").cast("double")).alias("predicted_positive_rate"),
        F.avg(F.col("actual").cast("double")).alias("actual_positive_rate"),
        F.avg((F.col("pred") == F.col("actual")).cast("double")).alias("accuracy"),
        F.count_if(F.col("band") == "high").cast("bigint").alias("n_high"),
        F.count_if(F.col("band") == "watch").cast("bigint").alias("n_watch"),
        F.count_if(F.col("band") == "low").cast("bigint").alias("n_low"),
    )


# SRT-4 / SET-2 / SCL-13 ---------------------------------------------------------------------
def confusion_tag(pred: Column, actual: Column) -> Column:
    return (
        F.when((pred == 1) & (actual == 1), F.lit("TP"))
        .when((pred == 1) & (actual == 0), F.lit("FP"))
        .when((pred == 0) & (actual == 0), F.lit("TN"))
        .otherwise(F.lit("FN"))
    )


def risk_topk(scored: DataFrame, k: int = 10, high: float = 0.5, low: float = 0.5) -> DataFrame:
    """High list: TP by prob desc, then FP by prob desc; low list: TN by prob asc, then FN by prob asc.
    A top-k report: the row-number limit is applied per (model, list) before the shuffle."""
    p = F.col("prob")
    tagged = scored.select(
        "model", "row_id", "prob", "actual",
        F.when(p >= high, F.lit("high")).when(p < low, F.lit("low")).alias("list"),
    ).filter(F.col("list").isNotNull())
    tagged = tagged.withColumn(
        "tag", confusion_tag((F.col("list") == "high").cast("int"), F.col("actual"))
    )
    prio = F.when(F.col("tag").isin("TP", "TN"), F.lit(0)).otherwise(F.lit(1))
    key = F.when(F.col("list") == "high", -p).otherwise(p)
    w = Window.partitionBy("model", "list").orderBy(prio, key, F.col("row_id"))
    return tagged.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


# SRT-5 --------------------------------------------------------------------------------------
CASES = {  # fixed case definitions: (name, prob predicate, actual)
    "high_risk": (lambda p: p > 0.8, 1),
    "low_risk": (lambda p: p < 0.1, 0),
    "false_negative": (lambda p: p < 0.3, 1),
}


def case_select(scored: DataFrame) -> DataFrame:
    """First row in input (row id) order matching each case predicate, per model."""
    out = None
    for name, (pred, actual) in CASES.items():
        sel = scored.filter(pred(F.col("prob")) & (F.col("actual") == actual)).groupBy("model").agg(
            F.min_by(F.struct("row_id", "prob", "actual"), F.col("row_id")).alias("r")
        ).select("model", F.lit(name).alias("case"), "r.row_id", "r.prob", "r.actual")
        out = sel if out is None else out.unionByName(sel)
    return out


# EVL-9 / SRT-8 ------------------------------------------------------------------------------
def model_comparison(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    m = binary_metrics(scored, threshold).join(roc_auc(scored), "model")
    # models compare by what is reported, four places; <= #models rows
    w = Window.orderBy(*[rdp(c, 4).desc() for c in ("f1", "auc", "recall")], F.col("model"))
    ranked = m.withColumn("rank", F.row_number().over(w).cast("bigint"))
    return ranked.select(
        "model", "accuracy", "precision", "recall", "f1", "auc", "brier", "rank", (F.col("rank") == 1).alias("is_champion")
    )
