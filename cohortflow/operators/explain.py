"""Attributions and the reports built on them, over a tall ``(row_id, feature, value, z, contribution)`` table.

Linear models get the exact closed form ``beta * (x - mean)``; tree ensembles get path-dependent TreeSHAP
(`cohortflow.operators.treeshap`) -- both produce the same tall shape, so every report below works for
either.  Per-row work is windows partitioned by row (bounded by #features); per-feature work is one
grouped aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.operators.eda import _guarded_corr


# EXP-2 --------------------------------------------------------------------------------------
def linear_attributions(df: DataFrame, id_col: str, weights: Mapping[str, float], label_col: str | None = None) -> DataFrame:
    """contribution = w * (x - mean) / sd_pop for each weighted feature (background = ``df`` itself).

    Mean and sd come from one aggregate (2 numbers per feature) and are applied as literals."""
    feats = list(weights)
    st = df.agg(*[F.avg(f).alias(f"m_{f}") for f in feats], *[F.stddev_pop(f).alias(f"s_{f}") for f in feats]).first()
    keep = [id_col] + ([label_col] if label_col else [])
    j = df.select(*keep, *[F.col(f).cast("double").alias(f) for f in feats])

    def lit(v):
        return F.lit(v).cast("double")

    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.col(f).alias("value"),
                F.try_divide(F.col(f) - lit(st[f"m_{f}"]), lit(st[f"s_{f}"])).alias("z"),
                F.lit(float(w)).alias("w"),
            )
            for f, w in weights.items()
        ]
    )
    tall = j.select(*keep, F.inline(cells)).filter(F.col("value").isNotNull())
    return tall.select(*keep, "feature", "value", "z", (F.col("w") * F.col("z")).alias("contribution"))


def linear_scores(attr: DataFrame, id_col: str, intercept: float, label_col: str) -> DataFrame:
    """score = sigmoid(intercept + sum of contributions) per row -> (row_id, prob, actual)."""
    s = attr.groupBy(id_col, label_col).agg(F.sum("contribution").alias("_m"))
    return s.select(
        id_col,
        (F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(intercept) + F.col("_m"))))).alias("prob"),
        F.col(label_col).alias("actual"),
    )


# EXP-3 / SRT-7 ------------------------------------------------------------------------------
def global_importance(attr: DataFrame, top: int = 2) -> DataFrame:
    g = attr.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))
    w = Window.orderBy(F.col("mean_abs").desc(), "feature")  # <= #features rows
    return g.withColumn("rank", F.row_number().over(w).cast("bigint")).withColumn("is_top", F.col("rank") <= top)


# EXP-4 --------------------------------------------------------------------------------------
def direction(attr: DataFrame) -> DataFrame:
    return attr.groupBy("feature").agg(_guarded_corr(F.col("value"), F.col("contribution")).alias("r"))


# EXP-5 --------------------------------------------------------------------------------------
def dependence(attr: DataFrame, features: DataFrame, bins: int = 20) -> DataFrame:
    """Value vs contribution for the chosen features, binned to ``bins`` equal-width value bins."""
    sel = attr.join(F.broadcast(features.select("feature")), "feature", "left_semi")  # <= #features keys
    rng = sel.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    idx = F.when(
        F.col("hi") > F.col("lo"),
        F.least(F.floor((F.col("value") - F.col("lo")) * F.lit(float(bins)) / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)),
    ).otherwise(F.lit(0))
    return (
        sel.join(F.broadcast(rng), "feature")
        .withColumn("bin", idx.cast("int"))
        .groupBy("feature", "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("value").alias("mean_value"),
            F.avg("contribution").alias("mean_contribution"),
            F.min("contribution").alias("min_contribution"),
            F.max("contribution").alias("max_contribution"),
        )
    )


# EXP-6 --------------------------------------------------------------------------------------
def waterfall(attr: DataFrame, cases: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Contributions of the selected rows ordered by |c| (desc) with the running total."""
    sel = attr.join(F.broadcast(cases.select("case", id_col)), id_col)  # cases: a handful of rows
    w = Window.partitionBy("case", id_col).orderBy(F.abs("contribution").desc(), "feature")
    return sel.select(
        "case", id_col, "feature", "value", "contribution",
        F.row_number().over(w).cast("bigint").alias("step"),
        F.sum("contribution").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"),
    )


# EXP-7 / SCL-11 -----------------------------------------------------------------------------
# fixed values: thresholds of the z-score bands, and their wording in order
Z_BANDS = [(1.5, "very high"), (0.5, "high"), (0.0, "slightly above average"), (-0.5, "slightly below average"), (-1.5, "low")]
Z_FLOOR_LABEL = "very low"
# fixed values: the same for an age, which has no band at the average
AGE_BANDS = [(1.5, "very old"), (0.5, "old"), (-0.5, "middle-aged"), (-1.5, "young")]
AGE_FLOOR_LABEL = "very young"


def z_label(z: Column, bands: Sequence[tuple[float, str]] = Z_BANDS, floor: str = Z_FLOOR_LABEL) -> Column:
    """The label of the first threshold that z exceeds (thresholds descending), else `floor`; a NULL z is `floor`."""
    expr = None
    for t, lbl in bands:
        expr = F.when(z > F.lit(t), F.lit(lbl)) if expr is None else expr.when(z > F.lit(t), F.lit(lbl))
    return expr.otherwise(F.lit(floor))


def describe_value(feature: Column, value: Column, z: Column, binary_labels: Mapping[str, tuple[str, str]], age_features: Sequence[str] = ()) -> Column:
    """Binary features -> their 0/1 wording; ages -> age bands; other continuous ones -> z-score band wording."""
    expr = None
    for f, (no, yes) in binary_labels.items():
        lbl = F.when(F.round(value) >= 1, F.lit(yes)).otherwise(F.lit(no))
        expr = F.when(feature == F.lit(f), lbl) if expr is None else expr.when(feature == F.lit(f), lbl)
    for f in age_features:
        lbl = z_label(z, AGE_BANDS, AGE_FLOOR_LABEL)
        expr = F.when(feature == F.lit(f), lbl) if expr is None else expr.when(feature == F.lit(f), lbl)
    cont = z_label(z)
    return cont if expr is None else expr.otherwise(cont)


def reasons(attr: DataFrame, rows: DataFrame, binary_labels: Mapping[str, tuple[str, str]], threshold: float = 0.05,
            id_col: str = "row_id", age_features: Sequence[str] = ()) -> DataFrame:
    """|c| >= threshold, split by sign; raising sorted by c desc, lowering by c asc; values described."""
    sel = attr.join(rows.select(id_col, "list"), id_col).filter(F.abs("contribution") >= F.lit(threshold))
    sel = sel.withColumn("direction", F.when(F.col("contribution") > 0, F.lit("raises")).otherwise(F.lit("lowers")))
    key = F.when(F.col("direction") == "raises", -F.col("contribution")).otherwise(F.col("contribution"))
    w = Window.partitionBy(id_col, "direction").orderBy(key, "feature")
    return sel.select(
        "list", id_col, "direction", F.row_number().over(w).cast("bigint").alias("rank"), "feature", "contribution",
        describe_value(F.col("feature"), F.col("value"), F.col("z"), binary_labels, age_features).alias("description"),
    )


# EXP-8 --------------------------------------------------------------------------------------
def group_attribution(attr: DataFrame, rows: DataFrame, cut: float = 0.02, id_col: str = "row_id") -> DataFrame:
    """Mean contribution per (list, feature); 'high' keeps > cut (desc), 'low' keeps < -cut (asc)."""
    g = attr.join(rows.select(id_col, "list"), id_col).groupBy("list", "feature").agg(
        F.avg("contribution").alias("mean_contribution")
    )
    keep = ((F.col("list") == "high") & (F.col("mean_contribution") > cut)) | (
        (F.col("list") == "low") & (F.col("mean_contribution") < -cut)
    )
    key = F.when(F.col("list") == "high", -F.col("mean_contribution")).otherwise(F.col("mean_contribution"))
    w = Window.partitionBy("list").orderBy(key, "feature")  # <= #features rows per list
    return g.filter(keep).withColumn("rank", F.row_number().over(w).cast("bigint"))


# SCL-10 -------------------------------------------------------------------------------------
def band(metric: Column, value: Column, bands: Sequence[tuple]) -> Column:
    """struct(severity, label) of the most severe band (metric, op, threshold, severity, label) whose condition holds:
    a chain of conditions, no join.  NULL without a value or a band."""
    out = None
    for name, op, threshold, severity, label in sorted(bands, key=lambda b: -b[3]):
        limit = F.lit(threshold)
        holds = {">": value > limit, "<": value < limit, ">=": value >= limit, "else": F.lit(True)}[op]
        cond = (metric == F.lit(name)) & value.isNotNull() & holds
        pick = F.struct(F.lit(severity).alias("severity"), F.lit(label).alias("label"))
        out = F.when(cond, pick) if out is None else out.when(cond, pick)
    return out


def apply_bands(values: DataFrame, bands: Sequence[tuple], key_cols: Sequence[str]) -> DataFrame:
    """values (keys..., metric, value) -> every row that a band holds for, with its severity and label; equal rows stay."""
    hit = values.select(*key_cols, "metric", "value", band(F.col("metric"), F.col("value"), bands).alias("_b"))
    return hit.filter(F.col("_b").isNotNull()).select(*key_cols, "metric", "value", "_b.severity", "_b.label")


# EXP-9 / WIN-3 / SCL-14 ---------------------------------------------------------------------
def ranked_commentary(
    attr: DataFrame,
    raw: DataFrame,
    groups: Mapping[str, str],
    display: Mapping[str, tuple[str | Sequence[str], str]],
    bands: Sequence[tuple],
    flag_groups: Mapping[str, str],
    top: int = 5,
    id_col: str = "row_id",
    flag_severity: Mapping[str, int] | None = None,
) -> DataFrame:
    """Per row: group features by prefix (representative = max |c| member), rank groups by |c|, attach the
    banded wording of the group's display value; flag groups are reported only when the flag is 1;
    groups with no value are skipped; the first ``top`` lines are kept.

    groups: feature prefix -> group name; display: group -> (raw column or columns, the first with a value counts;
    band metric); flag_groups: flag column -> display text; flag_severity: flag column -> severity (3 where absent)."""
    grp = None
    for prefix, name in groups.items():
        c = F.col("feature").startswith(prefix)
        grp = F.when(c, F.lit(name)) if grp is None else grp.when(c, F.lit(name))
    for flag in flag_groups:
        grp = grp.when(F.col("feature") == F.lit(flag), F.lit(flag))
    g = attr.withColumn("grp", grp).filter(F.col("grp").isNotNull())
    w_rep = Window.partitionBy(id_col, "grp").orderBy(F.abs("contribution").desc(), "feature")
    rep = g.withColumn("_r", F.row_number().over(w_rep)).filter(F.col("_r") == 1).select(id_col, "grp", "feature", "contribution")

    def pick(choices: Mapping[str, Column]) -> Column:
        out = F.lit(None)
        for name, c in choices.items():
            out = F.when(F.col("grp") == F.lit(name), c).otherwise(out)
        return out

    first = lambda cols: F.coalesce(*[F.col(f"_raw.{c}").cast("double") for c in ([cols] if isinstance(cols, str) else cols)])
    shown = {name: first(cols) for name, (cols, _) in display.items()} | {flag: first(flag) for flag in flag_groups}
    is_flag = F.col("grp").isin(*flag_groups)
    needed = sorted({c for cols, _ in display.values() for c in ([cols] if isinstance(cols, str) else cols)} | set(flag_groups))
    j = rep.join(raw.select(id_col, F.struct(*needed).alias("_raw")), id_col)
    j = j.select(id_col, "grp", "feature", "contribution", pick(shown).alias("display_value"),
                 pick({name: F.lit(metric) for name, (_, metric) in display.items()}).alias("_metric"))
    j = j.withColumn("_b", band(F.col("_metric"), F.col("display_value"), bands))
    # groups without a value and flags that are not set drop out here
    j = j.filter(F.when(is_flag, F.col("display_value") == 1).otherwise(F.col("_b").isNotNull()))
    severity = pick({flag: F.lit((flag_severity or {}).get(flag, 3)) for flag in flag_groups})
    w = Window.partitionBy(id_col).orderBy(F.abs("contribution").desc(), "grp")
    return j.select(
        id_col, "grp", "feature", "contribution", "display_value",
        F.when(is_flag, severity).otherwise(F.col("_b.severity")).cast("int").alias("severity"),
        F.when(is_flag, pick({f: F.lit(text) for f, text in flag_groups.items()})).otherwise(F.col("_b.label")).alias("label"),
        F.row_number().over(w).cast("bigint").alias("rank"),
    ).filter(F.col("rank") <= top)
