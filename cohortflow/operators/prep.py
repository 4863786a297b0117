"""Training-data preparation without leakage: split, fit on train, apply to any table.

* Random choices (split, folds, SMOTE slots) use ``md5('seed|id')`` order keys: partition-independent and
  reproducible in SQL.
* Exact per-class ranks come from the distributed running sum (a class holding most rows is spread over
  many range partitions, never one task).
* Fitted parameters are per-feature scalars (<= #features values); they are collected once and applied
  as literal column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortflow.functions.scalar import clip_keep_null, hash_order, rdp
from cohortflow.operators.eda import to_tall
from cohortflow.operators.prefix import prefix_sums
from cohortflow.operators.quantiles import column_quantiles, quantiles_wide


# PREP-1 / PREP-10 -----------------------------------------------------------------------------
def rank_within(df: DataFrame, group_cols: Sequence[str], order_col: str, rank_col: str = "rank", size_col: str | None = None) -> DataFrame:
    """1-based rank by a unique order key within each group (distributed running count), and the group's size."""
    base = df.withColumn("_one", F.lit(1).cast("bigint"))
    ranked = prefix_sums(base, group_cols, [order_col], ["_one"])
    out = ranked.withColumnRenamed("_one_upto", rank_col).drop("_one", "_one_before")
    return out.withColumnRenamed("_one_total", size_col) if size_col else out.drop("_one_total")


def stratified_split(
    df: DataFrame, id_col: str, label_col: str, test_fraction: float = 0.2, seed: int = 42
) -> DataFrame:
    """Exact per-class split: within each class the first round(f * n_class) rows by hash order are test."""
    keyed = df.withColumn("_h", hash_order(seed, id_col))
    ranked = rank_within(keyed, [label_col], "_h", "_rk", "_n")
    n_test = F.floor(F.col("_n") * F.lit(test_fraction) + F.lit(0.5))
    return ranked.withColumn("split", F.when(F.col("_rk") <= n_test, F.lit("test")).otherwise(F.lit("train"))).drop(
        "_h", "_rk", "_n"
    )


def kfold_assign(df: DataFrame, id_col: str, label_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Stratified folds: (rank within class by hash - 1) mod k; class counts per fold differ by <= 1."""
    keyed = df.withColumn("_h", hash_order(seed, F.lit("fold"), id_col))
    return rank_within(keyed, [label_col], "_h", "_rk").withColumn(
        "fold", ((F.col("_rk") - F.lit(1)) % F.lit(k)).cast("int")
    ).drop("_h", "_rk")


# PREP-2 -------------------------------------------------------------------------------------
def missing_ratios(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return row.unpivot([], list(columns), "feature", "missing_ratio")


# PREP-3 -------------------------------------------------------------------------------------
def fit_label_encoding(train: DataFrame, col: str) -> DataFrame:
    """Alphabetical codes 0..k-1 over the distinct non-null training values (k = #categories)."""
    values = train.select(F.col(col).cast("string").alias("category")).filter(F.col("category").isNotNull()).distinct()
    return rank_within(values, [], "category", "_rk").select("category", (F.col("_rk") - 1).cast("int").alias("code"))


def apply_label_encoding(df: DataFrame, col: str, mapping: DataFrame, out_col: str) -> DataFrame:
    """Left join to the mapping; NULL and unseen categories stay NULL.  Spark picks the join by the mapping's size."""
    m = mapping.withColumnRenamed("category", "_cat").withColumnRenamed("code", out_col)
    return df.join(m, F.col(col).cast("string") == F.col("_cat"), "left").drop("_cat")


# PREP-4..8: fitted parameters -----------------------------------------------------------------
@dataclass
class Params:
    continuous: list[str]
    binary: list[str]
    median: dict[str, float | None] = field(default_factory=dict)
    mode: dict[str, float | None] = field(default_factory=dict)
    lo: dict[str, float | None] = field(default_factory=dict)
    hi: dict[str, float | None] = field(default_factory=dict)
    mean: dict[str, float | None] = field(default_factory=dict)
    scale: dict[str, float | None] = field(default_factory=dict)

    def rows(self) -> list[tuple]:
        out = []
        for f in self.continuous:
            out.append((f, "continuous", self.median.get(f), None, self.lo.get(f), self.hi.get(f), self.mean.get(f), self.scale.get(f)))
        for f in self.binary:
            out.append((f, "binary", None, self.mode.get(f), None, None, None, None))
        return out

    def to_frame(self, spark: SparkSession) -> DataFrame:
        schema = "feature string, kind string, median double, mode double, lo double, hi double, mean double, scale double"
        return spark.createDataFrame(self.rows(), schema)


def _collect_map(df: DataFrame, key: str, *vals: str) -> dict[str, tuple]:
    return {r[key]: tuple(r[v] for v in vals) for r in df.collect()}  # <= #features rows


def fit_medians(train: DataFrame, id_col: str, label_col: str, cols: Sequence[str]) -> DataFrame:
    tall = to_tall(train, id_col, label_col, cols)
    return quantiles_wide(tall, ["feature"], "value", {"median": 0.5})


def fit_modes(train: DataFrame, id_col: str, label_col: str, cols: Sequence[str]) -> DataFrame:
    """Most frequent non-null value per column, smallest value on ties (partial aggregation, no group gather)."""
    tall = to_tall(train, id_col, label_col, cols).filter(F.col("value").isNotNull())
    counts = tall.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("feature").agg(F.max_by("value", F.struct(F.col("n"), -F.col("value"))).alias("mode"))


def impute(df: DataFrame, p: Params) -> DataFrame:
    ex = {f: F.coalesce(F.col(f).cast("double"), F.lit(p.median[f])) for f in p.continuous if p.median.get(f) is not None}
    ex.update({f: F.coalesce(F.col(f).cast("double"), F.lit(p.mode[f])) for f in p.binary if p.mode.get(f) is not None})
    return df.withColumns(ex) if ex else df


def winsorize(df: DataFrame, p: Params) -> DataFrame:
    ex = {f: clip_keep_null(F.col(f), p.lo[f], p.hi[f]) for f in p.continuous if p.lo.get(f) is not None}
    return df.withColumns(ex) if ex else df


def standardize(df: DataFrame, p: Params) -> DataFrame:
    ex = {f: (F.col(f) - F.lit(p.mean[f])) / F.lit(p.scale[f]) for f in p.continuous if p.mean.get(f) is not None}
    return df.withColumns(ex) if ex else df


def fit_preprocessor(
    train: DataFrame,
    id_col: str,
    label_col: str,
    continuous: Sequence[str],
    binary: Sequence[str],
    iqr_mult: float = 1.5,
    method: str = "exact",
) -> Params:
    """Medians and modes on train; IQR caps on imputed train; mean / population std on capped train."""
    p = Params(list(continuous), list(binary))
    p.median = {f: q["median"] for f, q in column_quantiles(train, continuous, {"median": 0.5}).items()}
    if binary:
        mo = _collect_map(fit_modes(train, id_col, label_col, binary), "feature", "mode")
        p.mode = {f: mo.get(f, (None,))[0] for f in binary}
    imputed = impute(train, p)
    quarters = {"q1": 0.25, "q3": 0.75}
    if method == "exact":
        q = {f: (v["q1"], v["q3"]) for f, v in column_quantiles(imputed, continuous, quarters).items()}
    else:
        tall = to_tall(imputed, id_col, label_col, continuous)
        q = _collect_map(quantiles_wide(tall, ["feature"], "value", quarters, method), "feature", "q1", "q3")
    for f in continuous:
        q1, q3 = q.get(f, (None, None))
        if q1 is not None:
            p.lo[f] = q1 - iqr_mult * (q3 - q1)
            p.hi[f] = q3 + iqr_mult * (q3 - q1)
    capped = winsorize(imputed, p)
    mom = capped.agg(
        *[F.avg(f).alias(f"m_{f}") for f in continuous], *[F.stddev_pop(f).alias(f"s_{f}") for f in continuous]
    ).first()
    for f in continuous:
        p.mean[f] = mom[f"m_{f}"]
        s = mom[f"s_{f}"]
        p.scale[f] = 1.0 if (s is None or s == 0.0) else s
    return p


def apply_preprocessor(df: DataFrame, p: Params) -> DataFrame:
    """JN-9: impute -> cap -> scale with fitted literals (no join, no shuffle)."""
    return standardize(winsorize(impute(df, p), p), p)


# PREP-7 -------------------------------------------------------------------------------------
def one_hot(df: DataFrame, col: str, categories: Sequence[str], prefix: str | None = None) -> DataFrame:
    """Indicator per training category; unseen categories -> all zeros; NULL -> all zeros."""
    pre = prefix or col
    return df.withColumns({f"{pre}_{c}": F.coalesce((F.col(col) == F.lit(c)).cast("int"), F.lit(0)) for c in categories})


def train_categories(train: DataFrame, col: str, most: int = 1000) -> list[str]:
    """The categories in order; they become columns, so more than `most` of them is an error."""
    found = [r[0] for r in train.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{col} has more than {most} categories; encode it by label instead")
    return found


# PREP-12 ------------------------------------------------------------------------------------
def class_weights(train: DataFrame, label_col: str) -> DataFrame:
    counts = train.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()  # over the <= #classes count rows
    j = counts.select(
        "*",
        F.sum("n").over(w).alias("total"),
        F.sum(F.when(F.col(label_col) == 0, F.col("n"))).over(w).alias("n_neg"),
        F.sum(F.when(F.col(label_col) == 1, F.col("n"))).over(w).alias("n_pos"),
        F.count(F.lit(1)).over(w).alias("k"),
    )
    return j.select(
        label_col,
        "n",
        (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"),
        F.try_divide(F.col("n_neg").cast("double"), F.col("n_pos").cast("double")).alias("scale_pos_weight"),
    )


def round_features(df: DataFrame, cols: Sequence[str], digits: int = 9) -> DataFrame:
    """Fix scaled values to a decimal grid so distance ties do not depend on aggregation order."""
    return df.withColumns({c: rdp(F.col(c), digits) for c in cols})


