"""Two-group hypothesis tests over the tall table, all features in one pass each.

* normality gate (Jarque-Bera from population skewness / excess kurtosis; p = exp(-JB/2));
* Welch t (means, sample variances, Welch-Satterthwaite df);
* Mann-Whitney U with tie and continuity correction, from counts per distinct value and a distributed
  running sum (no global sort, no per-feature job);
* chi-square of independence with Yates' correction when dof = 1;
* the combined result table, feature selection and run summary.

Every test reads only per-(feature, class[, value]) summaries, so the driver never sees row data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.functions.pvalues import chi2_sf, normal_two_sided, student_t_two_sided
from cohortflow.functions.scalar import rdp
from cohortflow.operators.prefix import prefix_sums
from cohortflow.operators.quantiles import quantiles_from_counts


def _by_class(tall: DataFrame, label_col: str) -> DataFrame:
    return tall.filter(F.col("value").isNotNull() & F.col(label_col).isNotNull())


# STT-1 -------------------------------------------------------------------------------------
def class_moments(tall: DataFrame, label_col: str) -> DataFrame:
    """One pass: per (feature, class) count, mean, sample sd, population skewness and excess kurtosis."""
    return _by_class(tall, label_col).groupBy("feature", label_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.skewness("value").alias("s"),
        F.kurtosis("value").alias("k"),
    )


def normality_gate(tall: DataFrame, label_col: str, alpha: float = 0.05, min_n: int = 8,
                   moments: DataFrame | None = None) -> DataFrame:
    """Per feature: n0, n1, JB p per class; ``normal`` when both p > alpha; ``tested`` when both n >= min_n."""
    per = moments if moments is not None else class_moments(tall, label_col)
    jb = F.col("n") / F.lit(6.0) * (F.col("s") * F.col("s") + F.col("k") * F.col("k") / F.lit(4.0))
    per = per.withColumn("jb_p", F.exp(-jb / F.lit(2.0)))
    wide = per.groupBy("feature").agg(
        F.max(F.when(F.col(label_col) == 0, F.col("n"))).alias("n0"),
        F.max(F.when(F.col(label_col) == 1, F.col("n"))).alias("n1"),
        F.max(F.when(F.col(label_col) == 0, F.col("jb_p"))).alias("jb_p0"),
        F.max(F.when(F.col(label_col) == 1, F.col("jb_p"))).alias("jb_p1"),
    )
    return wide.select(
        "feature",
        F.coalesce("n0", F.lit(0)).alias("n0"),
        F.coalesce("n1", F.lit(0)).alias("n1"),
        "jb_p0",
        "jb_p1",
        F.coalesce((F.col("jb_p0") > alpha) & (F.col("jb_p1") > alpha), F.lit(False)).alias("normal"),
        ((F.coalesce("n0", F.lit(0)) >= min_n) & (F.coalesce("n1", F.lit(0)) >= min_n)).alias("tested"),
    )


# STT-2 -------------------------------------------------------------------------------------
def welch_t(tall: DataFrame, label_col: str, moments: DataFrame | None = None) -> DataFrame:
    m = moments if moments is not None else class_moments(tall, label_col)
    per = m.groupBy("feature").agg(
        F.coalesce(F.max(F.when(F.col(label_col) == 0, F.col("n"))), F.lit(0)).alias("n0"),
        F.coalesce(F.max(F.when(F.col(label_col) == 1, F.col("n"))), F.lit(0)).alias("n1"),
        F.max(F.when(F.col(label_col) == 0, F.col("mean"))).alias("mean0"),
        F.max(F.when(F.col(label_col) == 1, F.col("mean"))).alias("mean1"),
        F.max(F.when(F.col(label_col) == 0, F.col("sd"))).alias("sd0"),
        F.max(F.when(F.col(label_col) == 1, F.col("sd"))).alias("sd1"),
    )
    a = F.col("sd0") * F.col("sd0") / F.col("n0")
    b = F.col("sd1") * F.col("sd1") / F.col("n1")
    t = F.try_divide(F.col("mean0") - F.col("mean1"), F.sqrt(a + b))
    df = F.try_divide((a + b) * (a + b), a * a / (F.col("n0") - F.lit(1)) + b * b / (F.col("n1") - F.lit(1)))
    out = per.withColumns({"t_stat": t, "df": df})
    return out.withColumn("p_value", student_t_two_sided(F.col("t_stat"), F.col("df")))


# STT-3 -------------------------------------------------------------------------------------
def value_counts(tall: DataFrame, label_col: str) -> DataFrame:
    """One pass: (feature, value, c0, c1) -- rows per distinct value and class (the rank statistics' input)."""
    return (
        _by_class(tall, label_col)
        .groupBy("feature", "value")
        .agg(
            F.count_if(F.col(label_col) == 0).cast("bigint").alias("c0"),
            F.count_if(F.col(label_col) == 1).cast("bigint").alias("c1"),
        )
    )


def mann_whitney(tall: DataFrame, label_col: str, counts: DataFrame | None = None) -> DataFrame:
    """U of group 0, two-sided asymptotic p with tie and continuity correction (per feature)."""
    counts = counts if counts is not None else value_counts(tall, label_col)
    pre = prefix_sums(counts, ["feature"], ["value"], ["c1"])
    per = pre.groupBy("feature").agg(
        F.sum(F.col("c0") * (F.col("c1_before") + F.col("c1") / F.lit(2.0))).alias("u0"),
        F.sum("c0").alias("n0"),
        F.sum("c1").alias("n1"),
        F.sum(F.pow((F.col("c0") + F.col("c1")).cast("double"), 3) - (F.col("c0") + F.col("c1"))).alias("tie_sum"),
    )
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    n = n0 + n1
    mu = n0 * n1 / F.lit(2.0)
    var = n0 * n1 / F.lit(12.0) * ((n + F.lit(1.0)) - F.col("tie_sum") / (n * (n - F.lit(1.0))))
    u = F.greatest(F.col("u0"), n0 * n1 - F.col("u0"))
    z = F.try_divide(u - mu - F.lit(0.5), F.sqrt(var))
    return per.select(
        "feature", "n0", "n1", "u0", z.alias("z"), F.coalesce(normal_two_sided(z), F.lit(1.0)).alias("p_value")
    )


# STT-4 -------------------------------------------------------------------------------------
def chi_square(tall_cat: DataFrame, label_col: str) -> DataFrame:
    """Per categorical feature: chi2 (Yates when dof = 1), dof, p.  Values are the observed categories."""
    obs = (
        tall_cat.filter(F.col("value").isNotNull() & F.col(label_col).isNotNull())
        .groupBy("feature", "value", label_col)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return chi_square_counts(obs, label_col)


def chi_square_counts(obs: DataFrame, label_col: str = "label") -> DataFrame:
    """Same test from a contingency table (feature, value, label, n) -- e.g. published counts."""
    obs = obs.select("feature", F.col("value").cast("string").alias("value"), label_col, F.col("n").alias("o"))
    # dense table: each observed (feature, value) row is expanded to the observed classes (<= #classes values,
    # read once as a literal list), so absent cells count as zeros
    classes = sorted(r[0] for r in obs.select(label_col).distinct().collect())
    values = obs.select("feature", "value").distinct()
    n_values = values.groupBy("feature").agg(F.count(F.lit(1)).alias("r"))
    w_feature = Window.partitionBy("feature")  # <= #classes rows
    per_class = obs.groupBy("feature", label_col).agg(F.sum("o").cast("double").alias("_in_class")).withColumns(
        {"_all": F.sum("_in_class").over(w_feature), "c": F.count(F.lit(1)).over(w_feature)}
    ).join(n_values, "feature")  # one row per feature and class
    grid = values.withColumn(label_col, F.explode(F.array(*[F.lit(c) for c in classes]))).join(
        F.broadcast(per_class), ["feature", label_col]
    )
    dense = grid.join(obs, ["feature", "value", label_col], "left").withColumn("o", F.coalesce("o", F.lit(0)).cast("double"))
    e = F.sum("o").over(Window.partitionBy("feature", "value")) * F.col("_in_class") / F.col("_all")
    cells = dense.withColumn("e", e).withColumn("dof", ((F.col("r") - 1) * (F.col("c") - 1)).cast("int"))
    diff = F.col("e") - F.col("o")
    yates = F.col("o") + F.signum(diff) * F.least(F.lit(0.5), F.abs(diff))
    o_adj = F.when(F.col("dof") == 1, yates).otherwise(F.col("o"))
    per = cells.groupBy("feature", "dof").agg(F.sum(F.pow(o_adj - F.col("e"), 2) / F.col("e")).alias("chi2"))
    per = per.withColumn("chi2", F.when(F.col("dof") == 0, F.lit(0.0)).otherwise(F.col("chi2")))
    return per.withColumn(
        "p_value", F.when(F.col("dof") == 0, F.lit(1.0)).otherwise(chi2_sf(F.col("chi2"), F.col("dof")))
    )


# STT-5 -------------------------------------------------------------------------------------
def hypothesis_tests(
    tall: DataFrame, tall_cat: DataFrame, label_col: str, alpha: float = 0.05, method: str = "exact"
) -> DataFrame:
    """Combined table: continuous features -> Welch if normal else Mann-Whitney; categorical -> chi-square."""
    moments = class_moments(tall, label_col)
    counts = value_counts(tall, label_col)
    gate = normality_gate(tall, label_col, moments=moments).filter(F.col("tested"))
    welch = welch_t(tall, label_col, moments=moments).select(
        "feature", F.col("t_stat").alias("w_stat"), F.col("p_value").alias("w_p"), F.col("mean0").alias("mean_group0"),
        F.col("mean1").alias("mean_group1"),
    )
    mwu = mann_whitney(tall, label_col, counts=counts).select("feature", F.col("u0").alias("m_stat"), F.col("p_value").alias("m_p"))
    per_class = counts.select("feature", "value", F.explode(F.array(
        F.struct(F.lit(0).alias("cls"), F.col("c0").alias("c")), F.struct(F.lit(1).alias("cls"), F.col("c1").alias("c"))
    )).alias("_x")).select("feature", "value", F.col("_x.cls").alias(label_col), F.col("_x.c").alias("c")).filter(F.col("c") > 0)
    med = quantiles_from_counts(per_class, ["feature", label_col], "value", "c", [0.5])
    meds = med.groupBy("feature").agg(
        F.max(F.when(F.col(label_col) == 0, F.col("value"))).alias("median_group0"),
        F.max(F.when(F.col(label_col) == 1, F.col("value"))).alias("median_group1"),
    )
    cont = (
        gate.join(welch, "feature")
        .join(mwu, "feature")
        .join(meds, "feature")
        .select(
            "feature",
            F.lit("Continuous").alias("type"),
            F.col("normal"),
            F.when(F.col("normal"), F.lit("Welch t-test")).otherwise(F.lit("Mann-Whitney U")).alias("test"),
            F.when(F.col("normal"), F.col("w_stat")).otherwise(F.col("m_stat")).alias("statistic"),
            F.when(F.col("normal"), F.col("w_p")).otherwise(F.col("m_p")).alias("p_value"),
            *[rdp(F.col(c), 4).alias(c) for c in ["mean_group0", "mean_group1", "median_group0", "median_group1"]],
        )
    )
    chi = chi_square(tall_cat, label_col).select(
        "feature",
        F.lit("Categorical").alias("type"),
        F.lit(None).cast("boolean").alias("normal"),
        F.lit("Chi-square").alias("test"),
        F.col("chi2").alias("statistic"),
        "p_value",
        *[F.lit(None).cast("double").alias(c) for c in ["mean_group0", "mean_group1", "median_group0", "median_group1"]],
    )
    allt = cont.unionByName(chi)
    return allt.select(
        "feature",
        "type",
        "normal",
        "test",
        rdp(F.col("statistic"), 4).alias("statistic"),
        rdp(F.col("p_value"), 6).alias("p_value"),
        (F.col("p_value") < F.lit(alpha)).alias("significant"),
        "mean_group0",
        "mean_group1",
        "median_group0",
        "median_group1",
        rdp(-F.log10(F.greatest(F.col("p_value"), F.lit(1e-300))), 4).alias("neg_log10_p"),
    )


# SRT-3 / SCL-15 ----------------------------------------------------------------------------
def display_name(c: F.Column) -> F.Column:
    """'qty_mean' -> 'qty (mean)': stat suffix in brackets, underscores as spaces."""
    m = F.regexp_replace(c, r"_(mean|max|min|std|last)$", " ($1)")
    return F.regexp_replace(m, "_", " ")


def top_features(results: DataFrame, k: int = 10) -> DataFrame:
    sig = results.filter(F.col("significant"))
    w = Window.orderBy(F.col("p_value").asc(), F.col("feature").asc())  # top-k report over <= #features rows
    return sig.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k).select(
        "rank", "feature", display_name(F.col("feature")).alias("display_name"), "test", "statistic", "p_value"
    )


# TRN-1 / AGG-16 / JN-8 ----------------------------------------------------------------------
def feature_select(results: DataFrame, zero_var: DataFrame, candidates: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Keep a candidate iff it was tested, is significant and is not constant; say why otherwise."""
    spark = results.sparkSession
    cand = spark.createDataFrame([(c,) for c in candidates], ["feature"])
    j = cand.join(results.select("feature", "p_value"), "feature", "left").join(
        zero_var.select("feature", "zero_variance"), "feature", "left"
    )
    zero = F.coalesce(F.col("zero_variance"), F.lit(False))
    reason = (
        F.when(zero, F.lit("zero variance"))
        .when(F.col("p_value").isNull(), F.lit("not tested"))
        .when(F.col("p_value") >= F.lit(alpha), F.concat(F.lit("p="), F.format_number(F.col("p_value"), 6)))
    )
    return j.select("feature", "p_value", zero.alias("zero_variance"), reason.isNull().alias("keep"), reason.alias("reason"))


# AGG-23 -------------------------------------------------------------------------------------
def run_summary(results: DataFrame, high_pairs: DataFrame, zero_var: DataFrame) -> DataFrame:
    tagged = (
        results.select(F.lit("test").alias("_t"), F.col("significant").alias("_f"))
        .unionByName(high_pairs.select(F.lit("pair").alias("_t"), F.lit(True).alias("_f")))
        .unionByName(zero_var.select(F.lit("zero").alias("_t"), F.col("zero_variance").alias("_f")))
    )
    out = tagged.agg(
        F.count_if(F.col("_t") == "test").cast("bigint").alias("n_tested"),
        F.count_if((F.col("_t") == "test") & F.col("_f")).cast("bigint").alias("n_significant"),
        F.count_if(F.col("_t") == "pair").cast("bigint").alias("n_high_corr_pairs"),
        F.count_if((F.col("_t") == "zero") & F.col("_f")).cast("bigint").alias("n_zero_variance"),
    )
    return out.withColumn(
        "share_significant", F.try_divide(F.col("n_significant").cast("double"), F.col("n_tested").cast("double"))
    )
