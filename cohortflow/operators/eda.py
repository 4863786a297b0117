"""Descriptive statistics over a labelled entity table, computed on the tall form.

``to_tall`` unpivots the feature columns once to ``(id, label, feature, value)``; every operator below is a
single grouped pass over that table (all features at once), never one job per feature.  Group keys are
schema-level (feature, class), so their small result tables may be broadcast back.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.functions.scalar import rdp
from cohortflow.operators import count_stats
from cohortflow.operators.count_stats import ALL
from cohortflow.session import cut_lineage

CLASS_NAMES = {0: "No Complication", 1: "Complication"}  # fixed display names of the two classes


def to_tall(
    df: DataFrame, id_col: str, label_col: str, features: Sequence[str], value_type: str = "double"
) -> DataFrame:
    """(id, label, feature, value) -- one row per entity and feature; NULL values kept."""
    cast = df.select(id_col, label_col, *[F.col(f).cast(value_type).alias(f) for f in features])
    return cast.unpivot([id_col, label_col], list(features), "feature", "value")


# AGG-9 / SRC-5 ------------------------------------------------------------------------------
def profile(df: DataFrame, group_col: str, entity_col: str, value_col: str, ts_col: str) -> DataFrame:
    return df.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(entity_col).alias("n_entities"),
        F.count(value_col).alias("n_values"),
        F.count_if(F.col(value_col).isNull()).cast("bigint").alias("n_missing"),
        F.min(ts_col).alias("first_at"),
        F.max(ts_col).alias("last_at"),
    )


# AGG-10 / PRJ-7 -----------------------------------------------------------------------------
def class_balance(df: DataFrame, label_col: str, names: dict[int, str] = CLASS_NAMES) -> DataFrame:
    name = None
    for k, v in names.items():
        name = F.when(F.col(label_col) == k, F.lit(v)) if name is None else name.when(F.col(label_col) == k, F.lit(v))
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # <= number of classes rows
    return counts.select(label_col, name.alias("class_name"), "n", (F.col("n") / total).alias("share"))


# AGG-11 -------------------------------------------------------------------------------------
def frequency_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts per (column, value) including the NULL category; pct of rows rounded to 2 places."""
    tall = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "feature", "value")
    counts = tall.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("feature"))
    return counts.select("feature", "value", "n", rdp(F.col("n") * F.lit(100.0) / total, 2).alias("pct"))


# AGG-12 -------------------------------------------------------------------------------------
def crosstab_margins(tall_cat: DataFrame, label_col: str) -> DataFrame:
    """Counts per (feature, value, label) with row, column and grand totals ('All')."""
    g = tall_cat.select("feature", F.col("value").cast("string").alias("value"), F.col(label_col).cast("string").alias("lbl"))
    agg = g.groupingSets(
        [["feature", "value", "lbl"], ["feature", "value"], ["feature", "lbl"], ["feature"]], "feature", "value", "lbl"
    ).agg(F.count(F.lit(1)).alias("n"), F.grouping("value").alias("gv"), F.grouping("lbl").alias("gl"))
    return agg.select(
        "feature",
        F.when(F.col("gv") == 1, F.lit(ALL)).otherwise(F.coalesce("value", F.lit("NULL"))).alias("value"),
        F.when(F.col("gl") == 1, F.lit(ALL)).otherwise(F.col("lbl")).alias(label_col),
        "n",
    )


# AGG-13 -------------------------------------------------------------------------------------
def crosstab_pct(tall_cat: DataFrame, label_col: str, labels: Sequence[int] = (0, 1)) -> DataFrame:
    """Dense (feature, value, label) grid with count, % within label (column) and % within value (row)."""
    g = tall_cat.select("feature", F.coalesce(F.col("value").cast("string"), F.lit("NULL")).alias("value"), F.col(label_col))
    counts = g.groupBy("feature", "value", label_col).agg(F.count(F.lit(1)).alias("n"))
    domain = counts.select("feature", "value").distinct()
    grid = domain.withColumn(label_col, F.explode(F.array(*[F.lit(int(x)) for x in labels])))  # fixed label domain
    dense = grid.join(counts, ["feature", "value", label_col], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    col_tot = F.sum("n").over(Window.partitionBy("feature", label_col))
    row_tot = F.sum("n").over(Window.partitionBy("feature", "value"))
    return dense.select(
        "feature",
        "value",
        F.col(label_col).cast("int").alias(label_col),
        F.col("n").cast("bigint").alias("n"),
        F.coalesce(F.try_divide(F.col("n") * F.lit(100.0), col_tot), F.lit(0.0)).alias("pct_of_label"),
        F.coalesce(F.try_divide(F.col("n") * F.lit(100.0), row_tot), F.lit(0.0)).alias("pct_of_value"),
    )


# AGG-14 -------------------------------------------------------------------------------------
def describe_by_group(tall: DataFrame, label_col: str, digits: int = 4) -> DataFrame:
    """feature x group(All/0/1): n, mean, median, std, min, max, IQR (rounded)."""
    return _rounded(count_stats.group_statistics(tall, label_col), digits)


def _rounded(st: DataFrame, digits: int) -> DataFrame:
    return st.select(
        "feature",
        "grp",
        "n",
        *[rdp(F.col(c), digits).alias(c) for c in ["mean", "median", "std", "min", "max"]],
        rdp(F.col("q3") - F.col("q1"), digits).alias("iqr"),
    )


def describe_wide(tall: DataFrame, label_col: str, digits: int = 4) -> DataFrame:
    """SET-3: one row per feature, the statistics of All, 0 and 1 side by side ({group}_{statistic})."""
    groups = count_stats.group_names()
    wide = count_stats.wide_statistics(count_stats.ranked_counts(count_stats.count_table(tall, label_col), groups), groups)
    out = []
    for g in groups:
        out += [F.col(f"{g}_n"), *[rdp(F.col(f"{g}_{c}"), digits).alias(f"{g}_{c}") for c in ["mean", "median", "std", "min", "max"]],
                rdp(F.col(f"{g}_q3") - F.col(f"{g}_q1"), digits).alias(f"{g}_iqr")]
    return wide.select("feature", *out)


# AGG-15 -------------------------------------------------------------------------------------
def missing_ratio(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return row.unpivot([], list(columns), "feature", "missing_ratio")


# AGG-16 -------------------------------------------------------------------------------------
def zero_variance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A column is constant when it has at most one distinct non-null value, i.e. min == max (or all NULL):
    one pass of min/max, no distinct aggregation."""
    row = df.agg(*[(F.coalesce(F.min(c) == F.max(c), F.lit(True))).alias(c) for c in columns])
    return row.unpivot([], list(columns), "feature", "zero_variance")


# AGG-17 / JN-7 / SRT-6 ---------------------------------------------------------------------
def _guarded_corr(a: Column, b: Column) -> Column:
    both = a.isNotNull() & b.isNotNull()
    aa, bb = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(aa, bb), F.stddev_pop(aa) * F.stddev_pop(bb))


def correlation_pairs(df: DataFrame, columns: Sequence[str], include_diagonal: bool = False) -> DataFrame:
    """Pearson r with pairwise deletion for every pair i<j, from masked Gram matrices.

    One pass: every task turns its Arrow batches into k x k partial sums (pair counts, sums, sums of squares
    and cross products over the rows where both columns are present) with numpy, values shifted by the
    column means for numerical stability; a grouped sum over (#tasks x k^2) rows finishes it.  r is NULL
    when either column is constant over the pair's rows (never a division error)."""
    cols = list(columns)
    k = len(cols)
    shift_row = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).first()  # k numbers
    shift = np.array([shift_row[c] if shift_row[c] is not None else 0.0 for c in cols], dtype=float)
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)] + ([(i, i) for i in range(k)] if include_diagonal else [])
    pi = np.array([p[0] for p in pairs], dtype=int)
    pj = np.array([p[1] for p in pairs], dtype=int)

    def partial(batches):
        n = np.zeros((k, k)); sx = np.zeros((k, k)); sxx = np.zeros((k, k)); sxy = np.zeros((k, k))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float) - shift
            m = ~np.isnan(x)
            x0 = np.where(m, x, 0.0)
            mf = m.astype(float)
            n += mf.T @ mf
            sx += x0.T @ mf          # [i, j] = sum of x_i over rows where i and j are present
            sxx += (x0 * x0).T @ mf
            sxy += x0.T @ x0
        yield pd.DataFrame({
            "i": pi, "j": pj, "n": n[pi, pj], "sx": sx[pi, pj], "sy": sx[pj, pi],
            "sxx": sxx[pi, pj], "syy": sxx[pj, pi], "sxy": sxy[pi, pj],
        })

    vals = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    parts = vals.mapInPandas(partial, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
    tot = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ["n", "sx", "sy", "sxx", "syy", "sxy"]])
    cov = F.col("sxy") / F.col("n") - (F.col("sx") / F.col("n")) * (F.col("sy") / F.col("n"))
    vx = F.col("sxx") / F.col("n") - F.pow(F.col("sx") / F.col("n"), 2)
    vy = F.col("syy") / F.col("n") - F.pow(F.col("sy") / F.col("n"), 2)
    den = F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0)))
    names = F.array(*[F.lit(c) for c in cols])
    r = F.when((F.col("n") > 0) & (den > F.lit(1e-300)), F.least(F.greatest(cov / den, F.lit(-1.0)), F.lit(1.0)))
    return tot.select(
        F.element_at(names, F.col("i") + 1).alias("feature_a"), F.element_at(names, F.col("j") + 1).alias("feature_b"), r.alias("r")
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    up = correlation_pairs(df, columns, include_diagonal=True)
    lower = up.filter(F.col("feature_a") != F.col("feature_b")).select(
        F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), "r"
    )
    return up.unionByName(lower)


def high_correlation(pairs: DataFrame, threshold: float = 0.9) -> DataFrame:
    hi = pairs.filter(F.abs("r") > F.lit(threshold)).withColumn("abs_r", F.abs("r"))
    w = Window.orderBy(F.col("abs_r").desc(), "feature_a", "feature_b")  # <= #feature pairs rows
    return hi.withColumn("rank", F.row_number().over(w).cast("bigint"))


# AGG-19 -------------------------------------------------------------------------------------
def histogram(tall: DataFrame, bins: int = 40) -> DataFrame:
    """Equal-width bins over [min, max] per feature (last bin closed) with density = n / (N * width); empty bins too.
    A feature with a single value has the first bin alone."""
    v = tall.filter(F.col("value").isNotNull())
    rng = v.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("total"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    idx = F.when(
        F.col("hi") > F.col("lo"),
        F.least(F.floor((F.col("value") - F.col("lo")) * F.lit(float(bins)) / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)),
    ).otherwise(F.lit(0))
    found = v.join(F.broadcast(rng), "feature").groupBy("feature", idx.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_bins = rng.select("*", F.explode(F.sequence(F.lit(0), F.when(F.col("hi") > F.col("lo"), bins - 1).otherwise(0))).alias("bin"))
    counts = all_bins.join(found, ["feature", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return counts.select(
        "feature",
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
        (F.col("lo") + (F.col("bin") + F.lit(1)) * width).alias("bin_hi"),
        "n",
        F.when(width > 0, F.col("n") / (F.col("total") * width)).alias("density"),
    )


# AGG-20 -------------------------------------------------------------------------------------
def kde_curve(tall: DataFrame, grid_points: int = 1000) -> DataFrame:
    """Exact Gaussian KDE with Scott's bandwidth (n^-1/5 * sample std) on a grid spanning +-half the range.

    Values are first counted, so equal ones cost one kernel.  A task adds the kernels of its distinct values up over the
    fixed grid of each feature (arrays of ``grid_points``, whatever the number of rows) and sends one row a grid point;
    those are summed.  What the tasks are given is one grid a feature.  A feature without spread has no density."""
    v = tall.filter(F.col("value").isNotNull())
    st = v.groupBy("feature").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n"), F.stddev_samp("value").alias("sd")
    )
    span = F.col("hi") - F.col("lo")
    st = cut_lineage(st.select(
        "feature", "n", (F.pow(F.col("n").cast("double"), F.lit(-0.2)) * F.col("sd")).alias("h"),
        (F.col("lo") - F.lit(0.5) * span).alias("g0"), ((F.lit(2.0) * span) / F.lit(float(grid_points - 1))).alias("step"),
    ))
    grids = {r["feature"]: (r["g0"] + np.arange(grid_points) * r["step"], r["h"]) for r in st.collect() if r["h"]}  # <= #features rows

    def kernels(batches):
        total = {f: np.zeros(grid_points) for f in grids}
        for b in batches:
            names, values, counts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(), b.column(2).to_numpy()
            for f in grids.keys() & set(names):
                x, h = grids[f]
                mine = np.flatnonzero(names == f)
                for i in range(0, len(mine), 256):
                    at = mine[i : i + 256]
                    total[f] += np.exp(-0.5 * ((x[:, None] - values[at]) / h) ** 2) @ counts[at]
        for f, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([f] * grid_points, pa.string()), pa.array(np.arange(grid_points, dtype=np.int32)), pa.array(t)], ["feature", "i", "k"])

    counts = v.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c"))
    sums = counts.mapInArrow(kernels, "feature string, i int, k double").groupBy("feature", "i").agg(F.sum("k").alias("k"))
    grid = st.select("*", F.explode(F.sequence(F.lit(0), F.lit(grid_points - 1))).alias("i"))
    norm = F.col("n") * F.col("h") * F.lit(2.5066282746310002)  # n * h * sqrt(2*pi)
    return grid.join(sums, ["feature", "i"], "left").select(
        "feature", "i", (F.col("g0") + F.col("i") * F.col("step")).alias("x"), F.when(F.col("h") > 0, F.col("k") / norm).alias("density"))


# AGG-21 -------------------------------------------------------------------------------------
def box_stats(tall: DataFrame, label_col: str, whisker: float = 1.5) -> DataFrame:
    """Per feature and group: quartiles, whiskers (extreme data within 1.5 IQR), flier count."""
    return count_stats.box_statistics(tall, label_col, whisker)


# AGG-22 -------------------------------------------------------------------------------------
def flag_prevalence(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    tall = df.select(*[F.col(f).cast("double").alias(f) for f in flags]).unpivot([], list(flags), "flag", "v")
    return tall.groupBy("flag").agg(
        F.sum("v").cast("bigint").alias("n_positive"), (F.avg("v") * F.lit(100.0)).alias("pct_positive")
    )
