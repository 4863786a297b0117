"""Group statistics from one count table (AGG-14, AGG-21, SET-3).

Rows are reduced once to (feature, value) with one count per group -- all rows and each label -- so the groups are
columns, not copies of the rows.  One running sum over these counts (`prefix.prefix_sums`, which spreads a hot feature over many
tasks) gives the ranks of all groups together; a single grouped pass then picks every quartile, and takes means,
deviations and extremes by weighting values with their counts.  Box fences need a second pass over the same counts.

Edge cases: NULL values count nowhere; a row without a label, or with one that is not listed, counts in `All` only; a
group without values has no row in the long form and NULLs (count 0) in the wide one; the deviation of one value is NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.operators.prefix import prefix_sums

ALL = "All"
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
MOMENTS = ("n", "mean", "std", "min", "max")


def group_names(labels: Sequence[int] = (0, 1)) -> list[str]:
    return [ALL, *[str(x) for x in labels]]


def count_table(tall: DataFrame, label_col: str, labels: Sequence[int] = (0, 1)) -> DataFrame:
    """(feature, value, n_All, n_0, n_1, ...): how often each group has each value; one partial aggregation."""
    per_label = [F.count_if(F.col(label_col) == x).alias(f"n_{x}") for x in labels]
    known = tall.select("feature", F.col("value").cast("double").alias("value"), label_col).filter(F.col("value").isNotNull())
    return known.groupBy("feature", "value").agg(F.count(F.lit(1)).alias(f"n_{ALL}"), *per_label)


def ranked_counts(counts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The count table with each group's rank range per value (`_before`, `_upto`, `_total`) and sum of values."""
    sums = counts.withColumns({f"s_{g}": F.when(F.col(f"n_{g}") > 0, F.col("value") * F.col(f"n_{g}")).otherwise(F.lit(0.0)) for g in groups})
    return prefix_sums(sums, ["feature"], ["value"], [f"{kind}_{g}" for g in groups for kind in ("n", "s")])


def _quartile(g: str, q: float) -> Column:
    """The value at position q * (n - 1) of a group, between its two neighbours where that is no integer."""
    h = (F.col(f"n_{g}_total") - 1).cast("double") * F.lit(q)
    at = lambda pos: F.max(F.when((F.col(f"n_{g}_before") <= pos) & (pos < F.col(f"n_{g}_upto")), F.col("value")))
    lo, hi, part = at(F.floor(h)), at(F.ceil(h)), F.max(h - F.floor(h))
    return lo + (hi - lo) * part


def wide_statistics(ranked: DataFrame, groups: Sequence[str]) -> DataFrame:
    """One row per feature: {group}_{n, mean, std, min, max, q1, median, q3}."""
    out = []
    for g in groups:
        n, here = F.col(f"n_{g}"), F.col(f"n_{g}") > 0
        mean = F.try_divide(F.col(f"s_{g}_total"), F.col(f"n_{g}_total").cast("double"))
        out += [
            F.max(f"n_{g}_total").alias(f"{g}_n"),
            F.max(F.when(here, mean)).alias(f"{g}_mean"),
            F.sqrt(F.try_divide(F.sum(F.when(here, n * F.pow(F.col("value") - mean, 2))), F.max(F.col(f"n_{g}_total") - 1).cast("double"))).alias(f"{g}_std"),
            F.min(F.when(here, F.col("value"))).alias(f"{g}_min"),
            F.max(F.when(here, F.col("value"))).alias(f"{g}_max"),
            *[_quartile(g, q).alias(f"{g}_{name}") for name, q in QUARTILES.items()],
        ]
    return ranked.groupBy("feature").agg(*out)


def long_form(wide: DataFrame, groups: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(feature, grp, fields ...) of the groups that have values; an explode of one row per feature."""
    per_group = [F.struct(F.lit(g).alias("grp"), *[F.col(f"{g}_{f}").alias(f) for f in fields]) for g in groups]
    return wide.select("feature", F.inline(F.array(*per_group))).filter(F.col(fields[0]) > 0)


def group_statistics(tall: DataFrame, label_col: str, labels: Sequence[int] = (0, 1)) -> DataFrame:
    """(feature, grp, n, mean, std, min, max, q1, median, q3) for all rows and every label."""
    groups = group_names(labels)
    return long_form(wide_statistics(ranked_counts(count_table(tall, label_col, labels), groups), groups), groups, [*MOMENTS, *QUARTILES])


def box_statistics(tall: DataFrame, label_col: str, whisker: float = 1.5, labels: Sequence[int] = (0, 1)) -> DataFrame:
    """(feature, grp, q1, median, q3, whisker_lo, whisker_hi, n_fliers): whiskers are the extreme values within the fences."""
    groups = group_names(labels)
    ranked = ranked_counts(count_table(tall, label_col, labels), groups)  # checkpointed: both passes read it
    wide = wide_statistics(ranked, groups)
    reach = {g: (F.col(f"{g}_q3") - F.col(f"{g}_q1")) * F.lit(whisker) for g in groups}
    fences = wide.select("feature", *[c.alias(f"{g}_{name}") for g in groups for name, c in
                                      (("n", F.col(f"{g}_n")), ("q1", F.col(f"{g}_q1")), ("median", F.col(f"{g}_median")), ("q3", F.col(f"{g}_q3")),
                                       ("lo", F.col(f"{g}_q1") - reach[g]), ("hi", F.col(f"{g}_q3") + reach[g]))])
    met = ranked.select("feature", "value", *[f"n_{g}" for g in groups]).join(F.broadcast(fences), "feature")  # one row a feature: bounded by schema
    out = []
    for g in groups:
        here = F.col(f"n_{g}") > 0
        inside = (F.col("value") >= F.col(f"{g}_lo")) & (F.col("value") <= F.col(f"{g}_hi"))
        out += [*[F.max(f"{g}_{x}").alias(f"{g}_{x}") for x in ("n", "q1", "median", "q3")],
                F.min(F.when(here & inside, F.col("value"))).alias(f"{g}_whisker_lo"),
                F.max(F.when(here & inside, F.col("value"))).alias(f"{g}_whisker_hi"),
                F.sum(F.when(inside, F.lit(0)).otherwise(F.col(f"n_{g}"))).cast("bigint").alias(f"{g}_n_fliers")]
    return long_form(met.groupBy("feature").agg(*out), groups, ["n", "q1", "median", "q3", "whisker_lo", "whisker_hi", "n_fliers"]).drop("n")
