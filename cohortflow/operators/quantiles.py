"""Grouped quantiles with linear interpolation (position h = q * (n - 1)).

``method="exact"`` (default) never gathers a group in one task: it counts rows per distinct value, gets
each value's rank range with the distributed prefix sum, and picks the two values around each position.
``method="approx"`` uses ``percentile_approx`` (bounded sketch, partial aggregation) for very large groups
where a small rank error is acceptable.

``column_quantiles`` takes whole columns of a wide table: a sketch brackets every position, and only the rows inside the
brackets are counted and put in order.  Exact as well; a bracket that misses its position is seen and done in full.

The group size comes with the running sums (same window / offsets), so no extra aggregate or join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.operators.prefix import prefix_sums


def quantiles(
    df: DataFrame,
    group_cols: Sequence[str],
    value_col: str,
    probs: Sequence[float],
    method: str = "exact",
    accuracy: int = 100000,
) -> DataFrame:
    """Long result: group_cols..., ``q`` (double), ``value`` (double).  Groups with no values are absent."""
    group_cols = list(group_cols)
    base = df.select(*group_cols, F.col(value_col).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    if method == "approx":
        arr = F.percentile_approx("_v", [float(p) for p in probs], accuracy)
        agg = base.groupBy(*group_cols).agg(arr.alias("_vals"))
        return agg.select(
            *group_cols,
            F.posexplode(F.col("_vals")).alias("_i", "value"),
        ).select(*group_cols, F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_i") + 1).alias("q"), "value")

    counts = base.groupBy(*group_cols, "_v").agg(F.count(F.lit(1)).alias("_c"))
    return quantiles_from_counts(counts, group_cols, "_v", "_c", probs)


def quantiles_from_counts(
    counts: DataFrame, group_cols: Sequence[str], value_col: str, count_col: str, probs: Sequence[float]
) -> DataFrame:
    """Same result from an already aggregated (group..., value, count) table (counts > 0, values non-null)."""
    group_cols = list(group_cols)
    counts = counts.select(*group_cols, F.col(value_col).cast("double").alias("_v"), F.col(count_col).cast("long").alias("_c"))
    pre = prefix_sums(counts, group_cols, ["_v"], ["_c"])
    qs = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("q")
    with_pos = pre.select(*group_cols, "_v", "_c_before", "_c_upto", F.col("_c_total").alias("_n"), qs)
    h = (F.col("_n") - F.lit(1)).cast("double") * F.col("q")
    lo = F.floor(h)
    hi = F.ceil(h)
    in_row = lambda pos: (F.col("_c_before") <= pos) & (pos < F.col("_c_upto"))
    picked = with_pos.select(
        *group_cols,
        "q",
        (h - lo).alias("_d"),
        F.when(in_row(lo), F.col("_v")).alias("_lo"),
        F.when(in_row(hi), F.col("_v")).alias("_hi"),
    ).filter(F.col("_lo").isNotNull() | F.col("_hi").isNotNull())
    agg = picked.groupBy(*group_cols, "q").agg(
        F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.max("_d").alias("_d")
    )
    return agg.select(
        *group_cols,
        "q",
        (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_d")).alias("value"),
    )


def quantiles_wide(
    df: DataFrame,
    group_cols: Sequence[str],
    value_col: str,
    named_probs: dict[str, float],
    method: str = "exact",
) -> DataFrame:
    """One row per group with one column per named probability, e.g. {'q1': .25, 'q3': .75}."""
    long = quantiles(df, group_cols, value_col, list(named_probs.values()), method)
    aggs = [F.max(F.when(F.col("q") == F.lit(float(p)), F.col("value"))).alias(name) for name, p in named_probs.items()]
    if group_cols:
        return long.groupBy(*group_cols).agg(*aggs)
    return long.agg(*aggs)


def column_quantiles(df: DataFrame, columns: Sequence[str], named_probs: dict[str, float], accuracy: int = 1000) -> dict[str, dict[str, float | None]]:
    """{column: {name: quantile}} of the non-NULL values (None without any): three scans, and a shuffle of the rows in the
    brackets, about 6 / accuracy of all for each quantile."""
    columns, names = list(columns), list(named_probs)
    if not columns:
        return {}
    spark = df.sparkSession
    wide = df.select(*[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)])
    ends = [x for q in named_probs.values() for x in (max(0.0, q - 3.0 / accuracy), min(1.0, q + 3.0 / accuracy))]
    sketch = wide.agg(*[a for i in range(len(columns)) for a in (F.count(f"_c{i}").alias(f"n{i}"), F.percentile_approx(f"_c{i}", ends, accuracy).alias(f"s{i}"))]).first()
    spans = [(i, j, sketch[f"s{i}"][2 * j], sketch[f"s{i}"][2 * j + 1]) for i in range(len(columns)) if sketch[f"n{i}"] for j in range(len(names))]
    out = {c: dict.fromkeys(names) for c in columns}
    if not spans:
        return out
    below = wide.agg(*[F.count_if(F.col(f"_c{i}") < F.lit(lo)).alias(f"b{x}") for x, (i, _, lo, _) in enumerate(spans)]).first()
    inside = F.array(*[F.when(F.col(f"_c{i}").between(F.lit(lo), F.lit(hi)), F.struct(F.lit(x).alias("_i"), F.col(f"_c{i}").alias("_v"))) for x, (i, _, lo, hi) in enumerate(spans)])
    counts = wide.select(F.inline(F.filter(inside, lambda s: s.isNotNull()))).groupBy("_i", "_v").agg(F.count(F.lit(1)).alias("_c"))
    places = spark.createDataFrame([(x, below[f"b{x}"], sketch[f"n{i}"], float(named_probs[names[j]])) for x, (i, j, _, _) in enumerate(spans)], "_i int, _b long, _n long, _q double")
    at = prefix_sums(counts, ["_i"], ["_v"], ["_c"]).join(F.broadcast(places), "_i")  # one row per quantile
    h = (F.col("_n") - F.lit(1)).cast("double") * F.col("_q")
    value = lambda pos: F.max(F.when((F.col("_b") + F.col("_c_before") <= pos) & (pos < F.col("_b") + F.col("_c_upto")), F.col("_v")))
    found = at.groupBy("_i").agg(value(F.floor(h)).alias("lo"), value(F.ceil(h)).alias("hi"), F.max(h - F.floor(h)).alias("d")).collect()
    missed = {columns[i] for i, _, _, _ in spans}
    got = {r["_i"]: r["lo"] + (r["hi"] - r["lo"]) * r["d"] for r in found if r["lo"] is not None and r["hi"] is not None}
    for c in list(missed):
        mine = {names[j]: x for x, (i, j, _, _) in enumerate(spans) if columns[i] == c}
        if all(x in got for x in mine.values()):
            out[c] = {name: got[x] for name, x in mine.items()}
            missed.discard(c)
    if missed:
        rest = [c for c in columns if c in missed]
        tall = df.select(*[F.col(c).cast("double").alias(c) for c in rest]).unpivot([], rest, "feature", "value")
        for r in quantiles_wide(tall, ["feature"], "value", named_probs).collect():  # one row a column
            out[r["feature"]] = {name: r[name] for name in names}
    return out
