"""Distributed running sums and running statistics.

A global running sum (``Window.orderBy`` without ``partitionBy``) puts every row in one task, and a window per group
does the same to a hot group.  Instead, at every size:

1. range-partition the (already collapsed) rows by (group, order key); each partition holds one slice of the
   order, so a hot group is spread over many tasks;
2. materialise that partitioning with a reliable checkpoint (slice ids stay stable on retries and
   AQE cannot re-coalesce the two readers differently);
3. total each (slice, group).  Slices are contiguous, so at most two groups of a slice (its first and its last) reach
   into another slice: the state carried into a slice is a table of at most two rows a slice, which is broadcast;
4. running value inside each (slice, group), combined with the carried state.

The result is exact, NULL is a group like any other, and the input is read once.  Callers collapse duplicates first
(counts per distinct value), which is the large reduction for ROC / Mann-Whitney / quantiles, where values repeat.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.session import cut_lineage

_PID = "_slice"


def _sliced(df: DataFrame, group_cols: Sequence[str], ords: list[Column], num_partitions: int | None) -> DataFrame:
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(g).asc() for g in group_cols], *ords)
    return cut_lineage(ranged.withColumn(_PID, F.spark_partition_id()))


def _straddling(totals: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """The (slice, group) rows of groups in several slices: at most two a slice."""
    whole = Window.partitionBy(*group_cols)
    return totals.withColumn("_slices", F.count(F.lit(1)).over(whole)).filter(F.col("_slices") > 1).drop("_slices")


def _carry(ranged: DataFrame, carried: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Left join of the carried state; NULL groups meet."""
    names = {g: f"_g{i}" for i, g in enumerate([_PID, *group_cols])}
    small = F.broadcast(carried.withColumnsRenamed(names))
    on = F.lit(True)
    for g, name in names.items():
        on = on & F.col(g).eqNullSafe(F.col(name))
    return ranged.join(small, on, "left").drop(*names.values())


def prefix_sums(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    sum_cols: Sequence[str],
    descending: bool = False,
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``{c}_before`` (sum over rows strictly earlier in the group's order), ``{c}_upto`` (inclusive) and
    ``{c}_total`` (the whole group).

    Rows with equal order keys are summed in an arbitrary but fixed sequence, so collapse ties first."""
    ords: list[Column] = [F.col(c).desc() if descending else F.col(c).asc() for c in order_cols]
    ranged = _sliced(df, group_cols, ords, num_partitions)
    totals = ranged.groupBy(_PID, *group_cols).agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    earlier = Window.partitionBy(*group_cols).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    others = Window.partitionBy(*group_cols)
    carried = _straddling(totals, group_cols).select(
        _PID, *group_cols,
        *[F.sum(f"_t_{c}").over(earlier).alias(f"_o_{c}") for c in sum_cols],
        *[F.sum(f"_t_{c}").over(others).alias(f"_w_{c}") for c in sum_cols],
    )
    inside = Window.partitionBy(_PID, *group_cols)
    upto = inside.orderBy(*ords).rowsBetween(Window.unboundedPreceding, 0)
    out = _carry(ranged, carried, group_cols).select(
        *[F.col(c) for c in df.columns],
        *[(F.coalesce(F.col(f"_o_{c}"), F.lit(0)) + F.sum(c).over(upto)).alias(f"{c}_upto") for c in sum_cols],
        *[F.coalesce(F.col(f"_w_{c}"), F.sum(c).over(inside)).alias(f"{c}_total") for c in sum_cols],
    )
    return out.withColumns({f"{c}_before": F.col(f"{c}_upto") - F.col(c) for c in sum_cols})


def merge_moments(a, b, field) -> Column:
    """Pairwise merge of two states (n, mean, m2, hi, lo), read by field(state, name)."""
    na, nb = field(a, "n"), field(b, "n")
    n, d = na + nb, field(b, "mean") - field(a, "mean")
    both = (na > 0) & (nb > 0)
    mean = F.when(both, field(a, "mean") + d * nb / n).when(nb > 0, field(b, "mean")).otherwise(field(a, "mean"))
    m2 = F.when(both, field(a, "m2") + field(b, "m2") + d * d * na * nb / n).when(nb > 0, field(b, "m2")).otherwise(field(a, "m2"))
    return F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"),
                    F.greatest(field(a, "hi"), field(b, "hi")).alias("hi"), F.least(field(a, "lo"), field(b, "lo")).alias("lo"))


def moments(v: Column, over=None) -> Column:
    """(n, mean, m2, hi, lo) of a value, as an aggregate or over a window."""
    at = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    n = at(F.count(v)).cast("double")
    return F.struct(n.alias("n"), F.coalesce(at(F.avg(v)), F.lit(0.0)).alias("mean"),
                    F.coalesce(at(F.var_pop(v)) * n, F.lit(0.0)).alias("m2"), at(F.max(v)).alias("hi"), at(F.min(v)).alias("lo"))


_NOTHING = "named_struct('n', 0D, 'mean', 0D, 'm2', 0D, 'hi', cast(null as double), 'lo', cast(null as double))"


def running_stats(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    value_cols: Sequence[str],
    num_partitions: int | None = None,
) -> DataFrame:
    """Expanding (history + current row) count / mean / max / min / sample std per value column.

    Same scheme as ``prefix_sums``; the carried state is (count, mean, sum of squared deviations, max, min), merged
    pairwise, so large means cost no digits.  Order keys must be unique within a group.  NULL values are skipped like
    SQL aggregates.  Adds ``{c}_n``, ``{c}_mean``, ``{c}_max``, ``{c}_min``, ``{c}_std`` (NULL for fewer than two values)."""
    ords = [F.col(c).asc() for c in order_cols]
    ranged = _sliced(df, group_cols, ords, num_partitions)
    field = lambda s, name: s.getField(name)
    value = lambda c: F.col(c).cast("double")
    totals = ranged.groupBy(_PID, *group_cols).agg(*[moments(value(c)).alias(f"_t_{c}") for c in value_cols])
    several = _straddling(totals, group_cols)
    # one array of slices per straddling group; all arrays together hold at most two entries a slice
    arrays = several.groupBy(*group_cols).agg(F.sort_array(F.collect_list(F.struct(_PID, *[f"_t_{c}" for c in value_cols]))).alias("_a"))

    def before(c: str) -> Column:
        start = F.struct(F.expr(_NOTHING).alias("now"), F.expr(f"slice(array({_NOTHING}), 1, 0)").alias("out"))
        step = lambda acc, x: F.struct(merge_moments(acc["now"], x[f"_t_{c}"], field).alias("now"),
                                       F.concat(acc["out"], F.array(acc["now"])).alias("out"))
        return F.aggregate("_a", start, step, lambda acc: acc["out"])

    carried = arrays.withColumns({_PID: F.col(f"_a.{_PID}"), **{f"_o_{c}": before(c) for c in value_cols}}).select(
        *group_cols, F.inline(F.arrays_zip(_PID, *[f"_o_{c}" for c in value_cols])))
    upto = Window.partitionBy(_PID, *group_cols).orderBy(*ords).rowsBetween(Window.unboundedPreceding, 0)
    nothing = F.expr(_NOTHING)
    joined = _carry(ranged, carried, group_cols).select(
        *[F.col(c) for c in df.columns],
        *[F.coalesce(F.col(f"_o_{c}"), nothing).alias(f"_o_{c}") for c in value_cols],
        *[moments(value(c), upto).alias(f"_i_{c}") for c in value_cols],
    ).withColumns({f"_s_{c}": merge_moments(F.col(f"_o_{c}"), F.col(f"_i_{c}"), field) for c in value_cols})
    cols = []
    for c in value_cols:
        s = F.col(f"_s_{c}")
        cols += [
            s["n"].cast("long").alias(f"{c}_n"),
            F.when(s["n"] > 0, s["mean"]).alias(f"{c}_mean"),
            s["hi"].alias(f"{c}_max"),
            s["lo"].alias(f"{c}_min"),
            F.when(s["n"] > 1, F.sqrt(s["m2"] / (s["n"] - 1))).alias(f"{c}_std"),
        ]
    return joined.select(*[F.col(c) for c in df.columns], *cols)
