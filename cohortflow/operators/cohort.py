"""Measurement panels -> harmonised tall table -> one row per entity -> cohort rules.

Operators take column names as parameters; the defaults are the fixture's names.  The tall form
``(keys..., performed_at, panel, value, codes..., row_id)`` is used throughout: every per-panel statistic is
one conditional aggregate in a single ``groupBy`` (partial aggregation map-side, so a hot entity is
pre-reduced before the shuffle).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from cohortflow.functions.scalar import (
    any_code_pattern,
    lenient_double,
    lenient_timestamp,
    nan_to_null,
    rule_text,
    word_flag_pattern,
)
from cohortflow.operators.quantiles import quantiles_wide
from cohortflow.sources.fixtures import CODE_COLS, PATIENT_KEYS, CohortRules

BASE_COLS = PATIENT_KEYS + ["performed_at"] + CODE_COLS


# ---------------------------------------------------------------------------------------------
# SRC-1..3, SET-1: read, harmonise and union panels
# ---------------------------------------------------------------------------------------------
def read_panels(
    spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet", schema=None, **options
) -> dict[str, DataFrame]:
    """Read one source per panel; a panel whose source cannot be read is skipped (reported in the log)."""
    out = {}
    for name, path in paths.items():
        try:
            reader = spark.read.options(**options)
            if schema is not None:
                reader = reader.schema(schema)
            df = reader.format(fmt).load(path)
            df.schema  # noqa: B018 - resolves the relation now so a missing path is caught here
            out[name] = df
        except AnalysisException as exc:  # unreadable / missing panel: continue with the rest
            spark.sparkContext._jvm.System.err.println(f"[cohortflow] skipping panel {name}: {exc}")
    return out


def harmonize(
    df: DataFrame,
    synonyms: Mapping[str, str],
    base_cols: Sequence[str] = BASE_COLS,
    result_col: str = "result",
) -> DataFrame:
    """Rename header synonyms, back-fill absent base columns (and an absent result) with NULL text."""
    present = {k: v for k, v in synonyms.items() if k in df.columns}
    if present:
        df = df.withColumnsRenamed(present)
    missing = {c: F.lit(None).cast("string") for c in [*base_cols, result_col] if c not in df.columns}
    if missing:
        df = df.withColumns(missing)
    return df


def union_panels(
    sheets: Mapping[str, DataFrame],
    synonyms: Mapping[str, str],
    base_cols: Sequence[str] = BASE_COLS,
    result_col: str = "result",
    panel_col: str = "panel",
    extra_cols: Sequence[str] = ("row_id",),
) -> DataFrame:
    """UNION ALL by name of harmonised panels, tagged with the panel name."""
    out = None
    keep = [*base_cols, result_col, *extra_cols]
    for name, df in sheets.items():
        h = harmonize(df, synonyms, base_cols, result_col)
        h = h.select(*[c for c in keep if c in h.columns]).withColumn(panel_col, F.lit(name))
        out = h if out is None else out.unionByName(h, allowMissingColumns=True)
    if out is None:
        raise ValueError("no readable panels")
    return out


def parse_measurements(
    df: DataFrame, result_col: str = "result", ts_col: str = "performed_at", value_col: str = "value"
) -> DataFrame:
    """PRJ-1/2/9: lenient numeric and timestamp casts; NaN becomes NULL.  Columns that already have the
    target type are kept as they are, so later range filters on them still reach the parquet scan."""
    ts_type = df.schema[ts_col].dataType.typeName() if ts_col in df.columns else ""
    ts = F.col(ts_col).cast("timestamp_ntz") if ts_type in ("timestamp_ntz", "timestamp") else lenient_timestamp(ts_col)
    res_type = df.schema[result_col].dataType.typeName() if result_col in df.columns else ""
    val = nan_to_null(F.col(result_col).cast("double")) if res_type in ("double", "float", "integer", "long", "decimal") else lenient_double(result_col)
    return df.withColumns({value_col: val, ts_col: ts})


# ---------------------------------------------------------------------------------------------
# FLT-7 / AGG-18: IQR null-out per panel, bounds from the whole unfiltered panel
# ---------------------------------------------------------------------------------------------
def iqr_bounds(
    df: DataFrame, group_col: str = "panel", value_col: str = "value", k: float = 1.5, method: str = "exact"
) -> DataFrame:
    q = quantiles_wide(df, [group_col], value_col, {"q1": 0.25, "q3": 0.75}, method)
    iqr = F.col("q3") - F.col("q1")
    return q.select(
        group_col, "q1", "q3", (F.col("q1") - F.lit(k) * iqr).alias("lo"), (F.col("q3") + F.lit(k) * iqr).alias("hi")
    )


def iqr_nullout(
    df: DataFrame,
    group_col: str = "panel",
    value_col: str = "value",
    k: float = 1.5,
    method: str = "exact",
    bounds: DataFrame | None = None,
) -> DataFrame:
    """Values strictly outside [q1 - k*iqr, q3 + k*iqr] of their panel become NULL; adds ``is_outlier``.

    The bounds table has one row per panel (a schema-level key), so it is broadcast.
    """
    b = bounds if bounds is not None else iqr_bounds(df, group_col, value_col, k, method)
    v = F.col(value_col)
    out_cond = (v < F.col("lo")) | (v > F.col("hi"))
    joined = df.join(F.broadcast(b.select(group_col, "lo", "hi")), [group_col], "left")
    return joined.withColumns(
        {
            "is_outlier": F.coalesce(out_cond, F.lit(False)),
            value_col: F.when(out_cond, F.lit(None).cast("double")).otherwise(v),
        }
    ).drop("lo", "hi")


def outlier_counts(flagged: DataFrame, group_col: str = "panel") -> DataFrame:
    return flagged.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("is_outlier")).cast("bigint").alias("n_outliers")
    )


# ---------------------------------------------------------------------------------------------
# FLT-1: time window
# ---------------------------------------------------------------------------------------------
def time_window(df: DataFrame, ts_col: str, start: str, end: str) -> DataFrame:
    ts = F.col(ts_col)
    return df.filter(
        ts.isNotNull()
        & (ts >= F.lit(start).cast("timestamp_ntz"))
        & (ts <= F.lit(end).cast("timestamp_ntz"))
    )


# ---------------------------------------------------------------------------------------------
# AGG-1..5, PRJ-8: one row per entity
# ---------------------------------------------------------------------------------------------
def order_key(tall: DataFrame, ts_col: str, row_id_col: str) -> Column:
    """(timestamp, row id) as one number of 38 digits in the same order, NULLs first.

    An aggregate over it stays in a hash map, where a struct would sort.  Row ids that are no integers (or timestamps of
    another type) keep the struct."""
    kinds = {c: tall.schema[c].dataType.typeName() for c in (ts_col, row_id_col)}
    if kinds[ts_col] not in ("timestamp", "timestamp_ntz") or kinds[row_id_col] not in ("byte", "short", "integer", "long"):
        return F.struct(F.col(ts_col).alias("ts"), F.col(row_id_col).alias("rid"))
    if kinds[ts_col] == "timestamp":
        micros = F.unix_micros(F.col(ts_col)).cast("decimal(19,0)")
    else:  # by the distance from a fixed day: a session zone with summer time would fold an hour
        since = F.col(ts_col) - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        micros = (since.cast("interval second").cast("decimal(19,6)") * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(19,0)")
    micros = F.coalesce(micros, F.lit("-4000000000000000000").cast("decimal(19,0)"))
    rid = F.coalesce(F.col(row_id_col).cast("decimal(19,0)"), F.lit("-9223372036854775808").cast("decimal(19,0)"))
    return (micros * F.lit("20000000000000000000").cast("decimal(20,0)") + rid).cast("decimal(38,0)")


def _code_first_seen(
    tall: DataFrame, keys: Sequence[str], code_cols: Sequence[str], ts_col: str, row_id_col: str
) -> DataFrame:
    """(keys, kind, code, first) -- one row per distinct trimmed code per entity, with its first sighting."""
    stacked = tall.select(
        *keys,
        order_key(tall, ts_col, row_id_col).alias("_seen"),
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("kind"), F.trim(F.col(c)).alias("code")) for c in code_cols])
        ).alias("_kc"),
    ).filter(F.col("_kc.code").isNotNull())
    return stacked.groupBy(*keys, F.col("_kc.kind").alias("_kind"), F.col("_kc.code").alias("_code")).agg(
        F.min("_seen").alias("_first")
    )


def entity_rollup(
    tall: DataFrame,
    keys: Sequence[str] = PATIENT_KEYS,
    panels: Sequence[str] = (),
    panel_col: str = "panel",
    value_col: str = "value",
    ts_col: str = "performed_at",
    row_id_col: str = "row_id",
    code_cols: Sequence[str] = CODE_COLS,
    single_std_zero: bool = True,
) -> DataFrame:
    """Per entity: ``{panel}_{mean,max,min,std,last}``, first/last timestamp, code lists in first-seen order.

    * ``last`` is the last non-null value by (timestamp, row id);
    * ``std`` is the sample std; a single measurement gets 0 when ``single_std_zero`` (mean non-null);
    * code lists: distinct trimmed codes joined by ', ' in first-seen order, NULL when none.

    NULL keys form their own groups (SQL GROUP BY semantics).  Numeric statistics are one code-generated
    hash aggregate (`order_key` keeps (timestamp, row id) in one number, which a hash buffer can hold); code rows are pre-aggregated to (entity, code) before their per-entity lists are built,
    so a hot entity is reduced map-side in both.
    """
    keys = list(keys)
    meas = tall.select(
        *keys,
        F.col(panel_col).alias("_panel"),
        F.col(value_col).alias("_value"),
        F.col(ts_col).alias("_ts"),
        order_key(tall, ts_col, row_id_col).alias("_order"),
    )
    aggs: list[Column] = []
    order = F.col("_order")
    for p in panels:
        v = F.when(F.col("_panel") == F.lit(p), F.col("_value"))
        aggs += [
            F.avg(v).alias(f"{p}_mean"),
            F.max(v).alias(f"{p}_max"),
            F.min(v).alias(f"{p}_min"),
            F.stddev_samp(v).alias(f"{p}_std"),
            F.max_by(v, F.when(v.isNotNull(), order)).alias(f"{p}_last"),
        ]
    aggs += [F.min("_ts").alias("first_at"), F.max("_ts").alias("last_at")]
    numeric = meas.groupBy(*keys).agg(*aggs)  # declarative aggregates only: code-generated hash aggregation
    if single_std_zero:
        numeric = numeric.withColumns(
            {
                f"{p}_std": F.when(
                    F.col(f"{p}_mean").isNotNull() & F.col(f"{p}_std").isNull(), F.lit(0.0)
                ).otherwise(F.col(f"{p}_std"))
                for p in panels
            }
        )
    # code lists: (entity, code) first sightings, then one bounded list per entity (distinct codes only)
    codes = _code_first_seen(tall, keys, code_cols, ts_col, row_id_col)
    lists = []
    for c in code_cols:
        item = F.when(F.col("_kind") == F.lit(c), F.struct(F.col("_first").alias("f"), F.col("_code").alias("c")))
        arr = F.array_sort(F.collect_list(item))
        lists.append(F.when(F.size(arr) > 0, F.array_join(F.transform(arr, lambda x: x["c"]), ", ")).alias(c))
    code_lists = codes.groupBy(*keys).agg(*lists)
    # entity-grain join (far smaller than the measurement rows); NULL keys match like GROUP BY groups
    n, cl = numeric.alias("n"), code_lists.alias("c")
    cond = None
    for k in keys:
        e = F.col(f"n.{k}").eqNullSafe(F.col(f"c.{k}"))
        cond = e if cond is None else cond & e
    return n.join(cl, cond, "left").select("n.*", *[F.col(f"c.{c}") for c in code_cols])


# ---------------------------------------------------------------------------------------------
# PRJ-3, FLT-2..4, SCL-2..4: cohort rules, label and flags
# ---------------------------------------------------------------------------------------------
def code_flags(df: DataFrame, flags: Mapping[str, str], code_cols: Sequence[str] = CODE_COLS) -> DataFrame:
    """Word-bounded, case-insensitive pattern -> 0/1 column per flag (NULL codes read as empty text)."""
    text = rule_text(code_cols[0], code_cols[1], "")
    return df.withColumns({name: text.rlike(word_flag_pattern(core)).cast("int") for name, core in flags.items()})


def apply_cohort_rules(
    features: DataFrame,
    rules: CohortRules,
    birth_year_col: str = "birth_year",
    first_col: str = "first_at",
    last_col: str = "last_at",
    code_cols: Sequence[str] = CODE_COLS,
    label_col: str = "target",
) -> DataFrame:
    """Age >= min_age, follow-up >= n whole days, include/exclude patterns, label, flags."""
    age = (F.lit(rules.reference_year) - lenient_double(birth_year_col)).cast("int")
    follow = F.timestamp_diff("DAY", F.col(first_col), F.col(last_col))
    text = rule_text(code_cols[0], code_cols[1], "None")
    out = (
        features.withColumn("age", age)
        .filter(F.col("age") >= F.lit(rules.min_age))
        .filter(follow >= F.lit(rules.min_followup_days))
        .filter(text.rlike(rules.include) & ~text.rlike(rules.exclude))
        .withColumn(label_col, text.rlike(any_code_pattern(rules.label_codes)).cast("int"))
    )
    out = code_flags(out, rules.flags, code_cols)
    return out.drop(first_col, last_col)
