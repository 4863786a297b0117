"""Derived inputs over the synthetic testdata tables (FIXTURES.md section 2).

Each builder reads whole tables through the parquet reader (so filters and projections reach the scan)
and returns a lazy DataFrame.  The ``*_SQL`` strings are the same derivations as DuckDB CTE bodies used by
the oracle queries in `cohortflow.plans.oracle`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.functions.scalar import rdp
from cohortflow.session import read_table

# ---------------------------------------------------------------------------------------------
# Fixture A: longitudinal panels from `events`
# ---------------------------------------------------------------------------------------------
PANELS = ["view", "click", "purchase", "signup", "error"]
CODE_COLS = ["icd_inpatient", "icd_outpatient"]
PATIENT_KEYS = ["patient_name", "admission_no", "birth_year", "sex"]


@dataclass(frozen=True)
class CohortRules:
    """Inclusion rules and code patterns (fixture values; the reference's are year 2026, age 18, 365 days)."""

    reference_year: int = 2026
    min_age: int = 18
    min_followup_days: int = 28
    start: str = "2023-01-01 00:00:00"
    end: str = "2026-02-28 00:00:00"
    include: str = "I1[0-5]"
    exclude: str = "C[0-9]{2}"
    label_codes: tuple[str, ...] = ("I21", "I22", "I64", "I50")
    flags: dict[str, str] = field(
        default_factory=lambda: {
            "diabetes": "E1[0-4]",
            "dyslipidemia": "E78",
            "ckd": "N18",
            "hypertension": "I1[0-5]",
        }
    )


FIXTURE_RULES = CohortRules()


def _code_expr(panel: F.Column, k: F.Column) -> F.Column:
    kk = F.lpad(k.cast("string"), 2, "0")
    return (
        F.when(panel == "signup", F.concat(F.lit("I"), kk))
        .when(panel == "purchase", F.concat(F.lit("E"), kk))
        .when(panel == "view", F.concat(F.lit("N"), kk))
        .when(panel == "click", F.concat(F.lit("J"), kk))
        .when((panel == "error") & (k < 2), F.concat(F.lit("C"), kk))
    )


def lab_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw tall measurement rows: text result, raw birth year text, codes on alternate rows."""
    return lab_rows_from_events(read_table(spark, sf_dir, "events"))


def lab_rows_from_events(ev: DataFrame) -> DataFrame:
    """The fixture-A derivation on any events frame (batch or stream)."""
    k = F.regexp_extract("props", "[0-9]+", 0).try_cast("int")
    code = _code_expr(F.col("event_type"), k)
    even = (F.col("event_id") % 2) == 0
    return ev.select(
        F.col("event_id").alias("row_id"),
        F.concat(F.lit("P"), F.lpad(F.col("user_id").cast("string"), 5, "0")).alias("patient_name"),
        F.col("user_id").cast("string").alias("admission_no"),
        (F.lit(1920) + (F.col("user_id") * 7) % 95).cast("string").alias("birth_year"),
        F.when(F.col("user_id") % 2 == 0, F.lit("Nam")).otherwise(F.lit("Nu")).alias("sex"),
        F.col("ts").alias("performed_at"),
        F.col("event_type").alias("panel"),
        F.when(F.col("event_id") % 97 == 0, F.lit("<0.3")).otherwise(F.col("value").cast("string")).alias("result"),
        F.when(even, code).alias("icd_inpatient"),
        F.when(~even, code).alias("icd_outpatient"),
    )


# Header spellings used by the per-panel copies (exercises the harmoniser).
PANEL_HEADER_VARIANTS = {
    "view": {},
    "click": {"icd_inpatient": "Inpatient ICD", "icd_outpatient": "Outpatient ICD"},
    "purchase": {"icd_inpatient": "inpatient_code", "icd_outpatient": "outpatient_code"},
    "signup": {"performed_at": "performed_on"},
    "error": {"icd_outpatient": "Outpatient ICD"},
}
HEADER_SYNONYMS = {
    "Inpatient ICD": "icd_inpatient",
    "inpatient_code": "icd_inpatient",
    "Outpatient ICD": "icd_outpatient",
    "outpatient_code": "icd_outpatient",
    "performed_on": "performed_at",
}


_CODE_SQL = (
    "CASE WHEN event_type = 'signup' THEN 'I' || lpad(CAST(k AS VARCHAR), 2, '0') "
    "WHEN event_type = 'purchase' THEN 'E' || lpad(CAST(k AS VARCHAR), 2, '0') "
    "WHEN event_type = 'view' THEN 'N' || lpad(CAST(k AS VARCHAR), 2, '0') "
    "WHEN event_type = 'click' THEN 'J' || lpad(CAST(k AS VARCHAR), 2, '0') "
    "WHEN event_type = 'error' AND k < 2 THEN 'C' || lpad(CAST(k AS VARCHAR), 2, '0') END"
)

LAB_RAW_SQL = f"""
SELECT event_id AS row_id,
       'P' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS patient_name,
       CAST(user_id AS VARCHAR) AS admission_no,
       CAST(1920 + (user_id * 7) % 95 AS VARCHAR) AS birth_year,
       CASE WHEN user_id % 2 = 0 THEN 'Nam' ELSE 'Nu' END AS sex,
       ts AS performed_at,
       event_type AS panel,
       CASE WHEN event_id % 97 = 0 THEN '<0.3' ELSE CAST(value AS VARCHAR) END AS result,
       CASE WHEN event_id % 2 = 0 THEN code END AS icd_inpatient,
       CASE WHEN event_id % 2 <> 0 THEN code END AS icd_outpatient
FROM (SELECT *, {_CODE_SQL} AS code
      FROM (SELECT *, TRY_CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS k FROM events) e0) e1
"""

# ---------------------------------------------------------------------------------------------
# Fixture B: labelled feature table from customer / orders / lineitem
# ---------------------------------------------------------------------------------------------
B_MEASURES = {"qty": "l_quantity", "price": "l_extendedprice", "disc": "l_discount"}
B_STATS = ["mean", "max", "min", "std", "last"]
LABEL_PRICE = 490000.0
LATE_FROM = "2001-08-01 00:00:00"
SPARSE_FROM = "2001-10-15 00:00:00"
B_CONTINUOUS = [f"{m}_{s}" for m in B_MEASURES for s in B_STATS] + ["late_price_mean", "sparse_price_mean", "balance"]
B_FLAGS = ["flag_urgent"]


def customer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"
    )
    od = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"
    )
    cu = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")

    # per-customer order facts (orders grain, one shuffle on custkey)
    per_order = od.groupBy("o_custkey").agg(
        F.max("o_totalprice").alias("max_price"),
        F.max(((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")).cast("int")).alias(
            "urgent"
        ),
    )
    lines = li.join(od.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    aggs = []
    for short, c in B_MEASURES.items():
        v = F.col(c)
        order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", c)
        aggs += [
            rdp(F.avg(v), 9).alias(f"{short}_mean"),
            F.max(v).alias(f"{short}_max"),
            F.min(v).alias(f"{short}_min"),
            rdp(F.stddev_samp(v), 9).alias(f"{short}_std"),
            F.max_by(v, F.when(v.isNotNull(), order)).alias(f"{short}_last"),
        ]
    aggs += [
        rdp(F.avg(F.when(F.col("l_shipdate") >= F.lit(LATE_FROM).cast("timestamp_ntz"), F.col("l_extendedprice"))), 9).alias(
            "late_price_mean"
        ),
        rdp(F.avg(
            F.when(F.col("l_shipdate") >= F.lit(SPARSE_FROM).cast("timestamp_ntz"), F.col("l_extendedprice"))
        ), 9).alias("sparse_price_mean"),
    ]
    per_line = lines.groupBy("o_custkey").agg(*aggs)
    out = (
        cu.join(per_order, cu.c_custkey == per_order.o_custkey, "left")
        .drop("o_custkey")
        .join(per_line, cu.c_custkey == per_line.o_custkey, "left")
        .select(
            F.col("c_custkey").alias("row_id"),
            F.coalesce((F.col("max_price") > F.lit(LABEL_PRICE)).cast("int"), F.lit(0)).alias("label"),
            *[F.col(f"{m}_{s}") for m in B_MEASURES for s in B_STATS],
            "late_price_mean",
            "sparse_price_mean",
            F.coalesce(F.col("urgent"), F.lit(0)).alias("flag_urgent"),
            F.col("c_mktsegment").alias("segment"),
            F.col("c_acctbal").alias("balance"),
            F.lit(1).alias("zero_var"),
        )
    )
    return out


def _r9(x: str) -> str:
    # computed aggregates are rounded to 9 places in both engines so ties do not depend on summation order
    return f"(floor(({x}) * 1e9 + 0.5) / 1e9)"


def _b_stats_sql() -> str:
    parts = []
    for short, c in B_MEASURES.items():
        parts += [
            f"{_r9(f'avg({c})')} AS {short}_mean",
            f"max({c}) AS {short}_max",
            f"min({c}) AS {short}_min",
            f"{_r9(f'stddev_samp({c})')} AS {short}_std",
            f"arg_max({c}, (l_shipdate, l_orderkey, l_linenumber, {c})) FILTER (WHERE {c} IS NOT NULL) AS {short}_last",
        ]
    parts += [
        f"{_r9(f"avg(CASE WHEN l_shipdate >= TIMESTAMP '{LATE_FROM}' THEN l_extendedprice END)")} AS late_price_mean",
        f"{_r9(f"avg(CASE WHEN l_shipdate >= TIMESTAMP '{SPARSE_FROM}' THEN l_extendedprice END)")} AS sparse_price_mean",
    ]
    return ",\n       ".join(parts)


CUSTOMER_FEATURES_SQL = f"""
SELECT c.c_custkey AS row_id,
       COALESCE(CAST(po.max_price > {LABEL_PRICE!r}::double AS INTEGER), 0) AS label,
       {", ".join(f"pl.{m}_{s}" for m in B_MEASURES for s in B_STATS)},
       pl.late_price_mean, pl.sparse_price_mean,
       COALESCE(po.urgent, 0) AS flag_urgent,
       c.c_mktsegment AS segment,
       c.c_acctbal AS balance,
       1 AS zero_var
FROM customer c
LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS max_price,
                  max(CAST(o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AS INTEGER)) AS urgent
           FROM orders GROUP BY o_custkey) po ON c.c_custkey = po.o_custkey
LEFT JOIN (SELECT o_custkey,
       {_b_stats_sql()}
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey
           GROUP BY o_custkey) pl ON c.c_custkey = pl.o_custkey
"""

# ---------------------------------------------------------------------------------------------
# Fixture C: scored table (model, row_id, prob, actual) -- several deterministic scores
# ---------------------------------------------------------------------------------------------
SCORE_MODELS = ["balance", "balance_tied", "quantity", "price"]


def scored(spark: SparkSession, sf_dir: str, b: DataFrame | None = None) -> DataFrame:
    b = b if b is not None else customer_features(spark, sf_dir)
    p_bal = F.least(F.greatest((F.col("balance") + F.lit(1000.0)) / F.lit(11000.0), F.lit(0.0)), F.lit(1.0))
    p_qty = F.least(F.greatest((F.col("qty_mean") - F.lit(1.0)) / F.lit(49.0), F.lit(0.0)), F.lit(1.0))
    p_price = F.least(F.col("price_max") / F.lit(110000.0), F.lit(1.0))
    scores = F.array(
        F.struct(F.lit("balance").alias("model"), p_bal.alias("prob")),
        F.struct(F.lit("balance_tied").alias("model"), rdp(p_bal, 2).alias("prob")),
        F.struct(F.lit("quantity").alias("model"), p_qty.alias("prob")),
        F.struct(F.lit("price").alias("model"), p_price.alias("prob")),
    )
    return (
        b.select("row_id", F.col("label").alias("actual"), F.inline(scores))
        .filter(F.col("prob").isNotNull())
        .select("model", "row_id", "prob", "actual")
    )


SCORED_SQL = f"""
SELECT model, row_id, prob, actual FROM (
  SELECT 'balance' AS model, row_id, least(greatest((balance + 1000.0::double) / 11000.0::double, 0.0::double), 1.0::double) AS prob, label AS actual FROM fx_b
  UNION ALL
  SELECT 'balance_tied', row_id, floor(least(greatest((balance + 1000.0::double) / 11000.0::double, 0.0::double), 1.0::double) * 100.0 + 0.5) / 100.0, label FROM fx_b
  UNION ALL
  SELECT 'quantity', row_id, least(greatest((qty_mean - 1.0::double) / 49.0::double, 0.0::double), 1.0::double), label FROM fx_b
  UNION ALL
  SELECT 'price', row_id, least(price_max / 110000.0::double, 1.0::double), label FROM fx_b
) s WHERE prob IS NOT NULL
"""

# ---------------------------------------------------------------------------------------------
# Fixture D: linear attributions (weights are fixture constants)
# ---------------------------------------------------------------------------------------------
ATTR_WEIGHTS = {
    "qty_mean": 0.8,
    "price_mean": -0.5,
    "disc_mean": 0.3,
    "balance": 1.2,
    "price_max": 0.04,
    "flag_urgent": -0.02,
}

# ---------------------------------------------------------------------------------------------
# Fixture E / F helpers (store and stream) live in cohortflow.operators.store and cohortflow.streaming.
# ---------------------------------------------------------------------------------------------


def cte(**parts: str) -> str:
    """Join named CTE bodies into a WITH clause."""
    return "WITH " + ",\n".join(f"{name} AS MATERIALIZED ({body})" for name, body in parts.items()) + "\n"
