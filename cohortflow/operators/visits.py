"""Visit-level views of the tall measurement table: wide visits, code roll-ups, balanced samples, filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.functions.scalar import any_code_pattern, rule_text
from cohortflow.sources.fixtures import CODE_COLS, PATIENT_KEYS


def _ordered_distinct_join(item_struct_col: str, text_field: str) -> F.Column:
    arr = F.array_sort(F.collect_list(item_struct_col))
    return F.when(F.size(arr) > 0, F.array_join(F.transform(arr, lambda x: x[text_field]), ", "))


def visit_wide(
    tall: DataFrame,
    panels: Sequence[str],
    keys: Sequence[str] = PATIENT_KEYS,
    ts_col: str = "performed_at",
    panel_col: str = "panel",
    value_col: str = "value",
    row_id_col: str = "row_id",
    code_cols: Sequence[str] = CODE_COLS,
    visit_col: str = "visit_date",
) -> DataFrame:
    """AGG-6: one row per (entity, visit day); per panel the first non-null value by row id; codes per visit
    as distinct non-empty trimmed strings in first-seen order.  Code rows are pre-reduced to one row per
    (visit, code) before the final aggregation (bounded lists)."""
    keys = list(keys)
    t = tall.withColumn(visit_col, F.to_date(ts_col))
    vkey = [*keys, visit_col]
    code_rows = (
        t.select(
            *vkey,
            F.col(row_id_col).alias("_rid"),
            F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.trim(F.col(c)).alias("code")) for c in code_cols])).alias("_kc"),
        )
        .filter(F.col("_kc.code").isNotNull() & (F.length("_kc.code") > 0))
        .groupBy(*vkey, F.col("_kc.kind").alias("_kind"), F.col("_kc.code").alias("_code"))
        .agg(F.min("_rid").alias("_first"))
    )
    meas = t.select(*vkey, F.col(panel_col).alias("_panel"), F.col(value_col).alias("_value"), F.col(row_id_col).alias("_rid"))
    both = meas.unionByName(code_rows, allowMissingColumns=True)
    aggs = []
    for p in panels:
        v = F.when(F.col("_panel") == F.lit(p), F.col("_value"))
        aggs.append(F.min_by(v, F.when(v.isNotNull(), F.col("_rid"))).alias(p))
    for c in code_cols:
        item = F.when(F.col("_kind") == F.lit(c), F.struct(F.col("_first").alias("f"), F.col("_code").alias("c")))
        aggs.append(_ordered_distinct_join(item, "c").alias(c))
    return both.groupBy(*vkey).agg(*aggs)


def patient_codes_over_visits(
    visits: DataFrame,
    patient_key: Sequence[str] = ("patient_name", "admission_no"),
    order_cols: Sequence[str] = ("birth_year", "sex", "visit_date"),
    code_cols: Sequence[str] = CODE_COLS,
    label_codes: Sequence[str] = ("I21", "I22", "I64", "I50"),
) -> DataFrame:
    """AGG-7 + JN-1 + SCL-3: roll the per-visit code strings up per patient (distinct strings, first-seen in
    visit order), join back to every visit with null-safe keys, and label each visit row."""
    pk = list(patient_key)
    order = F.struct(*[F.col(c) for c in order_cols])
    stacked = visits.select(
        *pk,
        order.alias("_o"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("s")) for c in code_cols])).alias("_kc"),
    ).filter(F.col("_kc.s").isNotNull())
    firsts = stacked.groupBy(*pk, F.col("_kc.kind").alias("_kind"), F.col("_kc.s").alias("_s")).agg(F.min("_o").alias("_first"))
    aggs = []
    for c in code_cols:
        item = F.when(F.col("_kind") == F.lit(c), F.struct(F.col("_first").alias("f"), F.col("_s").alias("s")))
        aggs.append(_ordered_distinct_join(item, "s").alias(f"_p_{c}"))
    per_patient = firsts.groupBy(*pk).agg(*aggs)
    v = visits.drop(*code_cols).alias("v")
    p = per_patient.alias("p")
    cond = None
    for k in pk:
        e = F.col(f"v.{k}").eqNullSafe(F.col(f"p.{k}"))
        cond = e if cond is None else cond & e
    joined = v.join(p, cond, "left").select(
        "v.*", *[F.col(f"p._p_{c}").alias(c) for c in code_cols]
    )
    return joined.withColumn(
        "target", rule_text(code_cols[0], code_cols[1], "None").rlike(any_code_pattern(label_codes)).cast("int")
    )


def balanced_sample(
    tall: DataFrame,
    n_per_group: int,
    group_col: str = "panel",
    entity_col: str = "patient_name",
    code_cols: Sequence[str] = CODE_COLS,
    label_codes: Sequence[str] = ("I21", "I22", "I64", "I50"),
) -> DataFrame:
    """WIN-2 + AGG-8 + JN-2: per group take the first n/2 positive entities by name, fill the rest with
    negatives, and top up with further positives if negatives run short; keep those entities' rows.

    The per-class ranking is a top-n per (group, class): Spark applies the row-number limit before the
    shuffle (window group limit), so a hot group is cut map-side; the selected key set is at most
    n_per_group per group and is broadcast to the semi-join."""
    text = rule_text(code_cols[0], code_cols[1], "None")
    named = tall.filter(F.col(entity_col).isNotNull())  # rows without an entity take no place in the sample
    ent = named.select(group_col, entity_col, text.rlike(any_code_pattern(label_codes)).cast("int").alias("_t")).groupBy(
        group_col, entity_col
    ).agg(F.max("_t").alias("tgt"))
    sizes = ent.groupBy(group_col).agg(
        F.count_if(F.col("tgt") == 1).alias("n_pos"), F.count_if(F.col("tgt") == 0).alias("n_neg")
    )
    half = n_per_group // 2
    a = F.least(F.col("n_pos"), F.lit(half))
    b = F.least(F.col("n_neg"), F.lit(n_per_group) - a)
    a2 = F.when(a + b < F.lit(n_per_group), F.least(F.col("n_pos"), F.lit(n_per_group) - b)).otherwise(a)
    takes = sizes.select(group_col, a2.alias("take_pos"), b.alias("take_neg"))
    w = Window.partitionBy(group_col, "tgt").orderBy(F.col(entity_col).asc_nulls_last())
    ranked = ent.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= F.lit(n_per_group))
    chosen = ranked.join(F.broadcast(takes), group_col).filter(
        F.col("_rn") <= F.when(F.col("tgt") == 1, F.col("take_pos")).otherwise(F.col("take_neg"))
    ).select(group_col, entity_col, "tgt")
    return tall.join(F.broadcast(chosen), [group_col, entity_col], "inner")


def present_filter(df: DataFrame, columns: Sequence[str], min_present: int) -> DataFrame:
    """FLT-5 keeps rows with at least ``min_present`` of ``columns`` non-null; FLT-6 flag: all present."""
    kept = df.dropna(thresh=min_present, subset=list(columns))
    all_present = None
    for c in columns:
        e = F.col(c).isNotNull()
        all_present = e if all_present is None else all_present & e
    return kept.withColumn("all_present", all_present.cast("int"))
