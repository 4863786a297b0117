"""Mixing sources to target weights by entropy balancing.

Every document d of source s gets a rate r_d = min(cap, exp(lambda_s * x_d)), x_d its size over the source's mean size:
the rates nearest to 1 in relative entropy whose expected words meet the source's target.  The convex dual has one
variable a source; safeguarded Newton steps solve all of them together, each step one aggregate over the distinct
(source, size) pairs joined with the small table of multipliers.  The rates are then rounded into whole copies: along
each source's documents, ordered by size, copies are the integer steps of the running sum of rates.  So a document has
floor(r) or ceil(r) copies, and a source misses its target by at most about its largest document; of 32 starts of the
running sum each source takes the one that meets its target best.

Sums are taken over integers (rates in units of 2^-30), so results do not depend on the order of addition and reruns
agree.  Everything is a built-in expression; the driver sees one error figure a step.

Targets: shares by weight of `share` times all words; a target above cap times its source's words stops there, and
the excess goes to the others by weight until none is above (found at once by sorting the sources by cap over weight).

Edge cases: a null text has no words; documents without words get one copy and take nothing; a null source is a source
of its own, last; with no words at all every target is 0; repeated rows count each; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.llm.common import WORD, keyed, stored

UNIT_BITS = 30
UNIT = 1 << UNIT_BITS
_STARTS = 32  # starts of the running sum that are tried
_GROUP_ROWS = 200_000  # documents of one (source, size) that are numbered in one task; larger groups are salted


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size) -> adds idx (0.. by code point, null last), weight and target.

    Runs over the table of sources only, one row each."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    idx = F.row_number().over(by_name) - 1
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    s = sizes.withColumn("idx", idx).withColumn("weight", cycle).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    s = s.withColumn("ratio", F.col("most") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "idx")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    all_ = Window.partitionBy(F.lit(1))
    s = s.withColumn("rest", F.sum("source_size").over(all_) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("rest") / F.sum("weight").over(after))
    # the first source in this order whose cap is not reached fixes the common level
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "idx", "level"))).over(all_)["level"]
    return s.withColumn("target", F.when(level.isNull(), F.col("most")).otherwise(F.least("most", F.col("weight") * level))) \
        .select("source", "source_size", "idx", "weight", "target")


def _rate(cap: float) -> Column:
    """The rate in units of 2^-30 of a (source, size) pair under the current multiplier."""
    x = F.col("size") / F.col("mean")
    tilt = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
    capped = F.when(F.col("full"), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), tilt))
    return F.when(F.col("size") == 0, F.lit(UNIT)).otherwise(F.round(capped * F.lit(UNIT))).cast("long")


def balance(hist: DataFrame, sources: DataFrame, cap: float, steps: int = 60, tol: float = 1e-7, most_err: float = 1e-3) -> DataFrame:
    """Newton steps on the dual: (idx, lam, full, mean, ...) per source.  hist: (idx, size, n), one row a pair."""
    s = sources.withColumn("mean", F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1e-9)))
    s = s.withColumn("full", F.col("target") >= F.col("source_size") * F.lit(cap * (1 - 1e-12)))
    s = s.withColumn("lam", F.lit(0.0)).withColumn("lo", F.lit(-1e4)).withColumn("hi", F.lit(1e4)).withColumn("err", F.lit(1.0))
    state = stored(s.drop("source"), "mix-state")
    big = lambda c: c.cast("decimal(19,0)")
    for _ in range(steps):
        at = hist.join(state, "idx").withColumn("rate", _rate(cap))
        words = big(F.col("n") * F.col("size")) * big(F.col("rate"))
        slope = F.when(F.col("rate") < F.lit(int(cap * UNIT)), words * big(F.col("size"))).otherwise(F.lit(0).cast("decimal(38,0)"))
        sums = at.groupBy("idx").agg(F.sum(words).cast("double").alias("f"), F.sum(slope).cast("double").alias("df"))
        nxt = state.join(sums, "idx")
        gap = F.col("f") / F.lit(float(UNIT)) - F.col("target")
        nxt = nxt.withColumn("gap", gap).withColumn("lo", F.when(F.col("gap") < 0, F.col("lam")).otherwise(F.col("lo")))
        nxt = nxt.withColumn("hi", F.when(F.col("gap") > 0, F.col("lam")).otherwise(F.col("hi")))
        newton = F.col("lam") - F.col("gap") / (F.col("df") / F.lit(float(UNIT)) / F.col("mean"))
        safe = F.when((F.col("df") > 0) & (newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        done = F.col("full") | (F.col("source_size") == 0)
        err = F.when(done, F.lit(0.0)).otherwise(F.abs(F.col("gap")) / F.greatest(F.col("target"), F.lit(1.0)))
        nxt = nxt.withColumn("err", err).withColumn("lam", F.when(F.col("err") <= tol, F.col("lam")).otherwise(safe))
        state = stored(nxt.select(*state.columns), "mix-state")
        far = state.agg(F.max("err")).first()[0] or 0.0
        if far <= tol:
            return state
    if far > most_err:  # within it, the remainder is what rates in whole units leave
        raise RuntimeError(f"mixing: a target is missed by {far:.2g} after {steps} Newton steps")
    return state


def mix(docs: DataFrame, weights: tuple[float, ...], share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", steps: int = 60) -> DataFrame:
    """Per document: doc_id, k_hash, source, size, source_size, target, rate, copies, taken."""
    n_words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    slim = stored(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("k_hash"), F.col(source_col).alias("source"), n_words.alias("size")), "mix-docs")
    pairs = slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    sizes = pairs.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs"))
    sources = stored(_with_docs(sizes, weights, share, cap), "mix-sources")
    hist = stored(pairs.join(sources.select(F.col("source").alias("_s"), "idx"), F.col("source").eqNullSafe(F.col("_s"))).select("idx", "size", "n"), "mix-pairs")
    state = balance(hist, sources, cap, steps)
    rated = hist.join(state.select("idx", "lam", "full", "mean"), "idx").withColumn("rate", _rate(cap)).select("idx", "size", "n", "rate")
    rated = rated.withColumn("salts", (F.floor(F.col("n") / F.lit(_GROUP_ROWS)) + 1).cast("int"))
    named = rated.join(sources.select("idx", "source", "source_size", "target"), "idx")
    d = slim.withColumnRenamed("source", "_src").join(named, (F.col("_src").eqNullSafe(F.col("source"))) & (slim["size"] == named["size"])) \
        .select("doc_id", "k_hash", "source", slim["size"].alias("size"), "source_size", "target", "idx", "rate",
                F.pmod(F.xxhash64("doc_id", "k_hash"), F.col("salts")).cast("int").alias("salt"))
    group = ["idx", "size", "salt"]
    counts = d.groupBy(*group, "rate").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy("idx").orderBy("size", "salt").rowsBetween(Window.unboundedPreceding, -1)
    run = F.coalesce(F.sum(F.col("m") * F.col("rate")).over(before), F.lit(0))
    offsets = counts.select(*group, run.alias("run"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy("doc_id", "k_hash"))
    d = d.withColumn("place", place).join(offsets, group)
    d = stored(d.withColumn("upto", F.col("run") + F.col("place") * F.col("rate")), "mix-placed")

    def copies(phase: Column) -> Column:
        at = F.col("upto") + phase
        return F.when(F.col("size") == 0, F.lit(1)).otherwise(F.shiftright(at, UNIT_BITS) - F.shiftright(at - F.col("rate"), UNIT_BITS)).cast("long")

    # where the running sum starts is free: each source takes the start that meets its target best
    starts = [F.lit(k * (UNIT // _STARTS)).cast("long") for k in range(_STARTS)]
    errors = d.groupBy("idx", "target").agg(*[F.sum(copies(s) * F.col("size")).alias(f"s{k}") for k, s in enumerate(starts)])
    least = F.least(*[F.struct(F.abs(F.col(f"s{k}") - F.col("target")).alias("e"), s.alias("phase")) for k, s in enumerate(starts)])
    d = d.join(errors.select("idx", least["phase"].alias("phase")), "idx").withColumn("copies", copies(F.col("phase")))
    return d.select("doc_id", "k_hash", "source", "size", "source_size", "target", (F.col("rate") / F.lit(float(UNIT))).alias("rate"),
                    "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _with_docs(sizes: DataFrame, weights, share: float, cap: float) -> DataFrame:
    t = source_targets(sizes.select("source", "source_size"), weights, share, cap)
    n = sizes.select(F.col("source").alias("_s"), "n_docs")
    return t.join(n, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def repeat_documents(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of `docs` as often as `mixed` says; repeated rows each take a decision of their own."""
    per = mixed.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null:")).alias("k_id"), "k_hash", "copies")
    per = per.groupBy("k_id", "k_hash").agg(F.sort_array(F.collect_list("copies"), asc=False).alias("each"))
    rows = keyed(docs, id_col, text_col).join(per, ["k_id", "k_hash"])
    times = F.explode(F.array_repeat(F.lit(0), F.element_at("each", F.col("k_n")).cast("int")))
    return rows.select("row", times.alias("_time")).select("row.*")
