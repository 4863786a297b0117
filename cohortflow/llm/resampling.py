"""Target-distribution importance resampling over hashed word n-grams, by batch concatenation.

The texts of a batch are joined with a sentinel that no word can hold, and one regular expression pass finds all words
and sentinels.  The sentinels' places are the document offsets: `searchsorted` gives each word its document, and
n-grams whose ends lie in different documents are masked before anything is counted.  Features are hashed into a fixed
number of buckets.  A bucket's gain compares its smoothed shares in the target and in the corpus; a document's weight is
the floored mean gain of its features; a Gumbel value from a hash of its id turns the top scores into a weighted draw
without replacement.

Each text is read once: the scan leaves the bucket numbers of each document (two bytes a feature), and both the counts
and the weights are array sums over those.  What the driver holds are the gains, one a bucket.

Edge cases: null and empty texts have no features and weight 0; a null id hashes as the text `null` and comes last among
ties; repeated rows are documents of their own; ties of score and id go by the number of features, then by weight (rows
equal in these are interchangeable); an empty corpus gives an empty result, an empty target smoothed shares alone; extra
columns are ignored; texts are read whole.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.llm.common import stored, text_slices

SENTINEL = b"\x00"
#: Only A-Z are lowered; a NUL in a text separates words like other control characters, so it may become a space.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\x00", b"abcdefghijklmnopqrstuvwxyz\x20")
#: Words are runs of digits, letters and anything beyond ASCII; the sentinel is found along with them.
FIND = re.compile(rb"[0-9a-z\x80-\xff]+|\x00")


def features(texts: list[bytes], max_n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each text, words of each text, bucket of each feature in the order of the texts)."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = FIND.findall(SENTINEL.join([t.translate(LOWER) for t in texts]))
    offsets, at = [], -1
    for _ in range(len(texts) - 1):
        at = found.index(SENTINEL, at + 1)
        offsets.append(at)
    starts = np.array(offsets, np.int64)
    doc = np.searchsorted(starts, np.arange(len(found)), side="right")
    is_word = np.ones(len(found), bool)
    is_word[starts] = False
    run = list(map(crc32, found))
    docs, hashes = [doc[is_word]], [np.array(run, np.int64)[is_word]]
    for n in range(2, max_n + 1):
        if len(found) < n:
            break
        run = [crc32(w, crc32(b" ", c)) for c, w in zip(run, found[n - 1 :])]
        whole = is_word[: len(run)] & (doc[: len(run)] == doc[n - 1 :])
        docs.append(doc[: len(run)][whole])
        hashes.append(np.array(run, np.int64)[whole])
    n_words = np.bincount(docs[0], minlength=len(texts))
    doc, bucket = np.concatenate(docs), np.concatenate(hashes) % buckets
    if len(docs) > 1:
        order = np.argsort(doc, kind="stable")
        doc, bucket = doc[order], bucket[order]
    return np.bincount(doc, minlength=len(texts)), n_words, bucket


def hashed(docs: DataFrame, max_n: int, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_features, n_words, buckets): the bucket numbers of a document as packed unsigned integers."""
    kind = _packed(buckets)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            for i, j in text_slices([len(t) for t in texts]):
                n, words, bucket = features(texts[i:j], max_n, buckets)
                ends = np.concatenate([[0], np.cumsum(n)]) * kind.itemsize
                packed = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(bucket.astype(kind))])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(words, pa.int64()), packed.cast(pa.binary())],
                                                 ["doc_id", "n_features", "n_words", "buckets"])

    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, n_features long, n_words long, buckets binary")


def _packed(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def _numbers(column, kind: np.dtype) -> np.ndarray:
    """All packed numbers of a binary column, in order."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def bucket_counts(made: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): how many features fall into each bucket.  A task sends at most one row a bucket."""
    kind = _packed(buckets)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(_numbers(b.column(0), kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    return made.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain): floor(1000 ln of the smoothed share in the target over that in the corpus), in doubles."""
    spark = corpus.sparkSession
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")) \
        .unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))) \
        .unionByName(spark.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")))
    per = both.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    whole = Window.partitionBy(F.lit(1))  # one row a bucket
    per = per.withColumn("all_s", F.sum("s").over(whole)).withColumn("all_t", F.sum("t").over(whole))
    m, one = F.lit(float(buckets)), F.lit(1.0)
    ratio = (F.col("t") + one) * (F.col("all_s") + m) / ((F.col("s") + one) * (F.col("all_t") + m))
    return per.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def weighed(made: DataFrame, gains: list[int]) -> DataFrame:
    """(doc_id, n_features, n_words, weight): the floored mean gain of a document's features."""
    kind, gain = _packed(len(gains)), np.array(gains, np.int64)

    def run(batches):
        for b in batches:
            n = b.column(1).to_numpy()
            upto = np.concatenate([[0], np.cumsum(gain[_numbers(b.column(3), kind)])])
            ends = np.cumsum(n)
            weight = (upto[ends] - upto[ends - n]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(weight, pa.int64())], ["doc_id", "n_features", "n_words", "weight"])

    return made.mapInArrow(run, f"doc_id {dict(made.dtypes)['doc_id']}, n_features long, n_words long, weight long")


def gumbel(ident: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 8 hex digits of sha256("seed:id")."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("null")))
    u = (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def ranked(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """Add `rank`: 1, 2, 3 ... of the best `percent` of the eligible rows by score, then id; null elsewhere.

    Scores are integers of a bounded range, so one count a score tells where each score's ranks start; only rows that
    reach the lowest drawn score are shuffled, by score."""
    counts = scored.filter(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy(F.col("score").desc())  # over one row a score
    starts = counts.select("score", (F.sum("n").over(upto) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("all"))
    starts = stored(starts.select("score", "before", F.floor(F.col("all") * percent / 100).cast("long").alias("drawn")).filter("before < drawn"), "resample-starts")
    least = starts.agg(F.min("score")).first()[0]
    top = eligible & (F.col("score") >= F.lit(least)) if least is not None else F.lit(False)
    inside = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight"))
    best = scored.filter(top).withColumn("at", inside).join(starts, "score")
    rank = F.col("before") + F.col("at")
    best = best.select(*scored.columns, F.when(rank <= F.col("drawn"), rank).cast("long").alias("rank"))
    return scored.filter(~F.coalesce(top, F.lit(False))).withColumn("rank", F.lit(None).cast("long")).unionByName(best)


def resample(docs: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20,
             id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_features, weight, score and rank (null where it is not drawn)."""
    made = stored(hashed(docs, max_n, buckets, id_col, text_col), "resample-features")
    aim = hashed(target.withColumn("_none", F.lit(None).cast("long")), max_n, buckets, "_none", target_text_col)
    gains = bucket_gains(bucket_counts(made, buckets), bucket_counts(aim, buckets), buckets).orderBy("bucket").collect()  # one row a bucket
    scored = weighed(made, [r["gain"] for r in gains]).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    drawn = ranked(stored(scored, "resample-scores"), F.col("n_words") >= least_words, percent)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
