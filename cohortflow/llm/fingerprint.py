"""Document fingerprints: a quartile bucket digest.

Every three consecutive bytes of the UTF-8 text are hashed into one of 256 buckets.  The digest holds, per bucket, in
which quartile of the 256 counts its count lies (two bits), before it the length on a logarithmic scale (one byte) and
the two ratios of the quartiles (one byte).  Two digests are compared by a difference score with a fixed bound:
quartile steps over all buckets (a step from lowest to highest counts double), plus the length and ratio steps.
Likeness is 1 - score / bound, so it lies from 0 to 1 and is 1 for equal digests; equal texts have equal digests.

Edge cases: a null text counts as empty; texts under three bytes have no triplets (their digests differ by length
only); texts of any length are digested whole.  Ids are ordered descending with nulls last, rows with equal ids by
their text; repeated rows stay; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.llm.common import shuffle_width

BUCKETS = 256
_LEN_STEPS, _LEN_MOST, _RATIO_MOST = 12.0, 48, 15
BOUND = 6 * BUCKETS + _LEN_MOST + 2 * _RATIO_MOST
_SLICE_BYTES = 4 << 20


def digests(texts: list[bytes]) -> np.ndarray:
    """(n, 2 + BUCKETS) bytes: length step, ratios packed, and the quartile (0 to 3) of every bucket."""
    counts = np.zeros((len(texts), BUCKETS), np.int64)
    for i, t in enumerate(texts):
        if len(t) >= 3:
            b = np.frombuffer(t, np.uint8)
            key = b[:-2].astype(np.uint32)
            key |= b[1:-1].astype(np.uint32) << np.uint32(8)
            key |= b[2:].astype(np.uint32) << np.uint32(16)
            counts[i] = np.bincount((key * np.uint32(0x9E3779B1)) >> np.uint32(24), minlength=BUCKETS)
    out = np.zeros((len(texts), 2 + BUCKETS), np.uint8)
    if not len(texts):
        return out
    rank = np.sort(counts, axis=1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    q1, q2, q3 = rank[:, :1], rank[:, 1:2], rank[:, 2:]
    out[:, 2:] = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    top = np.maximum(q3, 1)
    out[:, 1:2] = (q1 * 15 // top << 4) + q2 * 15 // top
    out[:, 0] = np.minimum(255, np.rint(_LEN_STEPS * np.log1p([len(t) for t in texts])))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of two digest arrays, row by row."""
    a, b = a.astype(np.int16), b.astype(np.int16)
    step = np.abs(a[:, 2:] - b[:, 2:])
    score = step.sum(axis=1) + 3 * (step == 3).sum(axis=1)
    score = score + np.minimum(_LEN_MOST, np.abs(a[:, 0] - b[:, 0]))
    score = score + np.abs((a[:, 1] >> 4) - (b[:, 1] >> 4)) + np.abs((a[:, 1] & 15) - (b[:, 1] & 15))
    return 1.0 - score / BOUND


def encode(d: np.ndarray) -> list[str]:
    """Digests as hex: the length byte, the ratio byte, then four quartiles a byte."""
    q = d[:, 2:].reshape(len(d), -1, 4)
    body = (q[:, :, 0] << 6) | (q[:, :, 1] << 4) | (q[:, :, 2] << 2) | q[:, :, 3]
    return [row.tobytes().hex() for row in np.concatenate([d[:, :2], body.astype(np.uint8)], axis=1)]


def decode(fingerprints: list[str]) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex("".join(fingerprints)), np.uint8).reshape(len(fingerprints), 2 + BUCKETS // 4)
    body = raw[:, 2:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3
    return np.concatenate([raw[:, :2], body.reshape(len(raw), -1)], axis=1)


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > _SLICE_BYTES:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row; no shuffle."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            for i, j in _slices([len(t) for t in texts]):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(encode(digests(texts[i:j])))], ["doc_id", "fingerprint"])

    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, fingerprint string")


def _compare(batches):
    """Rows of one or more buckets, in order: each row is compared with the row after it in its bucket."""
    last = None  # bucket, late, id, text, digest of the row before
    for batch in batches:
        cols = batch.to_pydict()
        all_texts = cols["text"]
        for i, j in _slices([len(t) for t in all_texts]):
            texts = all_texts[i:j]
            own = digests([t.encode() for t in texts])
            rows = list(zip(cols["bucket"][i:j], cols["late"][i:j], cols["doc_id"][i:j], texts, own))
            pairs = [(x, y) for x, y in zip([last, *rows] if last else rows, rows if last else rows[1:]) if x[0] == y[0] and not x[1]]
            last = rows[-1]
            if not pairs:
                continue
            edited = [(x[3][: len(x[3]) - len(x[3]) // 2] + y[3][: len(x[3]) // 2]).encode() for x, y in pairs]
            d, e, n = np.stack([x[4] for x, _ in pairs]), digests(edited), np.stack([y[4] for _, y in pairs])
            yield pa.RecordBatch.from_arrays([
                pa.array([x[2] for x, _ in pairs], batch.schema.field("doc_id").type),
                pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in edited]),
                pa.array(encode(d)), pa.array(encode(e)), pa.array(likeness(d, e)), pa.array(likeness(d, n)),
            ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text, of the text edited with the next document's head, and their likeness.

    The next document is the next lower id, after the lowest the highest.  Ids are cut into `buckets` ranges of about
    equal counts; a range's first row (one a range) is also sent to the range that precedes it in the order, where
    it comes last.  So each text moves once, and a task streams through its ranges with one row of memory."""
    spark = docs.sparkSession
    n = buckets or 2 * shuffle_width(spark)
    ident = F.col(id_col)
    cuts = docs.select(F.percentile_approx(ident, [k / n for k in range(1, n)], 10_000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    bits = max(1, (len(cuts) + 1).bit_length())
    table = F.array(*[F.lit(c) for c in cuts]) if cuts else None
    # binary search: how many cuts are at most the id (0 to len(cuts))
    def step(lo, width):
        at = lo + width
        return F.when((at <= len(cuts)) & (F.element_at(table, F.least(at, F.lit(len(cuts)))) <= ident), at).otherwise(lo)

    widths = F.array(*[F.lit(1 << k) for k in reversed(range(bits))])
    bucket = F.when(ident.isNull(), F.lit(0)).otherwise(F.aggregate(widths, F.lit(0), step)) if cuts else F.lit(0)
    slim = docs.select(bucket.alias("bucket"), ident.alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = Window.orderBy("bucket")  # over one row a range, at most `buckets`
    ends = slim.groupBy("bucket").agg(F.max("doc_id").alias("top"))
    ends = ends.withColumn("before", F.coalesce(F.lead("bucket").over(order), F.min("bucket").over(Window.partitionBy(F.lit(1)))))
    twice = F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("late")), F.struct(F.col("before").alias("b"), F.lit(True).alias("late"))))
    sent = slim.join(F.broadcast(ends), "bucket").withColumn("to", F.explode(F.coalesce(twice, F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("late"))))))
    sent = sent.select(F.col("to.b").alias("bucket"), F.col("to.late").alias("late"), "doc_id", "text")
    placed = sent.repartition(n, "bucket").sortWithinPartitions("bucket", "late", F.col("doc_id").desc_nulls_last(), "text")
    kind = dict(slim.dtypes)["doc_id"]
    return placed.mapInArrow(_compare, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
