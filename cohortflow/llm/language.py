"""Language identification by multilingual mixture inference.

Each language is a distribution over hashed character trigrams, learnt from labelled texts.  A document is a mixture:
every word (a run of letters) is drawn from one of the languages, its trigrams from that language.  Expectation
maximisation estimates the document's language proportions from the words' likelihoods.  Which languages a document has
is decided by penalised likelihood: the languages are added in order of their proportions as long as the likelihood of
the restricted mixture gains more than half the logarithm of the number of words (times `penalty`) each.

All labelled texts are learnt from; the model is a table of languages times `BUCKETS`, which is what the tasks are
given.  Texts are read in two scans and never shuffled; a task holds one slice of a batch.

Edge cases: a null or empty text, or one without a letter, is `und` with score 0; so is every text when nothing could be
learnt.  A null id falls into the part that its hash text `null` has; ties of proportions go to the language that comes
first by code point; repeated rows are judged each; an empty table gives an empty result; extra columns are ignored;
texts are read whole, runs of letters beyond `RUN` are cut into several words.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import text_slices

BUCKETS = 1 << 14
RUN = 24
WORDS = re.compile(rf"[^\W\d_]{{1,{RUN}}}")
UND = "und"
#: Share of a trigram's probability that comes from all languages together; the same for every language, so that
#: trigrams a language has not shown tell nothing about it.
SHARED = 0.05


def vocabulary(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(different words, word number of each word in order, words of each text)."""
    number = defaultdict()
    number.default_factory = number.__len__
    found = [WORDS.findall(t.lower()) for t in texts]
    sizes = np.array([len(f) for f in found], np.int64)
    codes = np.fromiter((number[w] for f in found for w in f), np.int64, int(sizes.sum()))
    return list(number), codes, sizes


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of the trigram around each letter, with a blank before and after each word; letters of each word)."""
    chars = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = (chars[:-2] * np.uint64(0x9E3779B97F4A7C15) + chars[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + chars[2:]
        h = (h * np.uint64(0x165667B19E3779F9)) >> np.uint64(64 - 14)
    return h[chars[1:-1] != 32].astype(np.int64), np.array([len(w) for w in words], np.int64)


# --- learning


def trigram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, bucket, n) over (lang, text).  A task sends at most one row a language and bucket."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in set(langs):
                mine = [t for x, t in zip(langs, texts) if x == lang]
                for i, j in text_slices([len(t) for t in mine]):
                    words, codes, _ = vocabulary(mine[i:j])
                    if words:
                        bucket, letters = trigrams(words)
                        times = np.repeat(np.bincount(codes, minlength=len(words)), letters)
                        n = np.bincount(bucket, weights=times, minlength=BUCKETS).astype(np.int64)
                        total[lang] = total[lang] + n if lang in total else n
            if len(total) > 500:
                yield from _sent(total)
                total = {}
        yield from _sent(total)

    return labelled.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def _sent(total: dict[str, np.ndarray]):
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])


class Model:
    """Languages in order, and the logarithm of each one's trigram probabilities, (BUCKETS, languages)."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        own = counts / np.maximum(counts.sum(axis=0), 1)
        everyone = (counts.sum(axis=1) + 1.0) / (counts.sum() + len(counts))
        self.log_p = np.log((1 - SHARED) * own + SHARED * everyone[:, None])


def fit(labelled: DataFrame, most_langs: int = 1000) -> Model:
    """The model of all rows of (lang, text).  The table is fetched, so more than `most_langs` languages are an error."""
    rows = labelled.filter(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    langs = sorted(r[0] for r in rows.select("lang").distinct().limit(most_langs + 1).collect())
    if len(langs) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    number = {x: i for i, x in enumerate(langs)}
    counts = np.zeros((BUCKETS, len(langs)))
    for r in trigram_counts(rows).toLocalIterator(prefetchPartitions=True):  # languages times BUCKETS rows at most
        counts[r["bucket"], number[r["lang"]]] = r["n"]
    return Model(langs, counts)


# --- inference


def word_likelihoods(words: list[str], model: Model) -> np.ndarray:
    """(words, languages): the logarithm of each word's probability in each language."""
    bucket, letters = trigrams(words)
    starts = np.concatenate([[0], np.cumsum(letters)[:-1]])
    return np.add.reduceat(model.log_p[bucket], starts, axis=0)


def maximise(like: np.ndarray, times: np.ndarray, doc: np.ndarray, share: np.ndarray, rounds: int = 60, tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Expectation maximisation for all documents at once: (shares, log likelihood less the rows' own scale).

    like: (entries, languages), each row scaled to a greatest value of 1; an entry is a word of a document, `times` how
    often it occurs, `doc` its document (in order, none without entries); share: (documents, languages) to start from,
    languages with share 0 stay out.  Documents whose shares have settled take no part in further steps."""
    share = share.copy()
    starts = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1])
    sizes = np.diff(np.append(starts, len(doc)))
    total = np.add.reduceat(times, starts).astype(float)
    live = np.arange(len(starts))
    for _ in range(rounds):
        sel = np.repeat(np.isin(np.arange(len(starts)), live), sizes) if len(live) < len(starts) else slice(None)
        at = np.repeat(np.arange(len(live)), sizes[live])
        joint = like[sel] * share[live][at]
        joint *= (times[sel] / joint.sum(axis=1))[:, None]
        begin = np.concatenate([[0], np.cumsum(sizes[live])[:-1]])
        new = np.add.reduceat(joint, begin, axis=0) / total[live][:, None]
        moved = np.abs(new - share[live]).max(axis=1)
        share[live] = new
        live = live[moved > tol]
        if not len(live):
            break
    fit_ = np.add.reduceat(times * np.log((like * share[doc]).sum(axis=1)), starts)
    return share, fit_


def mixtures(texts: list[str], model: Model, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """((texts, languages) proportions under the chosen language sets, number of words of each text)."""
    n_langs = len(model.langs)
    words, codes, sizes = vocabulary(texts)
    out = np.zeros((len(texts), n_langs))
    if not words or not n_langs:
        return out, sizes
    key, times = np.unique(np.repeat(np.arange(len(texts)), sizes) * len(words) + codes, return_counts=True)
    has, doc = np.unique(key // len(words), return_inverse=True)
    log = word_likelihoods(words, model)
    like = np.maximum(np.exp(log - log.max(axis=1, keepdims=True)), 1e-30)[key % len(words)]
    full, _ = maximise(like, times, doc, np.full((len(has), n_langs), 1 / n_langs))
    order = np.argsort(-full, axis=1, kind="stable")
    place = np.argsort(order, axis=1, kind="stable")
    cost = penalty * 0.5 * np.log(sizes[has])
    best = np.where(place == 0, 1.0, 0.0)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1])
    best_fit = np.add.reduceat(times * np.log((like * best[doc]).sum(axis=1)), starts)
    live = np.arange(len(has))
    for k in range(2, n_langs + 1):
        sel = np.isin(doc, live)
        start = np.where(place[live] < k, np.maximum(full[live], 1e-6), 0.0)
        share, fit_ = maximise(like[sel], times[sel], np.searchsorted(live, doc[sel]), start / start.sum(axis=1, keepdims=True))
        better = fit_ - best_fit[live] > cost[live]
        live, share, fit_ = live[better], share[better], fit_[better]
        if not len(live):
            break
        best[live], best_fit[live] = share, fit_
    out[has] = best
    return out, sizes


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 1.0) -> DataFrame:
    """Per document: doc_id, lang_pred, score (the share of that language, drawn to even shares by one word), and the
    languages found with their shares, `langs`."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    share_t = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in text_slices([len(t) for t in texts]):
                share, sizes = mixtures(texts[i:j], model, penalty)
                some = sizes > 0 if model.langs else np.zeros(j - i, bool)
                top = share.argmax(axis=1) if model.langs else np.zeros(j - i, int)
                score = (share[np.arange(j - i), top] * sizes + 1 / len(model.langs)) / (sizes + 1) if model.langs else np.zeros(j - i)
                found = [[{"lang": model.langs[x], "share": float(row[x])} for x in np.flatnonzero(row)] for row in share]
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(i, j - i), pa.array([model.langs[t] if s else UND for s, t in zip(some, top)], pa.string()),
                    pa.array(np.where(some, score, 0.0)), pa.array(found, share_t),
                ], ["doc_id", "lang_pred", "score", "langs"])

    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, lang_pred string, score double, langs array<struct<lang:string,share:double>>")


def held_out(ident: Column, parts: int = 3, part: int = 1) -> Column:
    """Whether a document is left out of learning: the remainder of the checksum of its id as text."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("null")).cast("binary")) % parts == part


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the labelled documents that are not held out, then judge all: doc_id, held_out, lang_pred, score, langs."""
    learn = docs.filter(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    judged = identify(docs, fit(learn), id_col, text_col)
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "langs")
