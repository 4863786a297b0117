"""Quality rules: a decision list learned by sequential covering from labelled statistics.

Statistics of each text (counts only) are computed in one scan.  From labelled documents, rules are grown one at a
time: threshold conditions are added by information gain until the rule covers no good document of the grow part,
then trailing conditions are pruned while precision on the prune part does not fall; a rule that is not precise enough
there ends the list.  Documents a rule covers are set aside before the next is grown.  The list is emitted as an
ordered conditional expression over the statistics, so judging all documents is a built-in expression.

The classifier is fitted on at most `fit_rows` labelled documents (a documented bound, the smallest hashes of the ids),
with equal numbers from both classes where there are enough; everything else covers all rows and whole texts.

Edge cases: a null text has no words and fails the base rules; labels that are null or of unknown documents are not
used; without labels of both classes the list is empty and keeps everything that passes the base; repeated rows are
judged each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_long_words")
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_SPACES = np.array([9, 10, 11, 12, 13, 32])
_SPAN = 5


def _repeat_words(words: list[bytes]) -> int:
    """Words inside five-word windows that occur at least twice."""
    n = len(words)
    if n <= _SPAN:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, n)
    m = n - _SPAN + 1
    key = np.zeros(m, np.uint64)
    for k in range(_SPAN):
        key = (key + ids[k : k + m] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(m, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    at = np.flatnonzero(again)  # equal hashes; the words decide
    first: dict[tuple, int] = {}
    hit = np.zeros(n + 1, np.int64)
    for i in at.tolist():
        gram = tuple(words[i : i + _SPAN])
        if gram in first:
            for j in (first[gram], i):
                hit[j] += 1
                hit[j + _SPAN] -= 1
        else:
            first[gram] = i
    return int((np.cumsum(hit[:n]) > 0).sum())


def text_stats(text: str) -> tuple[int, ...]:
    """The statistics of one text, in the order of STATS."""
    raw = text.encode()
    words = raw.split()  # bytes split at the six ASCII white-space characters
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = int(c.sum() - c[128:192].sum())  # continuation bytes are no code points
    seen, dup, lines = set(), 0, 0
    for line in raw.split(b"\n"):
        if line.split(None, 1):
            lines += 1
            dup += line in seen
            seen.add(line)
    return (len(words), chars - int(c[_SPACES].sum()), int(c[_SYMBOLS].sum()), dup, _repeat_words(words), lines, int(c[65:91].sum()),
            int(c[48:58].sum()), int(c[[33, 63]].sum()), sum(len(w) > 24 for w in words))


def _run(batches):
    for b in batches:
        rows = [text_stats(t.as_py()) for t in b.column(b.num_columns - 1)]
        cols = list(zip(*rows)) or [()] * len(STATS)
        kept = [b.column(i) for i in range(b.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, pa.int64()) for c in cols]], [*b.schema.names[:-1], *STATS])


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, *STATS) per row; no shuffle."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return slim.mapInArrow(_run, f"doc_id {dict(slim.dtypes)['doc_id']}, " + ", ".join(f"{s} long" for s in STATS))


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns as the struct `row`, and the statistics as the struct `stats`."""
    @F.pandas_udf("struct<" + ",".join(f"{s}:long" for s in STATS) + ">")
    def stats(texts):
        import pandas as pd

        return pd.DataFrame([text_stats(t or "") for t in texts], columns=list(STATS))

    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), stats(F.col(text_col)).alias("stats"))


#: Features of the rules: name -> (numerator, denominator); both plain statistics.
FEATURES = {
    "n_words": ("n_words", None), "mean_word": ("word_chars", "n_words"), "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "upper": ("n_upper", "word_chars"),
    "digits": ("n_digits", "word_chars"), "marks": ("n_marks", "n_words"), "words_a_line": ("n_words", "n_lines"), "long_words": ("n_long_words", "n_words"),
}


def feature(name: str, stat) -> Column:
    a, b = FEATURES[name]
    return stat(a).cast("double") if b is None else stat(a) / F.greatest(stat(b), F.lit(1)).cast("double")


def base_failed(stat) -> Column:
    return (stat("n_words") < 10) | (100 * stat("n_repeat_words") > 20 * stat("n_words"))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        v = x[:, names.index(self.name)]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self, stat) -> Column:
        v = feature(self.name, stat)
        return v > F.lit(self.threshold) if self.above else v <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x, names)
    return out


def _grow(x: np.ndarray, y: np.ndarray, names: list[str], cuts: int, most: int) -> Rule:
    """Conditions by information gain until no negative is covered."""
    rule: list[Condition] = []
    at = np.ones(len(x), bool)
    while len(rule) < most and (y[at] == 0).any() and (y[at] == 1).any():
        p0, n0 = (y[at] == 1).sum(), (y[at] == 0).sum()
        base, best, pick = np.log2(p0 / (p0 + n0)), 1e-9, None
        for f, name in enumerate(names):
            v = x[at, f]
            for t in np.unique(np.quantile(v, np.linspace(0, 1, cuts + 2)[1:-1], method="lower")):
                above = v > t
                for side in (True, False):
                    m = above if side else ~above
                    p, n = (y[at][m] == 1).sum(), (y[at][m] == 0).sum()
                    if p and p + n < p0 + n0:
                        gain = p * (np.log2(p / (p + n)) - base)
                        if gain > best:
                            best, pick = gain, Condition(name, side, float(t))
        if pick is None:
            break
        rule.append(pick)
        at &= pick.holds(x, names)
    return tuple(rule)


def _prune(rule: Rule, x: np.ndarray, y: np.ndarray, names: list[str]) -> Rule:
    """The prefix of the rule with the best (p - n) / (p + n); of equals the shortest."""
    def worth(r: Rule) -> float:
        m = _covered(r, x, names)
        p, n = (y[m] == 1).sum(), (y[m] == 0).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=())


def learn(x: np.ndarray, y: np.ndarray, names: list[str], least_precision: float = 0.97, max_rules: int = 16, max_conditions: int = 4,
          cuts: int = 48, seed: int = 7) -> list[Rule]:
    """Ordered rules that cover class 1 (to be rejected)."""
    rng = np.random.default_rng(seed)
    rules: list[Rule] = []
    left = np.ones(len(y), bool)
    while len(rules) < max_rules and (y[left] == 1).any():
        at = rng.permutation(np.flatnonzero(left))
        cut = len(at) * 2 // 3
        g, p = at[:cut], at[cut:]
        rule = _prune(_grow(x[g], y[g], names, cuts, max_conditions), x[p], y[p], names)
        m = _covered(rule, x[p], names) if rule else np.zeros(len(p), bool)
        pos, neg = (y[p][m] == 1).sum(), (y[p][m] == 0).sum()
        if not rule or pos < 2 or pos / (pos + neg) < least_precision:
            break
        rules.append(rule)
        left &= ~_covered(rule, x, names)
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **how) -> list[Rule]:
    """Rules that reject documents labelled 0, from at most `fit_rows` labelled documents."""
    known = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("q")).filter(F.col("q").isin(0, 1) & F.col("k").isNotNull())
    known = known.groupBy("k").agg(F.min("q").alias("q"))
    half = [known.filter(F.col("q") == q).orderBy(F.xxhash64("k"), "k").limit(fit_rows // 2) for q in (0, 1)]
    few = half[0].union(half[1])  # at most fit_rows rows of two numbers
    some = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("text")).join(F.broadcast(few), "k")
    stats = document_stats(some.select(F.struct("k", "q").alias("doc_id"), "text"))
    names = list(FEATURES)
    rows = stats.filter(~base_failed(F.col)).select("doc_id.k", (1 - F.col("doc_id.q")).cast("int").alias("bad"), *[feature(n, F.col).alias(f"f_{n}") for n in names]).toPandas()
    rows = rows.sort_values(["k", *[f"f_{n}" for n in names]])
    return learn(rows[[f"f_{n}" for n in names]].to_numpy(np.float64), rows["bad"].to_numpy(), names, **how)


def verdict(rules: list[Rule], stat=F.col) -> Column:
    """True for documents to keep: the ordered rules as one conditional expression."""
    out = F.when(base_failed(stat), F.lit(False))
    for rule in rules:
        both = F.lit(True)
        for c in rule:
            both = both & c.column(stat)
        out = out.when(both, F.lit(False))
    return out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, the statistics, base_failed, kept."""
    s = document_stats(docs, id_col, text_col)
    return s.select("*", base_failed(F.col).alias("base_failed"), verdict(rules).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of the rows that pass the base rules and the list learned from the labels of these documents."""
    rules = fit_rules(docs, labels, id_col=id_col, text_col=text_col)
    return with_stats(docs, text_col).filter(verdict(rules, lambda name: F.col(f"stats.{name}"))).select("row.*")
