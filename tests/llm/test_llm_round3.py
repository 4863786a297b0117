"""Collocations, language mixtures and importance resampling against SQL, brute force and odd rows."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from conftest import SMALL
from oracle_harness import compare, duck
from pyspark.sql import functions as F

from cohortflow.llm import collocations, language, resampling
from cohortflow.llm import queries as Q

LONG = " ".join(f"word{i % 97} and{i % 31}" + ("." if i % 50 == 0 else "") for i in range(20_000))
ODD = [
    (1, "The cat sat on the mat, the cat ran; THE CAT sat.", "en"), (2, None, "en"), (3, "", None), (4, "the cat sat", None), (4, "the cat sat", None),
    (None, "the cat \x00 a\x00b \x0b the\tcat", "en"), (6, LONG, "xx"), (7, LONG + " more", "xx"), (8, " \n\t ,.;", "en"), (9, "éa éa ÉA é\U0001f600 \U0001f600", "fr"), (10, "12 34", "fr"),
]


@pytest.fixture(scope="module")
def odd(spark):
    d = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    return d.select("*", *[F.lit(1).alias(c) for c in ("n", "phrase", "score", "rank", "weight", "bucket", "shard", "h1", "row", "langs", "words")])


# --- 11 collocations


def brute_collocations(rows, least, top, longest=5):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, count in f.items():
        good = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        covered = Counter()
        for p, a in good.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    covered[p[i : i + size]] = max(covered[p[i : i + size]], a)
        found = []
        for p, a in good.items():
            if covered[p] >= a:
                continue
            score, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return out


def _set(df):
    return {tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


@pytest.mark.parametrize("shards,block_words", [(3, 1 << 20), (2, 300)])
def test_collocations_brute_force(spark, shards, block_words):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(3)
    got = _set(collocations.collocations(docs, least=8, top=500, shards=shards, block_words=block_words))
    want = brute_collocations([(r.text, r.lang) for r in docs.collect()], 8, 500)
    assert got == want and len(want) > 300


def test_collocations_blocks_cut_inside_a_piece(spark):
    rows = [("a b c d e " * 400, "x"), ("a b c d e. " * 30 + "q a b", None), ("a b c d e", "x")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    for words in (7, 64):
        assert _set(collocations.collocations(docs, least=5, top=100, block_words=words)) == brute_collocations(rows, 5, 100)


def test_collocations_odd_rows(odd):
    got = _set(collocations.collocations(odd, least=3, top=2000))
    assert got == brute_collocations([(t, x) for _, t, x in ODD], 3, 2000)
    assert collocations.collocations(odd.limit(0)).count() == 0


def test_collocations_oracle(spark):
    r = compare(spark, "op11", Q.op11_dynamic_collocations, Q.ORACLE["op11_dynamic_collocations"], SMALL, duck(SMALL))
    assert r["values_match"] and r["types_match"], r


# --- 12 languages


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: r for r in Q.op12_mixture_language(spark, SMALL).collect()}
    rows = docs.select("doc_id", "text", "lang").collect()
    assert len(got) == len(rows) and {r.held_out for r in got.values()} == {True, False}
    held = [r for r in rows if got[r.doc_id].held_out]
    assert all(got[r.doc_id].held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def _model(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("length(text) > 200")
    return language.fit(docs.select("lang", "text"))


def test_languages_em_and_selection_by_brute_force(spark):
    model = _model(spark)
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").filter("length(text) between 200 and 900").orderBy("doc_id").limit(12).collect()
    texts = [a.text + " " + b.text[: 40 * i] for i, (a, b) in enumerate(zip(rows, rows[1:]))]
    got, sizes = language.mixtures([*texts, "", "12 34"], model)
    assert not got[-2:].any() and not sizes[-2:].any()

    def em(log, times, langs):
        share = np.full(len(langs), 1 / len(langs))
        for _ in range(500):
            joint = np.exp(log[:, langs] - log.max(axis=1, keepdims=True)) * share
            share = (joint / joint.sum(axis=1, keepdims=True) * times[:, None]).sum(axis=0) / times.sum()
        return share, (times * np.log((np.exp(log[:, langs] - log.max(axis=1, keepdims=True)) * share).sum(axis=1))).sum()

    for text, mix in zip(texts, got):
        words = Counter(language.WORDS.findall(text.lower()))
        log = np.array([sum(model.log_p[b] for b in language.trigrams([w])[0]) for w in words])
        times = np.array(list(words.values()))
        full, _ = em(log, times, list(range(len(model.langs))))
        order, chosen, fit = np.argsort(-full, kind="stable"), None, None
        for k in range(1, len(model.langs) + 1):
            share, f = em(log, times, list(order[:k]))
            if fit is not None and f - fit <= 0.5 * math.log(times.sum()):
                break
            chosen, fit = dict(zip(order[:k], share)), f
        assert set(np.flatnonzero(mix > 1e-3)) == {i for i, x in chosen.items() if x > 1e-3}
        assert all(abs(mix[i] - x) < 0.02 for i, x in chosen.items())


def test_languages_mixed_text(spark):
    docs = {r.lang: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").filter("length(text) > 1500").collect()}
    langs = sorted(docs)[:2]
    text = " ".join(docs[x][:1200] for x in langs)
    share, _ = language.mixtures([text], _model(spark))
    assert {m for m, s in zip(_model(spark).langs, share[0]) if s > 0.2} == set(langs)


def test_languages_odd_rows(spark, odd):
    got = language.predict(odd).collect()
    assert len(got) == len(ODD)
    for r in got:
        text = next(t for i, t, _ in ODD if i == r.doc_id)
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or "")) and (r.score == 0) == (r.lang_pred == "und")
    assert language.predict(odd.limit(0)).count() == 0
    bare = language.predict(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in bare.collect()} == {("und", 0.0)}
    with pytest.raises(ValueError):
        language.fit(odd.select("lang", "text"), most_langs=1)


# --- 13 resampling


def brute_resample(docs, target, max_n, buckets, percent, least):
    def feats(text):
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        return len(w), [crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, max_n + 1) for i in range(len(w) - k + 1)]

    made = [(i, *feats(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in made for b in f), Counter(b for x in target for b in feats(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, words, f in made:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words, None])
    pool = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(pool[: percent * len(pool) // 100], 1):
        r[5] = k
    return sorted(((*r[:4], r[5]) for r in rows), key=str)


def test_resample_oracle(spark):
    r = compare(spark, "op13", Q.op13_importance_resample, Q.ORACLE["op13_importance_resample"], SMALL, duck(SMALL))
    assert r["values_match"] and r["types_match"], r


@pytest.mark.parametrize("max_n,buckets", [(1, 10_000), (3, 70_000)])
def test_resample_brute_force(spark, max_n, buckets):
    docs, target = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    got = sorted((tuple(r) for r in resampling.resample(docs, target, max_n, buckets, percent=30).collect()), key=str)
    assert got == brute_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], max_n, buckets, 30, 20)


def test_resample_odd_rows(spark, odd):
    target = spark.createDataFrame([(1, None), (2, "the cat"), (3, "")], "item_id long, text string")
    got = sorted((tuple(r) for r in resampling.resample(odd, target, 2, 512, percent=50, least_words=2).collect()), key=str)
    assert got == brute_resample([(i, t) for i, t, _ in ODD], [None, "the cat", ""], 2, 512, 50, 2)
    assert resampling.resample(odd.limit(0), target).count() == 0
    assert resampling.resample(odd, target.limit(0)).count() == len(ODD)
