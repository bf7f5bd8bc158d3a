"""The n-gram model against counting in plain Python."""

import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from counterpoise.llm import ngramlm
from counterpoise.llm.eliasfano import EliasFano, Trie, quantised
from counterpoise.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, learn boolean"
END = object()


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [END]


def brute(rows):
    """(key, held, n_tokens, n_known, base, score) per row, without quantisation."""
    grams = {1: Counter(), 2: Counter(), 3: Counter()}
    for _, text, learn in rows:
        if learn:
            t = tokens(text)
            for k in grams:
                grams[k].update(tuple(t[i : i + k]) for i in range(len(t) - k + 1))
    total, kinds = sum(grams[1].values()), len(grams[1])
    kept = {k: {g: n for g, n in grams[k].items() if n >= ngramlm.MIN_COUNT[k]} for k in (2, 3)}

    def p(gram):
        w = gram[-1:]
        if len(gram) == 1:
            return (grams[1][w] + 0.1) / (total + 0.1 * (kinds + 1))
        k, prior = len(gram), ngramlm.PRIOR[len(gram)]
        return (kept[k].get(gram, 0) + prior * p(gram[1:])) / (grams[k - 1][gram[:-1]] + prior)

    out = []
    for key, text, learn in rows:
        t = tokens(text)
        base = sum(math.log10(p((w,))) for w in t)
        score = sum(math.log10(p(tuple(t[max(0, i - 2) : i + 1]))) for i in range(len(t)))
        known = sum(grams[1][(w,)] > 0 for w in t)
        out.append((key, not learn, len(t), known, base, score))
    return out, total


def check(spark, rows, score_error):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("clash")).repartition(3)
    scored = ngramlm.train_and_score(df, F.col("learn"))
    got = scored.scores.collect()
    want, total = brute(rows)
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3], r[5])
    got = sorted([tuple(r[c] for c in (0, 1, 2, 3, 5, 6)) for r in got], key=order)
    for g, w in zip(got, sorted(want, key=order), strict=True):
        assert g[:4] == w[:4]
        assert g[4] == pytest.approx(w[4], abs=1e-6)
        assert abs(g[5] - w[5]) <= score_error * w[2] + 1e-6, (g, w)
    return scored, total


def corpus(n, words, seed=1):
    rng = np.random.default_rng(seed)
    share = 1 / np.arange(1, words + 1)
    rows = []
    for i in range(n):
        ws = [f"W{x}" if x % 3 else f"w{x}é" for x in rng.choice(words, rng.integers(0, 60), p=share / share.sum())]
        rows.append((i, "\n".join(ws), bool(i % 4)))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_scores_equal_counting(spark, monkeypatch, small):
    if small:  # many slabs and shards, frequent words in several of them
        for name, value in (("SLAB", 100), ("SHARD", 300), ("SPLIT", 20)):
            monkeypatch.setattr(ngramlm, name, value)
    rows = corpus(120, 12)
    rows += [(None, "w0é W1 W1 W1", True), (None, None, True), (7, "", False), (7, " \t", None), (200, "zz yy zz", False)]
    # few different probabilities in a shard are exact, many are a little off
    scored, total = check(spark, rows, 0.02)
    assert scored.scores.first()["train_tokens"] == total
    grams, held = Counter(), Counter()
    for _, text, learn in rows:
        t = tokens(text)
        if learn:
            for k in (2, 3):
                grams.update(tuple(t[i : i + k]) for i in range(len(t) - k + 1))
    for r in scored.levels.filter("round > 1").collect():
        trie, codes, book = ngramlm.open_level(bytes(r["data"]))
        held[r["round"]] += len(codes)
        assert trie.words[-1].n == len(codes) and (codes < len(book)).all()
    assert held == {k: sum(len(g) == k and n >= ngramlm.MIN_COUNT[k] for g, n in grams.items()) for k in (2, 3)}


def test_few_probabilities_are_exact(spark):
    check(spark, [(i, "a b c d a b", True) for i in range(5)] + [(9, "a b c x a", False)], 1e-6)


def test_long_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ngramlm, "SLAB", 1000)
    long = " ".join(f"v{i % 700}" for i in range(20_000))
    check(spark, [(1, long, True), (2, long, True), (2, long, False), (3, None, None)], 0.02)
    # nothing is learned
    got = ngramlm.train_and_score(spark.createDataFrame([(1, "a b", False)], SCHEMA), F.col("learn")).scores.first()
    assert (got["n_tokens"], got["n_known"], got["train_tokens"], got["base_score"]) == (3, 0, 0, 0.0)
    empty = ngramlm.train_and_score(spark.createDataFrame([], SCHEMA), F.col("learn"))
    assert empty.scores.count() == 0 and empty.levels.count() == 0


def test_sequences_and_tries():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 10), (1000, 50), (1000, 10**12), (50, 2**62)):
        v = np.sort(rng.integers(0, top, n))
        e = EliasFano(EliasFano.build(v))
        i = rng.integers(0, max(1, n), 300)[: 300 * (n > 0)]
        assert (e.get(i) == v[i]).all()
        q = rng.integers(0, top + 5, 300)
        a, b = np.sort(rng.integers(0, n + 1, (2, 300)), axis=0)
        want = [s + np.searchsorted(v[s:t], x) for x, s, t in zip(q, a, b)]
        assert e.successor(q, a, b).tolist() == want
    assert len(EliasFano.build(np.arange(0, 10**8, 1000))) * 8 < 13 * 10**5
    for depth in (1, 2, 3):
        rows = np.unique(rng.integers(0, 30, (4000, depth)), axis=0)
        at = {tuple(r): i for i, r in enumerate(rows.tolist())}
        q = rng.integers(0, 33, (5000, depth))
        assert Trie(Trie.build(rows)).find(q).tolist() == [at.get(tuple(x), -1) for x in q.tolist()]
        assert (Trie(Trie.build(rows[:0])).find(q) == -1).all()
    x = rng.normal(size=10_000)
    codes, book = quantised(x)
    assert len(book) <= 256 and np.abs(book[codes] - x).max() <= (x.max() - x.min()) / 256
    codes, book = quantised(np.array([1.0, -2.0, 1.0]))
    assert book[codes].tolist() == [1.0, -2.0, 1.0]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_query_equals_counting(spark):
    got = {r["doc_id"]: r for r in QUERIES["op11_ngram_scores"](spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").toPandas()
    learn = [zlib.crc32(str(i).encode()) % 10 != 0 for i in docs.doc_id]
    want, total = brute(list(zip(docs.doc_id.tolist(), docs.text.tolist(), learn)))
    assert len(got) == len(want)
    for key, held, n, known, base, score in want:
        r = got[key]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, abs=1e-6)
        assert abs(r["score"] - score) <= 0.02 * n + 0.1
