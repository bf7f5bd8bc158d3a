"""The divergence audit against brute force, SQL and odd rows."""

import os
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from counterpoise.llm import divergence
from counterpoise.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string"
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def brute(rows, least, top):
    docs = [(la or "", so or "", re.findall(divergence.TERM.decode("latin-1"), re.sub(
        "[A-Z]", lambda m: m[0].lower(), t or ""))) for _, t, la, so in rows]
    df, tf = defaultdict(Counter), defaultdict(Counter)
    for la, so, ws in docs:
        df[la].update(set(ws))
        tf[la, so].update(ws)
    out = []
    for la in df:
        kept = [w for w, n in df[la].items() if n >= least]
        sources = [s for x, s in tf if x == la]
        share = lambda c, n: 1 + 10**9 * (c + 5) // (n + 5 * len(kept))
        p = {s: {w: share(tf[la, s][w], sum(tf[la, s][v] for v in kept)) for w in kept} for s in sources}
        all_ = Counter()
        for s in sources:
            all_.update({w: tf[la, s][w] for w in kept})
        q = {w: share(all_[w], sum(all_.values())) for w in kept}
        for s in sources:
            pairs = [(t, sum(abs(p[s][w] - p[t][w]) for w in kept)) for t in sources if t != s]
            over = [(w, p[s][w] - q[w]) for w in kept if tf[la, s][w] > 0 and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", over, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(la, s, part, i, v, r + 1) for r, (i, v) in enumerate(found[:most])]
    return sorted(out)


def test_perfect_hashes_are_minimal():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 70_000):
        h = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        ph = divergence.PerfectHash(h)
        assert sorted(ph.slots(h).tolist()) == list(range(len(h)))
    bits = sum(len(w) for w in ph.levels) * 64
    assert bits < 5 * len(h)
    shard = divergence.Shard("en", [b"a", b"b", "cé".encode()], 0)
    words = np.array([w.encode() for w in ["b", "x", "cé", "a", "y", "z"] + [f"w{i}" for i in range(500)]], object)
    at = shard.find(words, divergence.names(list(words), "en"))
    assert (at >= 0).sum() == 3 and [shard.stored[i] for i in at[[0, 2, 3]]] == [b"b", "cé".encode(), b"a"]


@pytest.mark.parametrize("small", [False, True])
def test_divergence_equals_brute_force(spark, monkeypatch, small):
    if small:  # several shards, rounds, blocks, tiles and flushes
        for name, value in (("SHARD_TERMS", 7), ("BROADCAST_BYTES", 900), ("BLOCK_SLOTS", 5),
                            ("TILE", 2), ("COUNTED_TERMS", 20), ("SLOT_BYTES", 300)):
            monkeypatch.setattr(divergence, name, value)
    rng = np.random.default_rng(2)
    vocabulary = [f"{a}{b}" for a in "abcdeéжK" for b in ("", "x", "Y", "zz")]
    rows = []
    for i in range(150):
        ws = rng.choice(vocabulary, rng.integers(0, 40), p=np.array(
            [1 / (k + 1) for k in range(32)]) / sum(1 / (k + 1) for k in range(32)))
        rows.append((i, "1 ".join(ws) + "_", ["en", "de", None][i % 3], f"s{i % 7}" if i % 7 else None))
    rows += [(200, None, "en", "only empty"), (201, "", "xx", "y"), (202, "q", "xx", "z"), (203, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("slot", F.lit("clash")).repartition(3)
    got = divergence.divergence(df, least=9, top=4)
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 9, 4)


def test_divergence_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert divergence.divergence(empty).count() == 0
    one = spark.createDataFrame([(1, "a b", "en", "s"), (2, "a", "en", "t")] * 2, SCHEMA)
    got = sorted(tuple(r) for r in divergence.divergence(one).collect())
    assert got == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_divergence_equals_sql(spark):
    got = sorted(tuple(r) for r in QUERIES["op12_source_divergence"](spark, DATA).select(COLUMNS).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    assert got == sorted(con.sql(ORACLES["op12_source_divergence"]).fetchall()) and got
