"""Vector codes against brute force in Python integers."""

import hashlib
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from counterpoise.llm import vectorcodes
from counterpoise.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, rounds=2):
    """(id, code, error) and the digest of the codebooks, by Python integers alone."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return [], None
    dim = max(1, -(-max(len(r[1]) for r in kept) // 16)) * 16
    whole = lambda x: math.floor(256 * x) if math.isfinite(256 * x) else 256 * int(x)
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    made = [[whole(x) for x in v] + [0] * (dim - len(v)) for _, v, _ in kept]
    w = dim // 16
    parts = [[v[p * w : p * w + w] for v in made] for p in range(16)]
    books = [p[:64] for p in parts]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for turn in range(rounds + 1):
        found = [[nearest(x, b) for x in p] for p, b in zip(parts, books)]
        if turn == rounds:
            break
        for p in range(16):
            for e in range(len(books[p])):
                own = [x for x, (_, f) in zip(parts[p], found[p]) if f == e]
                if own:
                    books[p] = list(books[p])
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    text = ",".join(str(v) for b in books for c in b for v in c)
    coded = [
        (r[0], bytes(f[i][1] for f in found).hex(), sum(f[i][0] for f in found), r[2])
        for i, r in enumerate(kept)
    ]
    return coded, hashlib.sha256(text.encode()).hexdigest()


def check(spark, rows, batch=50):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("code", F.lit("clash"))
    got = vectorcodes.vector_codes(df.repartition(3)).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want, digest = brute(rows)
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    most = 2**63 - 1
    assert sorted([(r["vec_id"], r["code"], r["error"]) for r in got], key=order) == sorted(
        [(i, c, min(e, most)) for i, c, e, _ in want], key=order)
    assert {r["codebooks_sha256"] for r in got} <= {digest}
    by_label = {}
    for _, _, e, label in want:
        by_label[label] = by_label.get(label, 0) + min(e, most)
    assert all(r["label_error"] == min(by_label[r["label"]], most) for r in got)
    return got


@pytest.mark.parametrize("spread", [0.0, 0.02, 1.0])
def test_codes_equal_brute_force(spark, spread):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(9, 32))
    rows = [
        (int(i), (middle[i % 9] + spread * rng.normal(size=32)).tolist(), int(i % 4) or None)
        for i in rng.permutation(400)
    ]
    check(spark, rows)


def test_bounds_spare_most_comparisons(spark):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(64, 16)) * 50
    x = np.floor(np.repeat(middle, 60, axis=0) * 256 + rng.normal(size=(64 * 60, 16))).astype(np.int64)
    books = vectorcodes.Codebooks(np.split(x[::60], 16, axis=1))
    codes, errors, state, _, full = vectorcodes._assign(x, books, None, 16)
    assert full == 16 * len(x)
    moved = vectorcodes.Codebooks([c + 1 for c in books.parts], [np.ones(64) for _ in range(16)])
    again, errors2, _, need, full = vectorcodes._assign(x, moved, state, 16)
    want = np.column_stack([vectorcodes.squares(x[:, p : p + 1], c).argmin(1) for p, c in enumerate(moved.parts)])
    assert (again == want).all() and full < 0.2 * 16 * len(x)


def test_large_components_and_odd_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=5) * 10.0 ** rng.integers(0, 40)).tolist(), 1) for i in range(90)]
    rows += [
        (5, [1.0, None], 1), (6, None, 1), (7, [float("nan")], 2), (8, [float("inf")], 2),
        (None, [0.5] * 20, None), (None, [], None), (3, [-0.25, 7.0], None), (3, [-0.25, 7.0], 2),
        (91, [1e308, -1e308], 3),
    ]
    got = check(spark, rows)
    assert len(got) == 95
    check(spark, rows[90:])
    empty = vectorcodes.vector_codes(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and "codebooks_sha256" in empty.columns
    assert vectorcodes.vector_codes(spark.createDataFrame(rows[91:92], SCHEMA)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_codes_equal_sql(spark):
    got = QUERIES["op13_vector_codes"](spark, DATA).toPandas().sort_values("vec_id")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = con.sql(ORACLES["op13_vector_codes"]).df().sort_values("vec_id")
    columns = ["vec_id", "code", "error", "label_error", "codebooks_sha256", "label"]
    assert got[columns].values.tolist() == want[columns].values.tolist()
