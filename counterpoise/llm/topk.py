"""Exact top-k inner products over norm-sorted, rotated vectors.

1. Vectors are turned into whole numbers, so scores are exact.
2. The directions come from the singular value decomposition: the products of all coordinates are
   added up per partition, and the eigenvectors of that small matrix put most of every vector's
   length into its first coordinates.  A rotation leaves inner products as they are.
3. Vectors are ranged by descending length into blocks; so are the queries.
4. Queries are taken in rounds of a fixed number of blocks, which travel to every task.  A round
   first meets the block of the longest vectors, which gives every query a score that its k-th
   best must reach.  Then it meets the other blocks: a block is skipped when its longest vector
   times the query is too short, and inside a block the product over the leading coordinates plus
   the Cauchy-Schwarz bound of the rest rules out most vectors.  What is left gets its exact
   whole-number score.

Vectors are shuffled once, into blocks of a fixed number of rows; a task holds one block of them
and one of queries at a time, and a round's queries and bounds are limited by ROUND.

Defined results: vectors that are NULL, empty or hold a NULL or non-finite component take no part;
ids that are NULL take no part; vectors of unequal dimension are filled with zeros; all finite
components take part, and one whose whole number, or a score, does not fit a long is an error;
only the key and the vector are read, so clashing further columns do no harm; equal scores go to the smaller id; repeated ids are separate candidates, except that a
query never meets rows of its own id; empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterpoise.session import spool

BLOCK = 1024  # vectors per block
QUERY_BLOCK = 512
ROUND = 64  # query blocks per round
RANGE_ROWS = 65_536  # vectors of about one length that one task ranks
HEAD = 0.25  # share of the coordinates that are multiplied before pruning
SAFE = 2.0**53  # up to here sums of whole numbers in doubles are exact
LONGEST = (1 << 63) - 1

PACKED = "block int, n int, longest double, ids binary, vectors binary"
HITS = "query_id long, vec_id long, score long"


def quantized(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) per component, NULL unless all components are finite numbers.

    Finite components whose result does not fit a long are an error, never left out.
    """
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    fits = F.forall(x, lambda v: F.abs(v * scale) < 2.0**63)
    whole = F.transform(x, lambda v: F.floor(v * scale))
    large = F.raise_error(F.lit("a component is too large for whole numbers of 64 bits"))
    made = F.when(fits, whole).otherwise(large.cast("array<bigint>"))
    return F.when(fine & (F.size(x) > 0), made)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b as exact whole numbers."""
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if top <= LONGEST and np.iinfo(np.int64).min not in (a.min(initial=0), b.min(initial=0)):
        return np.einsum("ij,ij->i", a, b)
    exact = (a.astype(object) * b.astype(object)).sum(axis=1)
    if any(abs(x) > LONGEST for x in exact):
        raise ValueError("a score does not fit a long")
    return exact.astype(np.int64)


def _matrix(rows, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim), np.int64)
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def directions(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all vectors, strongest first."""

    def sums(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            m = _matrix(b["v"], dim).astype(float)
            total += m.T @ m
        yield pd.DataFrame({"i": np.arange(dim), "row": list(total)})

    parts = vectors.select("v").mapInPandas(sums, "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "x"))
    rows = cells.groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    gram = np.zeros((dim, dim))
    for i, j, x in rows:
        gram[i, j] = x
    return np.linalg.eigh(gram)[1][:, ::-1].copy()


def _packed(vectors: DataFrame, dim: int, size: int) -> DataFrame:
    """Blocks of ``size`` vectors by descending length, numbered from 0 on."""
    # each range of lengths is ranked on its own, long ones in several parts; the counts of the
    # ranges before give the number
    ranged = vectors.withColumn("half", F.floor(F.log2(F.col("norm2") + 1) * 4).cast("int"))
    parts = F.ceil(F.count("*") / RANGE_ROWS).alias("parts")
    per_range = ranged.groupBy("half").agg(parts)  # a few hundred rows: lengths are doubles
    salt = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    cut = ranged.join(F.broadcast(per_range), "half").withColumn("salt", salt)
    order = Window.partitionBy("half", "salt").orderBy(F.desc("norm2"), "id")
    counts = cut.groupBy("half", "salt").agg(F.ceil(F.count("*") / size).alias("blocks"))
    ahead = Window.orderBy(F.desc("half"), "salt")  # one row per range and part
    starts = counts.withColumn("start", F.sum("blocks").over(ahead) - F.col("blocks"))
    number = F.floor((F.row_number().over(order) - 1) / size)
    rows = cut.withColumn("at", number).join(starts, ["half", "salt"])
    rows = rows.select((F.col("start") + F.col("at")).cast("int").alias("block"), "id", "v", "norm2")

    def pack(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["norm2", "id"], ascending=[False, True])
        one = {
            "block": b["block"].iloc[0],
            "n": len(b),
            "longest": float(np.sqrt(b["norm2"].iloc[0])),
            "ids": b["id"].to_numpy(np.int64).tobytes(),
            "vectors": _matrix(b["v"], dim).tobytes(),
        }
        return pd.DataFrame([one])

    return rows.groupBy("block").applyInPandas(pack, PACKED)


def _best(query, ids, scores, k):
    """Row numbers of the k best per query, ties to the smaller id."""
    order = np.lexsort((ids, -scores, query))
    q = query[order]
    first = np.searchsorted(q, q)
    return order[np.arange(len(q)) - first < k]


def _kernel(asked, turn: np.ndarray, dim: int, k: int):
    """Hits of the asked query blocks (ids, vectors, least scores) in vector blocks."""
    head = max(1, int(dim * HEAD))

    def one(q_ids, qi, least, x_ids, xi, longest):
        q, x = qi.astype(float), xi.astype(float)
        q_len = np.linalg.norm(q, axis=1)
        # the least scores are whole numbers; as doubles they are rounded down
        goal = np.nextafter(least.astype(float), -np.inf) - (0.5 + 1e-9 * q_len * max(1.0, longest))
        keep = np.flatnonzero(q_len * longest >= goal)  # else the whole block is too short
        if not len(keep):
            return None
        qr, xr = q[keep] @ turn, x @ turn
        rest = np.outer(
            np.linalg.norm(qr[:, head:], axis=1), np.linalg.norm(xr[:, head:], axis=1)
        )
        bound = qr[:, :head] @ xr[:, :head].T + rest
        a, b = np.nonzero(bound >= goal[keep][:, None])
        a = keep[a]
        other = q_ids[a] != x_ids[b]
        a, b = a[other], b[other]
        if not len(a):
            return None
        scores = np.empty(len(a), np.int64)
        small = float(np.abs(qi).max()) * float(np.abs(xi).max()) * dim < SAFE
        if small and len(a) * 8 > len(keep) * len(xi):
            scores[:] = (q @ x.T)[a, b].astype(np.int64)
        else:
            for s in range(0, len(a), 65_536):
                cut = slice(s, s + 65_536)
                scores[cut] = _products(qi[a[cut]], xi[b[cut]])
        good = scores >= least[a]
        a, b, scores = a[good], b[good], scores[good]
        best = _best(a, x_ids[b], scores, k)
        return pd.DataFrame(
            {"query_id": q_ids[a[best]], "vec_id": x_ids[b[best]], "score": scores[best]}
        )

    def run(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                x_ids = np.frombuffer(row.ids, np.int64)
                xi = np.frombuffer(row.vectors, np.int64).reshape(-1, dim)
                for q_ids, qi, least in asked:
                    hits = one(q_ids, qi, least, x_ids, xi, row.longest)
                    if hits is not None and len(hits):
                        yield hits

    return run


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def top_inner_products(
    vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "v"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` for every query.

    Both tables hold ``key`` and whole-number arrays ``vector``; see ``quantized``.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vector)
        norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        rows = df.filter(v.isNotNull() & F.col(key).isNotNull())
        return rows.select(F.col(key).cast("long").alias("id"), v.alias("v")).withColumn(
            "norm2", norm2
        )

    xs, qs = spool(clean(vectors), "vectors"), spool(clean(queries), "queries")
    both = xs.select("v").union(qs.select("v"))
    dim = both.agg(F.max(F.size("v"))).first()[0]
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    turn = directions(xs, dim)
    x_blocks = spool(_packed(xs, dim, BLOCK), "vector-blocks")
    q_blocks = spool(_packed(qs, dim, QUERY_BLOCK), "query-blocks")
    rounds = q_blocks.agg(F.max("block")).first()[0]
    if rounds is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    parts = []
    for start in range(0, rounds + 1, ROUND):
        asked = [
            (
                np.frombuffer(r["ids"], np.int64),
                np.frombuffer(r["vectors"], np.int64).reshape(-1, dim),
                np.full(r["n"], -LONGEST),
            )
            for r in q_blocks.filter(F.col("block").between(start, start + ROUND - 1)).collect()
        ]
        first = x_blocks.filter("block = 0").mapInPandas(_kernel(asked, turn, dim, k), HITS)
        seeds = spool(_ranked(first, k), "seeds")
        kth = {r["query_id"]: r["score"] for r in seeds.filter(F.col("rank") == k).collect()}
        for q_ids, _, least in asked:
            least[:] = [kth.get(int(q), -LONGEST) for q in q_ids]
        others = x_blocks.filter("block > 0").mapInPandas(_kernel(asked, turn, dim, k), HITS)
        hits = seeds.select("query_id", "vec_id", "score").union(others)
        parts.append(spool(_ranked(hits, k), "hits"))
    return reduce(DataFrame.union, parts)
