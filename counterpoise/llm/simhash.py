"""Near-duplicates by SimHash and covering locality-sensitive hashing.

A 64-bit fingerprint per whole text.  For radius r every bit position carries a non-zero vector
of r+1 bits, and each non-zero vector v of r+1 bits gives one mask: the positions whose vector
has an odd product with v.  Up to r differing positions leave some v with even products at all of
them, so the pair agrees on that mask: with 2^(r+1)-1 tables no pair within the radius is missed.

Equal fingerprints are merged first, so copies never meet as pairs.  Fingerprints that share a
masked value are compared inside one task if they are few; larger buckets are cut into chunks by
hash and compared chunk against chunk.  A comparison returns a spanning star of each cluster it
finds, never all of its pairs; components() puts the stars together.

Defined results: a NULL, empty or blank text has fingerprint zero and is linked like any other;
fewer words than a shingle make one shingle of what there is; rows that repeat an id are judged
each by its own text; rows with a NULL id get a fingerprint, and a component of NULL ids only is
NULL; the id of a component is its smallest document id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpoise.llm.common import small_batches
from counterpoise.llm.components import components
from counterpoise.session import spool

BITS = 64
SHINGLE = 3
RADIUS = 3
CHUNK = 512  # fingerprints of one bucket that are compared at once with another chunk
SEED = 42


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of ``size`` words, A-Z lower-cased; empty without words."""
    # bytes.lower() and bytes.split() know the ASCII letters and ASCII white space only
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    spans = zip(starts, ends[size - 1 :].tolist())
    return np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def majority(h: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; as a signed long."""
    if not len(h):
        return 0
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 65_536):  # a very long text is counted piece by piece
        block = h[at : at + 65_536].astype("<u8").view(np.uint8)
        bits = np.unpackbits(block.reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    on = np.packbits(votes * 2 > len(h), bitorder="little")
    return int(on.view("<i8")[0])


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Majority of the shingle hashes."""
    return majority(shingle_hashes(text, size))


def fingerprints(text: Column, size: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: fingerprint(t if isinstance(t, str) else None, size)).astype("int64")

    return run(text)


def masks(radius: int = RADIUS) -> list[int]:
    """The masks of a covering family, as signed longs."""
    if not 0 <= radius <= 5:
        raise ValueError("radius must be 0 to 5")
    width = (1 << (radius + 1)) - 1
    carried = [i % width + 1 for i in range(BITS)]
    out = []
    for v in range(1, width + 1):
        m = sum(1 << i for i, c in enumerate(carried) if bin(c & v).count("1") % 2)
        out.append(m - (1 << BITS) if m >> (BITS - 1) else m)
    return out


def star_links(group: np.ndarray, radius: int) -> np.ndarray:
    """Links (a, b) that join each cluster of the given signed fingerprints to its smallest."""
    f = np.unique(group)
    u = f.view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= radius
    left, out = np.ones(len(f), bool), []
    for i in range(len(f)):
        if not left[i]:
            continue
        left[i] = False
        edge = np.array([i])
        while len(edge):
            edge = np.nonzero(near[edge].any(axis=0) & left)[0]
            left[edge] = False
            out.append(np.column_stack([np.full(len(edge), f[i]), f[edge]]))
    return np.vstack(out) if out else np.zeros((0, 2), np.int64)


def fingerprint_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``prints(fp)`` that have the same components
    as all links of up to ``radius`` differing bits."""
    tables = [
        F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(m)).alias("masked"))
        for v, m in enumerate(masks(radius))
    ]
    keyed = prints.select("fp", F.explode(F.array(*tables)).alias("t")).select("t.*", "fp")
    sizes = keyed.groupBy("v", "masked").agg(
        F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")
    )
    sizes = spool(sizes.filter("n > 1"), "buckets")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = sizes.filter((F.col("n") == 2) & close).select("a", "b")

    more = sizes.filter("n > 2").select("v", "masked", F.ceil(F.col("n") / CHUNK).alias("chunks"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    met = keyed.join(more, ["v", "masked"]).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    met = met.withColumn("other", other).select(
        "v",
        "masked",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        "fp",
    )
    groups = met.groupBy("v", "masked", "i", "j").agg(F.collect_list("fp").alias("fps"))

    def compare(batches):
        for b in batches:
            found = [star_links(np.asarray(g, np.int64), radius) for g in b["fps"]]
            if found:
                links = np.vstack(found)
                yield pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})

    stars = groups.select("fps").mapInPandas(compare, "a long, b long")
    return pairs.union(stars)


def _grouped(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id, low, n, best): per fingerprint of ``prints(key, fp)`` its component.

    low and n: smallest key of the fingerprint and the rows that have both; best: the fingerprint
    of the component that holds its smallest key.
    """
    kinds = prints.groupBy("fp", "key").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("key").isNull(), "key", "n")).alias("low")
    per_print = spool(kinds.groupBy("fp").agg(first).select("fp", "low.key", "low.n"), "distinct")
    roots = components(fingerprint_links(per_print.select("fp"), radius))
    grouped = per_print.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    best = grouped.groupBy("root").agg(F.min(F.struct(F.col("key").isNull(), "key", "fp")).alias("b"))
    named = grouped.join(best, "root")
    return named.select(
        "fp", F.col("b.key").alias("component_id"), F.col("key").alias("low"), "n", F.col("b.fp").alias("best")
    )


def near_duplicates(
    docs: DataFrame, key="doc_id", text="text", size: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """(key, fp, component_id) for every row of ``docs``."""
    small_batches(docs.sparkSession)
    prints = spool(
        docs.select(F.col(key).alias("key"), fingerprints(F.col(text), size).alias("fp")), "prints"
    )
    named = spool(_grouped(prints, radius).select("fp", "component_id"), "named")
    return prints.join(named, "fp").select(F.col("key").alias(key), "fp", "component_id")


def one_per_group(
    docs: DataFrame, key="doc_id", text="text", size: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of every component one row stays, with the
    smallest key, a NULL key after all others.

    Each row is judged by its own text, so repeated and NULL keys are told apart by fingerprint;
    of rows that share both, the one with the smallest hash over all columns stays.  Columns are
    those of ``docs``, whatever their names.
    """
    small_batches(docs.sparkSession)
    made = docs.select(F.struct("*").alias("row"), fingerprints(F.col(text), size).alias("fp"))
    rows = spool(made, "printed")
    prints = rows.select(F.col("row")[key].alias("key"), "fp")
    kept = _grouped(prints, radius).filter("fp = best").select(F.col("fp").alias("best"), "low", "n")
    kept = spool(kept, "kept")
    same = (F.col("fp") == F.col("best")) & F.col("row")[key].eqNullSafe(F.col("low"))
    once = rows.join(kept.filter("n = 1"), same).select("row")
    order = F.xxhash64(F.to_json("row"))
    again = rows.join(kept.filter("n > 1"), same).groupBy("fp").agg(F.min_by("row", order).alias("row"))
    return once.union(again.select("row")).select("row.*")


def hex_print(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
