"""Source divergence audit: term probabilities of every source against the other sources of its
language and against the language, by a minimal-perfect-hash recount.

1. First pass: per task and language the documents that hold a term are counted, Spark adds the
   counts up, and terms in at least MIN_DOCUMENTS documents of a language are kept.
2. The kept terms are cut into shards of about SHARD_TERMS by hash.  Each shard becomes a minimal
   perfect hash (levels of bit maps; what collides goes to the next level) beside the terms
   themselves in slot order.
3. Second pass: shards are sent to all tasks, BROADCAST_BYTES at most at a time; with more of them
   the pass is repeated for the next ones.  Every term is hashed to its slot, checked against the
   term stored there, and counted in dense slots of its (language, source) group.  Tasks hold
   SLOT_BYTES of slots at most and emit what is not zero.
4. Probabilities are whole numbers.  A block of slots meets all sources of its language as a
   matrix, which gives the sums of differences of all pairs of sources, tile by tile.

Defined results: NULL text, language or source is the empty string; rows that repeat are separate
documents; a group without terms has the probability of count 0 throughout; a language without
kept terms gives pairs of value 0 and no terms; an empty table gives no rows.  Only the three
named columns are read, so clashing further columns do no harm.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterpoise.llm.common import small_batches
from counterpoise.session import spool

# Fixed value: a term is a run of ASCII letters and any non-ASCII characters.
TERM = rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCUMENTS = 30
TOP = 50
ONE = 1_000_000_000  # probabilities are 1 + floor of so many parts
ADDED = 5  # smoothing of the counts
SHARD_TERMS = 1 << 16
BROADCAST_BYTES = 64 << 20
SLOT_BYTES = 128 << 20
COUNTED_TERMS = 1 << 19  # terms of one task that are counted together
BLOCK_SLOTS = 1 << 10
TILE = 128  # sources of one tile

_FIND = re.compile(TERM).findall
_U = np.uint64
# Odd multipliers that spread bits.
_M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9)


def terms(text: str) -> list[bytes]:
    """Terms as UTF-8: bytes.lower() knows A-Z only, and no byte of another character is ASCII."""
    return _FIND(text.encode("utf-8", "replace").lower())


def language_seed(lang: str) -> int:
    return xxhash.xxh32_intdigest(lang.encode("utf-8", "replace"))


def names(found: list[bytes], lang: str) -> np.ndarray:
    """64-bit hashes of terms within a language."""
    seed, digest = language_seed(lang), xxhash.xxh64_intdigest
    return np.fromiter((digest(t, seed) for t in found), _U, len(found))


# ---------------------------------------------------------------- minimal perfect hashing


def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
    x = (h ^ _U(level * 0x632BE5AB + 1)) * _M1
    x ^= x >> _U(29)
    x *= _M2
    x ^= x >> _U(32)
    return (x % _U(size)).astype(np.int64)


class PerfectHash:
    """Distinct 64-bit names to slots 0 .. n-1, without gaps; other names go anywhere.

    ``levels`` are bit maps; a name belongs to the first level that has its bit.  ``ranks`` counts
    the bits before every 64-bit word.
    """

    def __init__(self, h: np.ndarray):
        self.levels, self.ranks, before = [], [], 0
        level = 0
        while len(h):
            size = 64 * max(1, -(-2 * len(h) // 64))
            at = _place(h, level, size)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            count = np.bitwise_count(words).astype(np.int64)
            self.levels.append(words)
            self.ranks.append(before + np.cumsum(count) - count)
            before += int(count.sum())
            h = h[~alone[at]]
            level += 1
            if level > 200:
                raise ValueError("names are not distinct")
        self.n = before

    def slots(self, h: np.ndarray) -> np.ndarray:
        """Slot per name, -1 where no level has its bit."""
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = _place(h[left], level, 64 * len(words))
            word, bit = at >> 6, (at & 63).astype(_U)
            here = (words[word] >> bit) & _U(1) == 1
            below = np.bitwise_count(words[word] & ((_U(1) << bit) - _U(1)))
            out[left[here]] = (ranks[word] + below)[here]
            left = left[~here]
            if not len(left):
                break
        return out


class Shard:
    """Some kept terms of one language: perfect hash, terms in slot order, number of the first."""

    def __init__(self, lang: str, found: list[bytes], first: int = 0):
        self.lang, self.first = lang, first
        h = names(found, lang)
        self.hash = PerfectHash(h)
        self.stored = np.empty(len(found), object)
        self.stored[self.hash.slots(h)] = found

    def find(self, found: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Slot of every term within the shard, -1 where the stored term is another one."""
        at = self.hash.slots(h)
        seen = np.flatnonzero(at >= 0)
        same = self.stored[at[seen]] == found[seen]
        at[seen[~same]] = -1
        return at


# ---------------------------------------------------------------- the two passes


def document_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, n): documents of each language that hold the term, for docs(lang, text)."""

    def count(batches):
        seen: defaultdict[str, Counter] = defaultdict(Counter)

        def flush():
            for lang, counts in seen.items():
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": pa.repeat(pa.scalar(lang, pa.string()), len(counts)),
                        "term": pa.array(list(counts), pa.string()),
                        "n": pa.array(list(counts.values()), pa.int64()),
                    }
                )
            seen.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[lang].update(set(terms(text)))
                if sum(map(len, seen.values())) > COUNTED_TERMS:
                    yield from flush()
        yield from flush()

    parts = docs.select("lang", "text").mapInArrow(count, "lang string, term string, n long")
    return parts.groupBy("lang", "term").agg(F.sum("n").alias("n"))


def built_shards(kept: DataFrame) -> DataFrame:
    """(lang, shard, n, bytes, terms): the kept terms of every shard in slot order."""
    sizes = kept.groupBy("lang").agg(F.ceil(F.count("*") / SHARD_TERMS).alias("shards"))
    turn = F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard")
    dealt = kept.join(F.broadcast(sizes), "lang").select("lang", turn, "term")  # one row a language

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        lang = rows["lang"].iloc[0]
        one = Shard(lang, [t.encode() for t in rows["term"]])
        held = sum(map(len, one.stored)) + 64 * len(one.stored)
        return pd.DataFrame(
            [{"lang": lang, "shard": rows["shard"].iloc[0], "n": len(rows), "bytes": held,
              "terms": [t.decode() for t in one.stored]}]
        )

    shape = "lang string, shard int, n long, bytes long, terms array<string>"
    return spool(dealt.groupBy("lang", "shard").applyInPandas(build, shape), "shards")


def recount(docs: DataFrame, shards: dict[str, list[Shard]]) -> DataFrame:
    """(lang, source, slot, n): how often each group of docs(lang, source, text) holds the terms of
    the given shards, which are sent to every task."""
    # by value, as all code of this package, so that executors need no copy of it
    sent = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(shards))

    def count(batches):
        by_lang = cloudpickle.loads(sent.value)
        held: dict[tuple[str, str], list[np.ndarray]] = {}
        waiting: defaultdict[tuple[str, str], Counter] = defaultdict(Counter)
        used = words = 0

        def enter():
            nonlocal used
            for group, tally in waiting.items():
                own = by_lang.get(group[0], [])
                if group not in held:
                    held[group] = [np.zeros(s.hash.n, np.int64) for s in own]
                    used += 8 * sum(s.hash.n for s in own)
                words = np.empty(len(tally), object)
                words[:] = list(tally)
                n = np.fromiter(tally.values(), np.int64, len(tally))
                h = names(list(tally), group[0])
                for slots, s in zip(held[group], own):
                    at = s.find(words, h)
                    slots[at[at >= 0]] += n[at >= 0]
            waiting.clear()

        def flush():
            nonlocal used
            for (lang, source), dense in held.items():
                for slots, s in zip(dense, by_lang.get(lang, [])):
                    some = np.flatnonzero(slots)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "lang": pa.repeat(pa.scalar(lang, pa.string()), len(some)),
                            "source": pa.repeat(pa.scalar(source, pa.string()), len(some)),
                            "slot": pa.array(some + s.first, pa.int64()),
                            "n": pa.array(slots[some], pa.int64()),
                        }
                    )
            held.clear()
            used = 0

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(3)]
            for lang, source, text in zip(*columns):
                if lang in by_lang:
                    found = terms(text)
                    waiting[lang, source].update(found)
                    words += len(found)
                if words > COUNTED_TERMS:
                    enter()
                    words = 0
                if used > SLOT_BYTES:
                    yield from flush()
        enter()
        yield from flush()

    shape = "lang string, source string, slot long, n long"
    parts = docs.select("lang", "source", "text").mapInArrow(count, shape)
    return parts.groupBy("lang", "source", "slot").agg(F.sum("n").alias("n"))


def _rounds(built: DataFrame):
    """The shards, put together in groups that may be sent at once."""
    firsts: dict[str, int] = {}
    group: dict[str, list[Shard]] = {}
    held = 0
    # the sizes of all shards first: one small row for SHARD_TERMS terms
    rows = built.select("lang", "shard", "n", "bytes").orderBy("lang", "shard").collect()
    for r in rows:
        if held and held + r["bytes"] > BROADCAST_BYTES:
            yield group
            group, held = {}, 0
        same = (F.col("lang") == r["lang"]) & (F.col("shard") == r["shard"])
        found = built.filter(same).select("terms").first()["terms"]
        one = Shard(r["lang"], [t.encode() for t in found], firsts.get(r["lang"], 0))
        firsts[r["lang"]] = one.first + r["n"]
        group.setdefault(r["lang"], []).append(one)
        held += r["bytes"]
    if group:
        yield group


def _slot_terms(built: DataFrame) -> DataFrame:
    """(lang, slot, term) as the shards number them."""
    before = Window.partitionBy("lang").orderBy("shard")  # one row for SHARD_TERMS terms
    starts = built.select("lang", "shard", (F.sum("n").over(before) - F.col("n")).alias("first"))
    rows = built.select("lang", "shard", F.posexplode("terms").alias("at", "term"))
    return rows.join(starts, ["lang", "shard"]).select(
        "lang", (F.col("first") + F.col("at")).alias("slot"), "term"
    )


# ---------------------------------------------------------------- probabilities


def probabilities(counts: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """``counts`` (keys, slot, n) with p, given totals (keys, total, kept)."""
    share = (
        f"1 + cast({ONE} as decimal(10,0)) * cast(n + {ADDED} as decimal(19,0)) "
        f"div cast(total + {ADDED} * kept as decimal(19,0))"
    )
    return counts.join(totals, keys).withColumn("p", F.expr(share))


def _pair_sums(tile: pd.DataFrame) -> pd.DataFrame:
    """Sums of |p - q| over one block of slots, for the sources of two tiles."""
    lang, a, b = tile["lang"].iloc[0], tile["a"].iloc[0], tile["b"].iloc[0]
    width = int(tile["width"].iloc[0])

    def side(number: int):
        own = tile[tile["own"] == number]
        sources = own["source"].drop_duplicates().tolist()
        at = {s: i for i, s in enumerate(sources)}
        rest = own.drop_duplicates("source")
        p = np.repeat(rest["p0"].to_numpy(np.int64)[:, None], width, axis=1)
        has = own[own["at"] >= 0]
        p[has["source"].map(at).to_numpy(np.int64), has["at"].to_numpy(np.int64)] = has["p"]
        return sources, p

    first, p = side(a)
    second, q = (first, p) if a == b else side(b)
    out = []
    for s, row in zip(first, p):
        d = np.abs(q - row[None, :]).sum(axis=1)
        out.append(pd.DataFrame({"lang": lang, "source": s, "item": second, "value": d}))
        if a != b:
            out.append(pd.DataFrame({"lang": lang, "source": second, "item": s, "value": d}))
    return pd.concat(out, ignore_index=True)


def pair_values(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language.

    shares(lang, source, slot, p) has the terms a group holds; groups(lang, source, kept, p0) all
    groups and the probability of a term that they do not hold.
    """
    order = Window.partitionBy("lang").orderBy("source")  # names of groups only
    named = groups.withColumn("own", F.floor((F.row_number().over(order) - 1) / TILE).cast("int"))
    tiles = named.groupBy("lang").agg(F.max("own").alias("last"))
    named = spool(named.join(F.broadcast(tiles), "lang"), "groups")
    block = F.floor(F.col("slot") / BLOCK_SLOTS).cast("int")
    # every group is in every block, once without a slot
    blocks = F.sequence(F.lit(0), F.floor((F.col("kept") - 1) / BLOCK_SLOTS).cast("int"))
    empty = named.filter("kept > 0").select(
        "lang", "source", "own", "last", "kept", "p0", F.explode(blocks).alias("block"),
        F.lit(-1).alias("at"), F.lit(0).cast("long").alias("p"),
    )
    held = shares.join(named, ["lang", "source"]).select(
        "lang", "source", "own", "last", "kept", "p0", block.alias("block"),
        (F.col("slot") % BLOCK_SLOTS).cast("int").alias("at"), "p",
    )
    rows = empty.unionByName(held).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    rows = rows.select(
        "lang", "block", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
        "own", "source", "at", "p", "p0",
        F.least(F.lit(BLOCK_SLOTS), F.col("kept") - F.col("block") * BLOCK_SLOTS).alias("width"),
    )
    sums = rows.groupBy("lang", "block", "a", "b").applyInPandas(
        _pair_sums, "lang string, source string, item string, value long"
    )
    total = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    none = named.filter("kept = 0").select("lang", "source")
    pairs = none.join(none.select("lang", F.col("source").alias("item")), "lang")
    both = total.unionByName(pairs.withColumn("value", F.lit(0).cast("long")))
    return both.filter("source <> item")


def divergence(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
    least: int = MIN_DOCUMENTS, top: int = TOP,
) -> DataFrame:
    """(lang, source, part, item, value, rank): see the module."""
    small_batches(docs.sparkSession)

    def filled(c: str, name: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)

    rows = docs.select(filled(lang, "lang"), filled(source, "source"), filled(text, "text"))
    kept = spool(document_counts(rows).filter(F.col("n") >= least).select("lang", "term"), "kept")
    built = built_shards(kept)
    counts = None
    for shards in _rounds(built):
        one = spool(recount(rows, shards), "recount")
        counts = one if counts is None else counts.unionByName(one)
    if counts is None:
        shape = "lang string, source string, slot long, n long"
        counts = docs.sparkSession.createDataFrame([], shape)

    sizes = built.groupBy("lang").agg(F.sum("n").alias("kept"))
    every = rows.select("lang", "source").distinct().join(sizes, "lang", "left").fillna(0, ["kept"])
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = every.join(totals, ["lang", "source"], "left").fillna(0, ["total"])
    nothing = F.expr(
        f"CASE WHEN kept > 0 THEN 1 + cast({ONE} as decimal(10,0)) * {ADDED} "
        f"div cast(total + {ADDED} * kept as decimal(19,0)) ELSE 0 END"
    )
    groups = spool(groups.withColumn("p0", nothing), "totals")
    shares = probabilities(counts, groups.drop("p0"), ["lang", "source"])
    shares = spool(shares.select("lang", "source", "slot", "p"), "shares")

    whole = counts.groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    by_lang = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("kept").alias("kept"))
    q = probabilities(whole, by_lang, ["lang"]).select("lang", "slot", F.col("p").alias("q"))
    named = q.join(_slot_terms(built), ["lang", "slot"])
    over = shares.join(named, ["lang", "slot"]).filter("p > q")
    by_term = over.select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = by_term.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    pairs = pair_values(shares, groups.drop("total")).withColumn("rank", F.row_number().over(order))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(
        ranked.withColumn("part", F.lit("term")).select(columns)
    )
