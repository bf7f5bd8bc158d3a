"""Repeated passages across documents, found by recompression.

A window of 13 words is removed from a document if it also starts in a document with a smaller id.

1. Words are named by 64-bit hashes.  Two rounds of recompression follow: a run of equal symbols
   gets a name made of symbol and length; then every symbol is a left or a right one by a coin
   from its name, and each left symbol followed by a right one becomes a pair with a name of its
   own.  Names depend on content alone, so equal passages get equal symbols everywhere, except
   near their ends, where a neighbour decides.  The stretch of words that decides a symbol is
   kept with it: in every window that holds the stretch, the symbol is the same.
2. Each window is represented by one of the highest symbols that it decides, the one with the
   smallest hash (a window that decides none represents itself).  Equal windows have equal
   representatives, and neighbouring windows mostly share theirs, so far fewer representatives
   than windows are sent out.  Representatives seen in two documents reveal possible repeats.
3. Only windows of such representatives are then named in full, by 128 bits over their words,
   which verifies the repeat; the smallest document of each window is its first.

Representatives are dealt out by name once and stay there for both steps that need them; rows of
one name are streamed and may spill, none are gathered.  Texts are shuffled by id once.

Defined results: a NULL text has no words; documents under 13 words lose none; documents with a
NULL id lose none and count as first for none; rows that repeat an id are never repeats of each
other, and each is judged by its own text; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from counterpoise.llm.common import small_batches

WINDOW = 13
ROUNDS = 2
MAY_GO, MAY_BE_FIRST = 1, 2

_U = np.uint64
# Odd multipliers that spread bits, and two bases for window names.
_M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
_BASES = (_U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F))


def _mix(a: np.ndarray, b) -> np.ndarray:
    """Name of two names in order."""
    b = np.atleast_1d(b)  # arrays wrap around silently
    x = (a ^ (a >> _U(32))) * _M1 + (b ^ (b >> _U(29))) * _M2
    x ^= x >> _U(31)
    x *= _M1
    return x ^ (x >> _U(33))


class Words:
    """The words of several texts in one row, as names, with the texts' limits."""

    def __init__(self, texts):
        split = [t.encode("utf-8", "replace").split() if isinstance(t, str) else [] for t in texts]
        self.sizes = np.array([len(w) for w in split], np.int64)
        self.ends = np.cumsum(self.sizes)
        n = int(self.sizes.sum())
        digest = xxhash.xxh64_intdigest
        named = [np.fromiter(map(digest, ws), _U, len(ws)) for ws in split]
        self.names = np.concatenate([*named, np.zeros(0, _U)])
        self.text = np.repeat(np.arange(len(split)), self.sizes)
        start = np.arange(max(0, n - WINDOW + 1))
        self.starts = start[self.text[start] == self.text[start + WINDOW - 1]] if n else start
        self.split = split

    def hashes(self, a: np.ndarray, b: np.ndarray, base: np.uint64) -> np.ndarray:
        """Content hashes of the stretches [a, b)."""
        n = len(self.names)
        power = np.ones(n + 1, _U)
        power[1:] = np.cumprod(np.full(n, base, _U))
        back = np.ones(n + 1, _U)
        back[1:] = np.cumprod(np.full(n, _U(pow(int(base), -1, 1 << 64)), _U))
        total = np.zeros(n + 1, _U)
        total[1:] = np.cumsum(self.names * power[:-1])
        h = (total[b] - total[a]) * back[a]
        return h ^ (h >> _U(32))


def _rounds(w: Words):
    """Per round: names of the symbols and the stretches [a, b) that decide them.

    A stretch that would reach beyond its text ends one word outside of it.
    """
    first = w.ends - w.sizes
    before, behind = first[w.text] - 1, w.ends[w.text] + 1
    name, text = w.names, w.text
    a = np.arange(len(name))
    b = a + 1
    for r in range(ROUNDS):
        if not len(name):
            return
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(name)) - 1
        size = (tail - head + 1).astype(_U)
        run = np.where(size > 1, _mix(name[head], size), name[head])
        same = text[head][1:] == text[head][:-1]
        left, right = before[head].copy(), behind[head].copy()
        left[1:][same] = a[head[1:] - 1][same]
        right[:-1][same] = b[tail[:-1] + 1][same]
        kind, before, behind = text[head], before[head], behind[head]

        coin = _mix(run, _U(r + 1)) >> _U(63)
        pair = (coin[:-1] == 0) & (coin[1:] == 1) & same
        opens, closes = np.append(pair, False), np.append(False, pair)
        following = np.append(run[1:], run[-1:])
        made = np.where(opens, _mix(run, following), run)
        # a left symbol looks at the next one, an unpaired right symbol at the one before
        new_a, new_b = left.copy(), right.copy()
        new_b[coin == 0] = behind[coin == 0]
        ahead = np.flatnonzero((coin[:-1] == 0) & same)
        new_b[ahead] = right[ahead + 1]
        alone = np.flatnonzero((coin == 1) & ~closes)
        new_a[alone] = before[alone]
        back = alone[alone > 0]
        back = back[same[back - 1]]
        new_a[back] = left[back - 1]
        keep = ~closes
        name, text, a, b = made[keep], kind[keep], new_a[keep], new_b[keep]
        before, behind = before[keep], behind[keep]
        yield name, a, b


def representatives(w: Words) -> np.ndarray:
    """For every window in ``w.starts`` the content hash of its representative's stretch."""
    i = w.starts
    out_a, out_b = i.copy(), i + WINDOW
    open_ = np.ones(len(i), bool)
    for name, a, b in reversed(list(_rounds(w))):
        at = i[open_]
        n = len(w.names)
        lo = np.cumsum(np.bincount(a + 1, minlength=n + 2))[at]  # symbols with a < at
        hi = np.cumsum(np.bincount(b, minlength=n + 2))[at + WINDOW]  # b <= at + WINDOW
        order = _mix(name, _M2)
        best = np.full(len(at), -1)
        least = np.full(len(at), np.iinfo(np.uint64).max, _U)
        for j in range(int((hi - lo).max(initial=0))):
            k = np.flatnonzero(lo + j < hi)
            x = order[lo[k] + j]
            less = x < least[k]
            least[k[less]] = x[less]
            best[k[less]] = lo[k[less]] + j
        found = best >= 0
        where = np.flatnonzero(open_)[found]
        out_a[where], out_b[where] = a[best[found]], b[best[found]]
        open_[where] = False
    return w.hashes(out_a, out_b, _BASES[0]).view(np.int64)


def _anchors(batches):
    for batch in batches:
        w = Words(batch["text"])
        if not len(w.starts):
            continue
        name, text = representatives(w), w.text[w.starts]
        first = np.ones(len(name), bool)
        first[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
        key = batch["key"].to_numpy()[text[first]]
        yield pd.DataFrame({"name": name[first], "key": key})


def _windows(batches):
    """The windows whose representative is shared, a row for each stretch of one representative."""
    for batch in batches:
        w = Words(batch["text"])
        if not len(w.starts):
            continue
        name, text = representatives(w), w.text[w.starts]
        flag = np.zeros(len(name), np.int8)
        limits = np.searchsorted(text, np.arange(len(batch) + 1))
        for t, (names, flags) in enumerate(zip(batch["names"], batch["flags"])):
            names, flags = np.asarray(names, np.int64), np.asarray(flags, np.int8)
            order = np.argsort(names)
            names, cuts = np.unique(names[order], return_index=True)
            flags = np.bitwise_or.reduceat(flags[order], cuts)
            own = name[limits[t] : limits[t + 1]]
            at = np.minimum(np.searchsorted(names, own), len(names) - 1)
            flag[limits[t] : limits[t + 1]] = np.where(names[at] == own, flags[at], 0)
        some = np.flatnonzero(flag)
        if not len(some):
            continue
        start, text, name, flag = w.starts[some], text[some], name[some], flag[some]
        x = w.hashes(start, start + WINDOW, _BASES[1]).view(np.int64)
        new = np.ones(len(some), bool)
        new[1:] = (name[1:] != name[:-1]) | (start[1:] != start[:-1] + 1) | (text[1:] != text[:-1])
        head = np.flatnonzero(new)
        first = (w.ends - w.sizes)[text[head]]
        yield pd.DataFrame(
            {
                "name": name[head],
                "key": batch["key"].to_numpy()[text[head]],
                "body": batch["body"].to_numpy()[text[head]],
                "pos": (start[head] - first).astype(np.int32),
                "may_go": (flag[head] & MAY_GO) > 0,
                "xs": np.split(x, head[1:]),
            }
        )


def covered(size: int, positions) -> np.ndarray:
    """True for every word inside a window that starts at one of ``positions``."""
    steps = np.zeros(size + 1, np.int64)
    at = np.unique(np.asarray(positions, np.int64))
    np.add.at(steps, at, 1)
    np.add.at(steps, at + WINDOW, -1)
    return np.cumsum(steps)[:size] > 0


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(key, body, pos): windows to remove from ``docs(key, text, body)``."""
    anchors = docs.select("key", "text").mapInPandas(_anchors, "name long, key long")
    # dealt once, read for the limits and for the hits: with the filters that the joins ask for,
    # both readings are the same exchange
    anchors = anchors.filter("name is not null and key is not null").repartition("name")
    limits = anchors.groupBy("name").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    flag = F.when(F.col("key") > F.col("lo"), MAY_GO).otherwise(0) + F.when(
        F.col("key") < F.col("hi"), MAY_BE_FIRST
    ).otherwise(0)
    hits = anchors.join(limits.filter("lo < hi"), "name")
    hits = hits.select("key", "name", flag.cast("tinyint").alias("flag"))
    per_doc = hits.groupBy("key").agg(F.collect_list(F.struct("name", "flag")).alias("h"))
    per_doc = per_doc.select("key", F.col("h.name").alias("names"), F.col("h.flag").alias("flags"))
    stretches = docs.join(per_doc, "key").mapInPandas(
        _windows, "name long, key long, body long, pos int, may_go boolean, xs array<long>"
    )
    # a window is its representative's name and its own: 128 bits over its words
    windows = stretches.repartition("name").select(
        "name", "key", "body", "pos", "may_go", F.posexplode("xs").alias("i", "x")
    )
    lo = F.min("key").over(Window.partitionBy("name", "x"))
    late = windows.withColumn("lo", lo).filter("may_go and key > lo")
    return late.select("key", "body", (F.col("pos") + F.col("i")).alias("pos"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept): ``kept`` is the text left, words joined by a blank."""
    small_batches(docs.sparkSession)
    text_col = F.col(text)
    rows = docs.select(
        F.col(key).cast("long").alias("key"), text_col.alias("text"), F.xxhash64(text_col).alias("body")
    )
    named, unnamed = rows.filter("key is not null"), rows.filter("key is null")
    late = repeated_windows(named).groupBy("key").agg(
        F.collect_list(F.struct("body", "pos")).alias("late")
    )
    joined = named.join(late, "key", "left").select(
        "key",
        "text",
        F.transform(
            F.filter("late", lambda e: e["body"] == F.col("body")), lambda e: e["pos"]
        ).alias("at"),
    )
    every = joined.union(unnamed.select("key", "text", F.lit(None).cast("array<int>").alias("at")))

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def cut(text: pd.Series, at: pd.Series) -> pd.DataFrame:
        out = []
        for t, p in zip(text, at):
            words = t.encode("utf-8", "replace").split() if isinstance(t, str) else []
            if p is not None and len(p):
                gone = covered(len(words), p)
                left = [w for w, g in zip(words, gone.tolist()) if not g]
            else:
                left = words
            out.append((len(words), len(words) - len(left), b" ".join(left).decode("utf-8")))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    return every.select(F.col("key").alias(key), cut("text", "at").alias("c")).select(key, "c.*")
