"""Language-model scoring with an Elias-Fano n-gram trie, built and asked shard by shard.

1. Documents become slabs of about SLAB tokens: word ids of the slab, the sorted hashes of its
   words, and how often the training documents hold them.  Slabs are written once, bucketed by
   slab, and never moved again.
2. Round 1: the words of all slabs go to shards by hash.  A shard adds the counts up, numbers the
   words it has seen in training (frequent ones first), and answers every slab.
3. Rounds 2 and 3: a slab sends its distinct pairs and triples with their training counts to
   shards.  A shard adds them up, keeps the n-grams of at least MIN_COUNT occurrences in an
   Elias-Fano trie (see ``eliasfano``) beside one byte each for the smoothed probability, looks
   all n-grams it was asked for up in the trie, and answers every slab.  A triple is sent only if
   both of its pairs occur often enough for the triple to be kept.
4. The slab adds the probabilities up per document.

P(w | h) = (n(hw) + K * P(w | shorter h)) / (n(h) + K), down to the add-0.1 word probabilities;
an n-gram that is not kept has n = 0, so the mass of dropped triples is not given to others.
Probabilities that are kept are quantised to 256 values per shard.

A shard holds the n-grams whose first word has one hash.  N-grams of a frequent first word are
split over as many shards as its count asks for.  Slabs send distinct n-grams only, so a line that
repeats within a slab is sent once.  The tables that make up the model are written to the shared
scratch area (``Scored.levels``); a level is a byte string that is read in place.

Defined results: NULL and empty texts are one end token; a document without a training flag of
true is not learned from; rows with NULL or repeated keys are scored each by itself; without
training documents every token has probability 1 at the base and no n-gram is known; an empty
table gives no rows.  The result has the named columns only.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpoise.llm.common import small_batches
from counterpoise.llm.eliasfano import Trie, quantised
from counterpoise.session import bucketed, spool

ORDER = 3
SLAB = 1 << 21  # tokens
SHARD = 1 << 21  # tokens of the corpus for each shard
SPLIT = 1 << 18  # occurrences of a first word that one shard takes
MIN_COUNT = {2: 1, 3: 2}
PRIOR = {2: 20.0, 3: 5.0}  # K, in occurrences
ADDED = 0.1
UNKNOWN, END, FIRST = 0, 1, 2  # word numbers
SEED = 11

_U = np.uint64
_LEVEL = -1
ROWS = "slab long, round int, shard int, data binary"


# ---------------------------------------------------------------- packing


def packed(*arrays: np.ndarray, ascending: tuple[int, ...] = ()) -> bytes:
    """Arrays of whole numbers or doubles; those numbered in ``ascending`` as differences."""
    out, head = [], [len(arrays)]
    for i, a in enumerate(arrays):
        if a.dtype.kind == "f":
            a, kind = np.ascontiguousarray(a, np.float32), 4
        else:
            a = a.astype(_U)
            if i in ascending and len(a):
                a = np.concatenate([a[:1], np.diff(a)])
            top = int(a.max(initial=0))
            kind = next(k for k in (1, 2, 4, 8) if top < 1 << (8 * k))
            a = a.astype(f"<u{kind}")
            kind = -kind if i in ascending else kind + 10
        head += [kind, len(a)]
        width = a.dtype.itemsize
        out.append(a.view(np.uint8).reshape(-1, width).T.tobytes() if len(a) else b"")
    return zstandard.compress(np.array(head, np.int64).tobytes() + b"".join(out), 1)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2).tolist()
    at, out = 8 + 16 * n, []
    for kind, size in head:
        width = 4 if kind == 4 else abs(kind) if kind < 0 else kind - 10
        planes = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size)
        a = np.ascontiguousarray(planes.T).reshape(-1)
        at += size * width
        if kind == 4:
            out.append(a.view("<f4").astype(float))
        else:
            a = a.view(f"<u{width}").astype(_U)
            out.append(np.cumsum(a, dtype=_U) if kind < 0 else a)
    return out


# ---------------------------------------------------------------- slabs


def _slab(keys, held, words) -> dict:
    """One slab of documents: token 0 is the end, i + 1 the i-th word in the order of hashes."""
    number: defaultdict = defaultdict(count().__next__)
    local = [np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)) for ws in words]
    digest = xxhash.xxh64_intdigest
    names = np.fromiter((digest(w, SEED) for w in number), _U, len(number))
    found, place = np.unique(names, return_inverse=True)
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    tokens = np.zeros(int(sizes.sum()), np.int64)
    inside = np.ones(len(tokens), bool)
    inside[np.cumsum(sizes) - 1] = False
    tokens[inside] = place[np.concatenate(local)] + 1 if len(number) else 0
    out = np.array(held, bool)
    learned = np.repeat(~out, sizes)
    counts = np.bincount(tokens[learned], minlength=len(found) + 1)
    return {
        "keys": keys,
        "held": out.tobytes(),
        "sizes": packed(sizes),
        "tokens": packed(tokens),
        "names": found.tobytes(),
        "counts": packed(counts[1:]),
        "n_tokens": len(tokens),
        "n_learned": int(learned.sum()),
        "docs_learned": int((~out).sum()),
    }


def slabs(docs: DataFrame) -> DataFrame:
    """Slabs of docs(key string, text, held), bucketed by slab."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 32
        nth = count()

        def emit():
            return pd.DataFrame([{"slab": first + next(nth), **_slab(keys, held, words)}])

        keys, held, words, size = [], [], [], 0
        for batch in batches:
            for k, t, h in zip(batch["key"], batch["text"], batch["held"]):
                ws = t.encode("utf-8", "replace").lower().split() if isinstance(t, str) else []
                keys.append(k if isinstance(k, str) else None)
                held.append(bool(h))
                words.append(ws)
                size += len(ws) + 1
                if size >= SLAB:
                    yield emit()
                    keys, held, words, size = [], [], [], 0
        if keys:
            yield emit()

    shape = (
        "slab long, keys array<string>, held binary, sizes binary, tokens binary, names binary, "
        "counts binary, n_tokens long, n_learned long, docs_learned long"
    )
    return bucketed(docs.mapInPandas(run, shape), "slab", 4 * docs.rdd.getNumPartitions())


# ---------------------------------------------------------------- what a slab knows


@dataclass(frozen=True)
class Known:
    """Facts about the whole corpus: shards, training tokens, distinct ones, training documents."""

    shards: int
    tokens: int
    kinds: int = 0
    docs: int = 0

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + ADDED) / (self.tokens + ADDED * (self.kinds + 1)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(29))


def _turns(shard: np.ndarray):
    """(order, shards, starts): rows by shard in their present order, and where each begins."""
    order = np.argsort(shard, kind="stable")
    dealt = shard[order]
    start = np.flatnonzero(np.append(True, dealt[1:] != dealt[:-1])) if len(dealt) else dealt
    return order, dealt[start], np.append(start, len(dealt))


class Slab:
    """Tokens of a slab with the answers of the rounds so far, one value per token."""

    def __init__(self, row, answers: pd.DataFrame, known: Known):
        self.known = known
        self.sizes = unpacked(row.sizes)[0].astype(np.int64)
        self.local = unpacked(row.tokens)[0].astype(np.int64)
        self.held = np.frombuffer(row.held, bool)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.at = np.arange(len(self.local)) - np.repeat(self.first, self.sizes)
        self.learned = np.repeat(~self.held, self.sizes)
        by_round: dict = {r: g.sort_values("shard") for r, g in answers.groupby("round")}
        ids, n = [np.array([END], _U)], [np.array([known.docs], _U)]
        for data in by_round[1]["data"] if 1 in by_round else ():
            one, many = unpacked(data)
            ids.append(one)
            n.append(many)
        ids, n = np.concatenate(ids), np.concatenate(n).astype(np.int64)
        self.ids, self.n = ids[self.local], n[self.local]
        self.base = known.base(self.n.astype(float))
        self.logp, self.context = self.base, np.zeros(len(self.n), np.int64)
        self.context[1:] = np.where(self.at[1:] > 0, self.n[:-1], 0)
        self.words, self.firsts = self.n, self.n
        # place of the shorter n-gram before each token, and the lists these places mean
        self.before = np.zeros(len(self.ids), np.int64)
        self.before[1:] = self.ids[:-1].astype(np.int64)
        self.lists: np.ndarray | None = None
        for k in range(2, ORDER + 1):
            self._grams(k)
            if k not in by_round:
                break
            self._answered(k, by_round[k]["data"])

    def _grams(self, k: int) -> None:
        """The distinct n-grams of k known words that may be kept."""
        ok = (self.at >= k - 1) & (self.ids != UNKNOWN) & (self.context >= MIN_COUNT[k])
        ok[1:] &= self.ids[:-1] != UNKNOWN
        if k > 2:
            ok &= self.n_grams >= MIN_COUNT[k]
        self.spots = np.flatnonzero(ok)
        key = (self.before[self.spots].astype(_U) << _U(32)) | self.ids[self.spots]
        self.keys, where, self.inverse = np.unique(key, return_index=True, return_inverse=True)
        last = (self.keys & _U(0xFFFFFFFF)).astype(np.int64)
        head = (self.keys >> _U(32)).astype(np.int64)
        before = head[:, None] if self.lists is None else self.lists[head]
        self.rows = np.concatenate([before, last[:, None]], axis=1)
        spot = self.spots[where]
        self.of_context, self.of_shorter = self.context[spot], self.logp[spot]
        self.many = np.bincount(self.inverse[self.learned[self.spots]], minlength=len(self.keys))
        # n-grams of a frequent first word are dealt to several shards
        first = self.rows[:, 0].astype(_U)
        count_of_first = self.n[spot - (k - 1)]
        parts = (1 + count_of_first // SPLIT).astype(_U)
        rest = _mix(_mix(self.rows[:, 1].astype(_U)) + self.rows[:, -1].astype(_U))
        shard = (_mix(first + _U(k)) + (rest >> _U(20)) % parts) % _U(self.known.shards)
        self.turns = _turns(shard.astype(np.int64))

    def messages(self, slab: int, k: int) -> pd.DataFrame:
        order, shards, starts = self.turns
        out = []
        for s, a, b in zip(shards.tolist(), starts[:-1], starts[1:]):
            own = order[a:b]
            columns = [self.rows[own, j] for j in range(k)]
            data = packed(
                *columns, self.many[own], self.of_context[own], self.of_shorter[own], ascending=(0,)
            )
            out.append((slab, k, s, data))
        return pd.DataFrame(out, columns=["slab", "round", "shard", "data"])

    def _answered(self, k: int, answers) -> None:
        """Takes the answers in: counts and probabilities of the n-grams ending at each token."""
        n, found, logp = [], [], []
        for data in answers:
            many, code, book = unpacked(data)
            n.append(many)
            found.append(code > 0)
            logp.append(np.append(0.0, book)[code.astype(np.int64)])
        order = self.turns[0]
        per_gram = np.zeros((3, len(order)))
        for i, part in enumerate((n, found, logp)):
            if part:
                per_gram[i, order] = np.concatenate(part)
        prior = PRIOR[k]
        after = self.logp + np.log10(prior / (self.context + prior))
        hit = per_gram[1, self.inverse] > 0
        spots = self.spots[hit]
        after[spots] = per_gram[2, self.inverse[hit]]
        self.logp = after
        self.n_grams = np.zeros(len(self.n), np.int64)
        self.n_grams[self.spots] = per_gram[0, self.inverse]
        self.context = np.zeros(len(self.n), np.int64)
        self.context[1:] = np.where(self.at[1:] > 0, self.n_grams[:-1], 0)
        self.before = np.zeros(len(self.n), np.int64)
        place = np.zeros(len(self.n), np.int64)
        place[self.spots] = self.inverse
        self.before[1:] = place[:-1]
        self.lists = self.rows

    def scores(self, row) -> pd.DataFrame:
        def per_doc(x):
            return np.add.reduceat(x, self.first) if len(x) else x

        return pd.DataFrame(
            {
                "key": list(row.keys),
                "held_out": self.held,
                "n_tokens": self.sizes,
                "n_known": per_doc((self.n > 0).astype(np.int64)),
                "base_score": per_doc(self.base),
                "score": per_doc(self.logp),
            }
        )


# ---------------------------------------------------------------- what a shard does


def word_messages(rows: DataFrame, shards: int) -> DataFrame:
    """The words of every slab by shard: ranges of hashes."""

    def run(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                names, counts = np.frombuffer(r.names, _U), unpacked(r.counts)[0]
                shard = ((names >> _U(32)) * _U(shards)) >> _U(32)
                _, own, starts = _turns(shard.astype(np.int64))
                out = [
                    (r.slab, 1, s, packed(names[a:b], counts[a:b], ascending=(0,)))
                    for s, a, b in zip(own.tolist(), starts[:-1], starts[1:])
                ]
                yield pd.DataFrame(out, columns=["slab", "round", "shard", "data"])

    return rows.select("slab", "names", "counts").mapInPandas(run, ROWS)


def _word_level(shards: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        parts = [unpacked(d) for d in rows["data"]]
        names, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        total = np.bincount(where, np.concatenate([p[1] for p in parts]), len(names)).astype(np.int64)
        known = np.flatnonzero(total)
        ids = np.full(len(names), UNKNOWN, np.int64)
        frequent_first = known[np.argsort(-total[known], kind="stable")]
        ids[frequent_first] = np.arange(len(known)) * shards + shard + FIRST
        if ids.max(initial=0) >> 32:
            raise ValueError("more than 2^32 distinct words")
        level = packed(names[known], ids[known], total[known], ascending=(0,))
        out = [(_LEVEL, 1, shard, level, len(known))]
        at = 0
        for slab, p in zip(rows["slab"], parts):
            own = where[at : at + len(p[0])]
            out.append((slab, 1, shard, packed(ids[own], total[own]), 0))
            at += len(own)
        return pd.DataFrame(out, columns=["slab", "round", "shard", "data", "kinds"])

    return run


def _gram_level(k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        parts = [unpacked(d) for d in rows["data"]]
        columns = [np.concatenate([p[j] for p in parts]).astype(np.int64) for j in range(k)]
        order = np.lexsort(columns[::-1])
        new = np.ones(len(order), bool)
        new[1:] = False
        for c in columns:
            new[1:] |= c[order[1:]] != c[order[:-1]]
        where = np.empty(len(order), np.int64)
        where[order] = np.cumsum(new) - 1
        some = order[new]  # one of the rows of each n-gram: context and shorter are the same in all
        grams = np.column_stack([c[some] for c in columns])
        many = np.bincount(where, np.concatenate([p[k] for p in parts]), len(some)).astype(np.int64)
        context, shorter = (np.concatenate([p[k + j] for p in parts])[some] for j in (1, 2))
        kept = many >= MIN_COUNT[k]
        prior = PRIOR[k]
        p = (many[kept] + prior * 10.0 ** shorter[kept]) / (context[kept].astype(float) + prior)
        codes, book = quantised(np.log10(p))
        data = Trie.build(grams[kept])
        at = Trie(data).find(grams)
        code = np.zeros(len(grams), np.int64)
        code[at >= 0] = codes[at[at >= 0]].astype(np.int64) + 1
        level = packed(codes.astype(np.int64), book)
        level = np.int64(len(data)).tobytes() + data + level
        out = [(_LEVEL, k, shard, level)]
        at = 0
        for slab, part in zip(rows["slab"], parts):
            own = where[at : at + len(part[0])]
            out.append((slab, k, shard, packed(many[own], code[own], book)))
            at += len(own)
        return pd.DataFrame(out, columns=["slab", "round", "shard", "data"])

    return run


def open_level(data: bytes) -> tuple[Trie, np.ndarray, np.ndarray]:
    """Trie, codes and codebook of a stored level; the trie is read where it lies."""
    size = int(np.frombuffer(data, np.int64, 1)[0])
    codes, book = unpacked(data[8 + size :])
    return Trie(memoryview(data)[8 : 8 + size]), codes, book


@dataclass(frozen=True)
class Scored:
    """scores(key, held_out, n_tokens, n_known, train_tokens, base_score, score); levels(round,
    shard, data): the model, words in round 1, see ``open_level`` for the others."""

    scores: DataFrame
    levels: DataFrame


def train_and_score(
    docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text"
) -> Scored:
    """Scores every row of ``docs`` with the model of the rows where ``learn`` is true."""
    spark = small_batches(docs.sparkSession)
    key_type = docs.schema[key].dataType
    held = ~F.coalesce(learn, F.lit(False))
    table = slabs(
        docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), held.alias("held"))
    )
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_learned", "docs_learned")]
    size = table.agg(*sums).first()
    shape = "key string, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    if size["n_tokens"] is None:
        none = spark.createDataFrame([], shape)
        return Scored(_named(none, key, key_type, 0), spark.createDataFrame([], ROWS).drop("slab"))
    known = Known(max(1, -(-size["n_tokens"] // SHARD)), size["n_learned"], 0, size["docs_learned"])

    asked = word_messages(table, known.shards)
    found = asked.groupBy("shard").applyInPandas(_word_level(known.shards), ROWS + ", kinds long")
    found = spool(found, "words")
    kinds = found.agg(F.sum("kinds")).first()[0] or 0
    known = Known(known.shards, known.tokens, kinds + (known.docs > 0), known.docs)
    rounds = [found.drop("kinds")]

    def visit(columns, shape, of):
        def run(slab: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
            row = next(slab.itertuples(index=False))
            return of(row, Slab(row, answers, known))

        answers = rounds[0]
        for r in rounds[1:]:
            answers = answers.union(r)
        answers = answers.filter(F.col("slab") >= 0)
        left = table.select("slab", "held", "sizes", "tokens", *columns).groupBy("slab")
        return left.cogroup(answers.groupBy("slab")).applyInPandas(run, shape)

    for k in range(2, ORDER + 1):
        asked = visit([], ROWS, lambda row, s, k=k: s.messages(row.slab, k))
        rounds.append(spool(asked.groupBy("shard").applyInPandas(_gram_level(k), ROWS), "grams"))
    scores = visit(["keys"], shape, lambda row, s: s.scores(row))
    levels = rounds[0]
    for r in rounds[1:]:
        levels = levels.union(r)
    levels = levels.filter(F.col("slab") == _LEVEL).select("round", "shard", "data")
    return Scored(_named(scores, key, key_type, known.tokens), levels)


def _named(scores: DataFrame, key: str, key_type, tokens: int) -> DataFrame:
    return scores.select(
        F.col("key").cast(key_type).alias(key),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
