"""Benchmark decontamination: BM25 over the test items, block-max WAND, overlap check.

The index holds the test items, not the corpus.  Every training text is cut into overlapping
passages, and every passage is a query: all items above a score threshold are retrieved, with no
top-k.  An item's weights are divided by the item's own total, so a score is the share of the
item that the passage covers.  Score bounds per block of items, added up over a passage, rule out
most blocks; in the others WAND finds the items.  A passage is at least as long as the longest item and the next
one starts half a passage later, so two neighbours together hold any verbatim item and one of
them scores at least 0.5; the threshold lies below that.  Retrieved items are verified on the
whole text: the share of question and answer words that stand in common five-word shingles.

Question and answer are decided on apart: a text leaks an item if at least 0.8 of the question's
words, or of the answer's, stand in common shingles; a question or answer of fewer than PART words
decides only together with the other one, by 0.8 of all words.  Every part that can decide is an
entry of the index with its own weights, so a question without its answer is retrieved too.

The index travels to every executor: its size is that of the benchmark and is checked.  A larger benchmark is
searched in parts, one after the other.

Defined results: texts and items that are NULL or without words match nothing; an item of fewer
than five words is one shingle; repeated rows and repeated items are each reported; rows with a
NULL id are searched like any other; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from counterpoise.llm.common import small_batches

K1, B = 1.2, 0.75
THRESHOLD = 0.4  # share of an item's weight that a passage must cover
OVERLAP = 0.8  # share of an item's words that must stand in common shingles
SHINGLE = 5
PART = 13  # words that a question or an answer needs to count by itself
PASSAGE = 64  # words, or the longest item if that is longer
BLOCKS = 128  # blocks of items, each with its own score bounds
CHUNK_STEPS = 4096  # half passages of one text that are bounded at once
SLACK = 1e-4  # of sums of single-precision bounds
INDEX_WORDS = 1_000_000  # words of items in one index

# ASCII punctuation separates words; everything else, letters beyond ASCII too, is kept
_LETTERS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Lower-cased words of letters and digits."""
    return (text or "").lower().encode("utf-8", "replace").translate(_LETTERS).split()


def question_words(text: str) -> int:
    """Words before the answer: the part after a question mark, else the last sentence."""
    stripped = text.rstrip()
    marks = [m.end() for m in re.finditer(r"\?\s+", stripped)]
    stops = [m.end() for m in re.finditer(r"[.!]\s+", stripped)]
    cut = marks[-1] if marks else stops[-1] if stops else len(stripped)
    return len(terms(stripped[:cut]))


class Index:
    """Inverted index with impacts, and their maxima per term and block of items.

    Entries, the parts of items, are dealt to BLOCKS blocks of neighbouring numbers.  ``block_tops`` has one row per
    term, row 0 for words that no item has.
    """

    def __init__(self, items: list[tuple[int, str]]):
        kept = [(i, t, terms(t)) for i, t in items]
        kept = [(i, t, w) for i, t, w in kept if w]
        self.ids = [i for i, _, _ in kept]
        self.words = [w for _, _, w in kept]
        self.question = [question_words(t) for _, t, _ in kept]
        self.shingles = [_shingles(w) for w in self.words]
        self.entries = [e for w, q in zip(self.words, self.question) for e in entries(w, q)]
        self.item = [d for d, w in enumerate(self.words) for _ in entries(w, self.question[d])]
        self.passage = max([PASSAGE, *map(len, self.words)])
        n = len(self.entries)
        self.block = max(1, math.ceil(n / BLOCKS))
        mean = sum(map(len, self.entries)) / n if n else 1.0
        df = Counter(t for w in self.entries for t in set(w))
        self.number = {t: i + 1 for i, t in enumerate(sorted(df))}
        lists: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for d, w in enumerate(self.entries):
            own = {}
            for t, tf in Counter(w).items():
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                own[t] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
            total = sum(own.values())
            for t, x in own.items():
                lists[self.number[t]].append((d, x / total))
        self.docs = {t: [d for d, _ in p] for t, p in lists.items()}
        self.impacts = {t: [x for _, x in p] for t, p in lists.items()}
        self.block_tops = np.zeros((len(df) + 1, BLOCKS), np.float32)
        for t, p in lists.items():
            for d, x in p:
                at = (t, d // self.block)
                self.block_tops[at] = max(self.block_tops[at], x)

    def above(self, query: set[int], block: int, least: float) -> dict[int, float]:
        """All entries of one block that score ``least`` or more, by WAND: lists stay sorted by
        their next entry, and the bounds of the first lists say which entry can reach it."""
        first, end = block * self.block, (block + 1) * self.block
        lists = []
        for t in query:
            docs = self.docs[t]
            a, b = bisect_left(docs, first), bisect_left(docs, end)
            if a < b:
                lists.append((docs[a:b], self.impacts[t][a:b], float(self.block_tops[t, block])))
        at, live = [0] * len(lists), list(range(len(lists)))
        found: dict[int, float] = {}
        while live:
            live.sort(key=lambda k: lists[k][0][at[k]])
            bound, goal = 0.0, None
            for k in live:
                bound += lists[k][2]
                if bound >= least:
                    goal = lists[k][0][at[k]]
                    break
            if goal is None:
                break
            score = 0.0
            for k in live:
                docs = lists[k][0]
                if docs[at[k]] > goal:
                    break
                at[k] = bisect_left(docs, goal, at[k])
                if at[k] < len(docs) and docs[at[k]] == goal:
                    score += lists[k][1][at[k]]
                    at[k] += 1
            if score >= least:
                found[goal] = score
            live = [k for k in live if at[k] < len(lists[k][0])]
        return found

    def search(self, text: str | None) -> list[tuple[int, float, float, float]]:
        """(item, best score, question overlap, answer overlap) of every verified item."""
        words = terms(text)
        if not words or not self.ids:
            return []
        number = np.fromiter(map(self.number.get, words, repeat(0)), np.int32, len(words))
        step = self.passage // 2
        best: dict[int, float] = {}
        for chunk in range(0, len(words), step * CHUNK_STEPS):
            part = number[chunk : chunk + step * CHUNK_STEPS + self.passage]
            known = np.flatnonzero(part)  # a word counts once per half passage
            place = known // step * len(self.block_tops) + part[known]
            place = np.unique(place)
            halves = np.zeros((math.ceil(len(part) / step), BLOCKS), np.float32)
            half, cuts = np.unique(place // len(self.block_tops), return_index=True)
            if len(half):
                tops = self.block_tops[place % len(self.block_tops)]
                halves[half] = np.add.reduceat(tops, cuts, axis=0)
            bounds = halves[:-1] + halves[1:] if len(halves) > 1 else halves
            if self.passage % 2:
                bounds = bounds + self.block_tops.max(axis=0)
            for i, block in np.argwhere(bounds >= THRESHOLD - SLACK).tolist():
                query = set(part[i * step : i * step + self.passage].tolist()) - {0}
                for d, score in self.above(query, block, THRESHOLD - SLACK).items():
                    best[self.item[d]] = max(best.get(self.item[d], 0.0), score)
        return self._verified(words, best) if best else []

    def _verified(self, words: list[bytes], best: dict[int, float]):
        sizes = {min(SHINGLE, len(self.words[d])) for d in best}
        own = {k: set(zip(*[words[i:] for i in range(k)])) for k in sizes}
        out = []
        for d, score in sorted(best.items()):
            item, k = self.words[d], min(SHINGLE, len(self.words[d]))
            covered = np.zeros(len(item), bool)
            for i, s in enumerate(self.shingles[d]):
                if s in own[k]:
                    covered[i : i + k] = True
            q = self.question[d]
            answer = float(covered[q:].mean()) if q < len(item) else 1.0
            question = float(covered[:q].mean()) if q else 1.0
            alone = q >= PART and question >= OVERLAP or len(item) - q >= PART and answer >= OVERLAP
            if alone or covered.mean() >= OVERLAP:
                out.append((self.ids[d], min(1.0, score), question, answer))
        return out


def entries(words: list[bytes], question: int) -> list[list[bytes]]:
    """What can decide: question and answer, and the whole item unless both count by themselves
    or there is no other part."""
    parts = [words[:question], words[question:]]
    long = [p for p in parts if len(p) >= PART]
    return long if len(long) == len([p for p in parts if p]) else [*long, words]


def _shingles(words: list[bytes]) -> list[tuple[bytes, ...]]:
    k = min(SHINGLE, len(words))
    return list(zip(*[words[i:] for i in range(k)]))


def indexes(items: DataFrame, key: str = "item_id", text: str = "text") -> list[Index]:
    """Indexes over all items, each of at most INDEX_WORDS words (or one item)."""
    rows = items.select(key, text).filter(F.col(text).isNotNull()).orderBy(key, text)
    out, batch, size = [], [], 0
    for i, t in rows.toLocalIterator():
        n = len(terms(t))
        if batch and size + n > INDEX_WORDS:
            out.append(Index(batch))
            batch, size = [], 0
        batch.append((i, t))
        size += n
    return [*out, Index(batch)] if batch or not out else out


FOUND = ArrayType(
    StructType(
        [
            StructField("item_id", LongType()),
            StructField("score", DoubleType()),
            StructField("question_overlap", DoubleType()),
            StructField("answer_overlap", DoubleType()),
        ]
    )
)


def with_leaks(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``leaks``: one entry per test item found in the text."""
    small_batches(docs.sparkSession)

    def column(index: Index):
        @F.pandas_udf(FOUND)
        def search(s: pd.Series) -> pd.Series:
            names = ("item_id", "score", "question_overlap", "answer_overlap")
            return s.map(
                lambda t: [
                    dict(zip(names, hit))
                    for hit in index.search(t if isinstance(t, str) else None)
                ]
            )

        return search(F.col(text))

    found = reduce(lambda a, b: F.concat(a, b), [column(x) for x in indexes(items)])
    return docs.withColumn("leaks", found)


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, score, question_overlap, answer_overlap), a row per text and item."""
    found = with_leaks(docs.select(key, text), items, text)
    return found.select(key, F.explode("leaks").alias("leak")).select(key, "leak.*")
