"""Language identification with averaged subword embeddings and a linear softmax.

A text is lower-cased; every run of 2 to 4 bytes that holds part of a letter is a subword, hashed
into a table of embeddings.  The mean embedding of the whole text goes through one linear layer.
Both are trained by stochastic gradient descent in numpy on a bounded sample of labelled texts,
stratified by language.  For prediction the embedding table and the layer are multiplied once,
so a text's logits are the mean of one small row per subword.

Calibration uses rows that training does not see: a temperature is fitted to the log loss, and the
rejection threshold is the smallest confidence above which the wanted share of answers is right.

Defined results: NULL texts and texts without a letter are ``und`` with score 0; languages that
are NULL are not learned; without any labelled text all texts are ``und``; ties go to the
language first by code point; repeated rows count as often as they are sampled; rows with a NULL
id are predicted, not learned.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpoise.llm.common import id_fold, small_batches

UNKNOWN = "und"
BUCKETS = 1 << 15
DIM = 16
GRAMS = (2, 3, 4)
SAMPLE = 2000  # labelled texts to learn from, shared evenly by the languages
SAMPLE_CHARS = 50_000  # longer texts are not learned from
MAX_LANGS = 500
EPOCHS, RATE = 8, 8.0
TRUST = 0.99  # share of right answers that the rejection threshold asks for
TRAIN_FOLDS, CALIBRATION_FOLD = (0, 1), 3
CHUNK = 1 << 18  # bytes of one text that are hashed at once

_LETTER = re.compile(r"[^\W\d_]")


def subwords(text: str):
    """Buckets of the byte runs of a whole text, a bounded number at a time."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)
    letter = (raw >= 128) | ((raw >= 97) & (raw <= 122))
    clean = np.where(letter, raw, 32).astype(np.uint8)
    for n in GRAMS:
        for a in range(0, len(raw) - n + 1, CHUNK):
            size = min(CHUNK, len(raw) - n + 1 - a)
            h = np.full(size, 2166136261 + n, np.uint32)
            some = np.zeros(size, bool)
            for i in range(a, a + n):
                h = (h ^ clean[i : i + size]) * np.uint32(16777619)
                some |= letter[i : i + size]
            h ^= h >> np.uint32(15)
            yield (h & np.uint32(BUCKETS - 1))[some]


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # bucket -> logits
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.langs)), 0
        for h in subwords(text):
            total += self.table.take(h, axis=0).sum(axis=0, dtype=np.float64)
            n += len(h)
        return total / max(n, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0
        p = _softmax(self.logits(text)[None, :] / self.temperature)[0]
        best = int(np.argmax(p))
        return self.langs[best], float(p[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, str]], seed: int = 11) -> tuple[list[str], np.ndarray]:
    """Languages and the bucket table of logits, by plain stochastic gradient descent."""
    langs = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM))
    out = np.zeros((DIM, len(langs)))
    bags = [np.unique(np.concatenate([*subwords(t)]), return_counts=True) for t, _ in rows]
    goal = np.array([langs.index(lang) for _, lang in rows])
    steps, total = 0, max(1, EPOCHS * len(rows))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            rate = RATE * (1 - steps / total)
            steps += 1
            bucket, n = bags[i]
            if not len(bucket):
                continue
            share = n / n.sum()
            mean = share @ emb[bucket]
            p = _softmax((mean @ out)[None, :])[0]
            p[goal[i]] -= 1
            back = out @ p
            out -= rate * 0.1 * np.outer(mean, p)
            emb[bucket] -= rate * np.outer(share, back)
    return langs, (emb @ out).astype(np.float32)


def calibrate(model: Model, rows: list[tuple[str, str]]) -> Model:
    known = [(t, model.langs.index(x)) for t, x in rows if x in model.langs and _LETTER.search(t)]
    if not known:
        return model
    logits = np.stack([model.logits(t) for t, _ in known])
    goal = np.array([g for _, g in known])

    def loss(temperature: float) -> float:
        p = _softmax(logits / temperature)[np.arange(len(goal)), goal]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    model.temperature = min((2.0 ** (e / 4) for e in range(-24, 13)), key=loss)
    p = _softmax(logits / model.temperature)
    sure, right = p.max(axis=1), p.argmax(axis=1) == goal
    order = np.argsort(-sure, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(share >= TRUST)
    model.threshold = float(sure[order][fine[-1]]) if len(fine) else 1.0
    return model


def _sample(docs: DataFrame, key: str, text: str, lang: str, folds, most: int):
    """At most about ``most`` labelled texts of the given folds, the same share per language."""
    fold, at = id_fold(F.col(key)), F.xxhash64(F.lit("langid"), F.col(key))
    rows = docs.select(text, F.col(lang).alias("lang"), at.alias("at"), fold.alias("fold")).filter(
        F.col("fold").isin(*folds) & F.col("lang").isNotNull() & F.col(text).isNotNull()
    )
    rows = rows.filter(F.length(text) <= SAMPLE_CHARS)
    counts = rows.groupBy("lang").count().limit(MAX_LANGS + 1).collect()
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not counts:
        return []
    share = most / len(counts)
    cut = F.lit(-(2**63))
    for name, n in counts:
        part = min(1.0, share / n)
        top = min(2**63 - 1, int(-(2**63) + part * 2**64))
        cut = F.when(F.col("lang") == name, F.lit(top)).otherwise(cut)
    took = rows.filter(F.col("at") <= cut).select(text, "lang", "at")
    # hashes may repeat with repeated rows: a plain limit keeps the sample bounded
    return [(t, x) for t, x, _ in took.orderBy("at", text).limit(2 * most).collect()]


def fit(docs: DataFrame, key="doc_id", text="text", lang="lang") -> Model:
    """Model learned from rows outside the held-out fold."""
    small_batches(docs.sparkSession)
    rows = _sample(docs, key, text, lang, TRAIN_FOLDS, SAMPLE)
    if not rows:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    model = Model(*train(rows))
    return calibrate(model, _sample(docs, key, text, lang, (CALIBRATION_FOLD,), SAMPLE // 4))


def predicted(model: Model, text: Column) -> Column:
    """Struct (lang_pred, score) for a whole text."""

    @F.pandas_udf("lang_pred string, score double")
    def run(s: pd.Series) -> pd.DataFrame:
        found = [model.predict(t if isinstance(t, str) else None) for t in s]
        return pd.DataFrame(found, columns=["lang_pred", "score"])

    return run(text)
