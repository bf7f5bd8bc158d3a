"""Quality scores from document statistics: random Fourier features, ridge, isotonic calibration.

1. A whole text becomes a short vector of statistics (lengths, character classes, repetition).
2. The statistics are scaled by their mean and deviation over all documents and mapped to random
   Fourier features, whose inner products approximate a Gaussian kernel.
3. Each partition sums its share of the normal equations, per fold; the sums are added by row and
   ridge weights are solved on the driver, whose part is bounded by the number of features.
4. Scores of training rows under the model of the other folds are binned, and pooled adjacent
   violators over the bins give a monotone map from score to probability.

Defined results: NULL and empty texts have all statistics 0 and are scored like any other; a NULL
id is never held out and never matches a label; labels other than 0 and 1 are ignored, repeated
labels of one id count by majority (a tie as 1); without any label every score is 1.0, so nothing
is rejected without evidence; with one label only the score is that label.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpoise.llm.common import id_fold, small_batches
from counterpoise.session import spool

FEATURES = 256  # random Fourier features
WIDTH = 1.5  # kernel width in units of the square root of the number of statistics
RIDGE = 1e-4
CLIP = 5.0  # scaled statistics are cut off here
BINS = 1024  # of raw scores, for the calibration
TRAIN_FOLDS = (0, 1, 3)
SUM_GROUPS = 64  # partial sums are added in so many groups first
STATS = 20

_SYMBOLS = [ord(c) for c in "#$%&*@^~<>=+\\"]
_OTHER = [ord(c) for c in "\"'()[]{}:;?-_/`"]


def text_stats(text: str | None) -> list[float]:
    """Statistics of one whole text, all of them free of language and length units."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return [0.0] * STATS
    n = len(words)
    chars = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = int(chars[65:91].sum()), int(chars[97:123].sum())
    wide, digits = int(chars[128:].sum()), int(chars[48:58].sum())
    letters = max(1, upper + lower + wide)
    lines = raw.split(b"\n")
    distinct = len(set(words))
    same = sum(map(eq, words, words[1:]))
    same2 = sum(map(eq, words, words[2:]))
    most = max(Counter(words).values())
    return [
        float(np.log1p(n)),
        float(np.log1p(len(raw) / n)),
        upper / letters,
        wide / letters,
        digits / len(raw),
        chars[33] / n,
        chars[124] / n,
        float(chars[_SYMBOLS].sum()) / n,
        float(chars[_OTHER].sum()) / n,
        chars[46] / n,
        chars[44] / n,
        len(lines) / n,
        1 - len(set(lines)) / len(lines),
        distinct / n,
        float(np.log1p(distinct) / np.log1p(n)),
        same / n,
        same2 / n,
        most / n,
        float(np.log1p(max(map(len, words)))),
        float(np.log1p(max(map(len, lines)))),
    ]


def stats(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: text_stats(t if isinstance(t, str) else None))

    return run(text)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray  # statistics -> features
    shift: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # raw scores
    levels: np.ndarray  # calibrated scores at the knots

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP) @ self.turn + self.shift
        return np.hstack([np.sqrt(2 / len(self.shift)) * np.cos(z), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return self.features(x) @ (self.weights if weights is None else weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.knots) == 0:
            return np.ones(len(x))
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0.0, 1.0)


def scorer(model: Model):
    """Column function from statistics to the calibrated score."""

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        return pd.Series(model.score(np.stack(x.to_list())))

    return score


def pooled(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Isotonic regression: the closest non-decreasing values, by pooling violators."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, k2 = blocks.pop()
            v1, w1, k1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, k1 + k2])
    return np.array([v for v, _, k in blocks for _ in range(int(k))])


def majority_labels(labels: DataFrame, key: str, label: str) -> DataFrame:
    good = labels.filter(F.col(label).isin(0, 1)).groupBy(key).agg(F.avg(label).alias("y"))
    return good.select(key, (F.col("y") >= 0.5).cast("double").alias("y"))


def _sums(model: Model):
    """Per partition and fold: the rows of the normal equations, numbered by i."""

    def run(batches):
        size = len(model.shift) + 1
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for fold, rows in b.groupby("fold"):
                z = model.features(np.stack(rows["stats"].to_list()))
                y = rows["y"].to_numpy()[:, None]
                own = np.hstack([z.T @ z, z.T @ y, np.full((size, 1), float(len(rows)))])
                total[fold] = total.get(fold, 0) + own
        for fold, m in total.items():
            yield pd.DataFrame({"fold": fold, "i": np.arange(size), "part": list(m)})

    return run


def _add(rows: pd.DataFrame) -> pd.DataFrame:
    first = rows.iloc[0]
    ordered = sorted(map(tuple, rows["part"]))  # the order of arrival must not matter
    out = {"fold": first["fold"], "i": first["i"], "part": [np.sum(ordered, axis=0)]}
    return pd.DataFrame(out)


def fit(table: DataFrame, labels: DataFrame, key="doc_id", label="quality", seed=7) -> Model:
    """Model from ``table`` (key, stats) over all documents and a table of labels.

    Rows whose id falls in fold 2 are held out and never learned from.
    """
    x = F.col("stats")
    over = [f(x[i]).alias(f"{n}{i}") for i in range(STATS)
            for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    seen = table.agg(*over).first()
    mean = np.array([seen[f"m{i}"] or 0.0 for i in range(STATS)])
    spread = np.array([seen[f"s{i}"] or 0.0 for i in range(STATS)])
    rng = np.random.default_rng(seed)
    model = Model(
        mean=mean,
        scale=np.where(spread > 1e-9, spread, 1.0),
        turn=rng.normal(0, 1 / (WIDTH * np.sqrt(STATS)), (STATS, FEATURES)),
        shift=rng.uniform(0, 2 * np.pi, FEATURES),
        weights=np.zeros(FEATURES + 1),
        knots=np.zeros(0),
        levels=np.zeros(0),
    )
    fold = id_fold(F.col(key))
    known = spool(
        table.select(key, "stats", fold.alias("fold"))
        .filter(F.col("fold").isin(*TRAIN_FOLDS))
        .join(majority_labels(labels, key, label), key)
        .select("fold", "stats", "y"),
        "labelled",
    )
    shape = "fold int, i int, part array<double>"
    parts = known.mapInPandas(_sums(model), shape)
    group = F.pmod(F.xxhash64("part"), F.lit(SUM_GROUPS))
    halves = parts.groupBy("fold", "i", group).applyInPandas(_add, shape)
    sums = halves.groupBy("fold", "i").applyInPandas(_add, shape).orderBy("fold", "i").collect()
    if not sums:
        return model
    size = FEATURES + 1
    by_fold = {}
    for f in {r["fold"] for r in sums}:
        by_fold[f] = np.array([r["part"] for r in sums if r["fold"] == f])

    def solve(folds) -> np.ndarray:
        m = sum(by_fold[f] for f in folds)
        return np.linalg.solve(m[:, :size] + RIDGE * m[0, -1] * np.eye(size), m[:, size])

    model.weights = solve(by_fold)
    apart = {f: solve([g for g in by_fold if g != f]) if len(by_fold) > 1 else model.weights
             for f in by_fold}

    def bins(batches):
        for b in batches:
            for f, rows in b.groupby("fold"):
                s = model.raw(np.stack(rows["stats"].to_list()), apart[f])
                at = np.clip(np.floor((s + 0.5) * BINS / 2), 0, BINS - 1).astype(int)
                yield pd.DataFrame({"bin": at, "y": rows["y"].to_numpy()})

    cells = known.mapInPandas(bins, "bin int, y double").groupBy("bin")
    rows = cells.agg(F.count("*").alias("n"), F.avg("y").alias("y")).orderBy("bin").collect()
    model.knots = (np.array([r["bin"] for r in rows]) + 0.5) * 2 / BINS - 0.5
    model.levels = pooled(np.array([r["y"] for r in rows]), np.array([r["n"] for r in rows]))
    return model


def stats_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, stats) of every document, written once: a few hundred bytes each."""
    small_batches(docs.sparkSession)
    return spool(docs.select(key, stats(F.col(text)).alias("stats")), "stats")


def quality_score(model: Model, text: Column) -> Column:
    """Score straight from a text column; other columns never pass through Python."""
    return scorer(model)(stats(text))
