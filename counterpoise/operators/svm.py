"""A linear SVM by full-batch gradient descent, for all folds and scenarios at once.

The weights are a table with one vector per term: an entry per left-out fold and scenario.  A step
adds the weights up per row (margins), turns the margins into coefficients, and adds the
coefficients up per term (gradient).  Rows are written once in buckets, so with weights that can
be broadcast a step moves only the sums per term.

Step t has length step / sqrt(t), the hinge loss is taken over all rows, weights shrink by the
regularisation, there is no intercept, and a fold and scenario stops when its weights move by less
than the tolerance: the rules of the ``mllib`` library.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpoise.operators.lookup import (
    BROADCAST_ROWS,
    fits_broadcast,
    frequent_keys,
    lookup_join,
)
from counterpoise.operators.model import STEP, exploded
from counterpoise.session import bucketed, spool

SVM = "svm"
# Defaults of the library.
REGULARISATION, TOLERANCE = 0.01, 0.001
ENTRIES = 96  # of a vector that one pass adds up in compiled code
ALL = -1  # no fold is left out


def _vector(values: Sequence[Column]) -> Column:
    return F.array(*values).alias("m")


def _rows(train: DataFrame, hashed: int | None) -> DataFrame:
    """(rid, fold, y, w, terms) of train(fold, label, text, w), in buckets."""
    numbered = train.withColumn("rid", F.monotonically_increasing_id())
    kept = bucketed(numbered.select("rid", "fold", "label", "text", "w"), "rid")
    y = F.when(F.col("label") == 1, 1).otherwise(-1)
    return kept.select("rid", "fold", y.alias("y"), "w", "text")


def _terms(rows: DataFrame, *columns: str, hashed: int | None) -> DataFrame:
    return exploded(rows, *columns, hashed=hashed)


def _descend(rows, n, folds, iterations, step, reg, tolerance, hashed) -> DataFrame:
    """(term, m): weights per fold of ``folds`` and scenario, m[f * n + s]."""
    at = [(f, s) for f in folds for s in range(n)]
    counted = rows.groupBy("fold").agg(*[F.sum(F.col("w")[s]).alias(f"n{s}") for s in range(n)])
    sizes = {r["fold"]: r for r in counted.collect()}  # one row per fold
    total = [sum(r[f"n{s}"] for g, r in sizes.items() if g != f) for f, s in at]

    # a row counts as often as its scenario holds it, and not in the model without its fold
    share = [
        F.when(F.col("fold") == f, 0).otherwise(F.col("w")[s] * F.col("y")) for f, s in at
    ]
    weights, still = None, [n > 0 for n in total]
    terms, head = 0, None
    for t in range(1, iterations + 1):
        if weights is None:
            coefs = rows.select("text", _vector(share))
        else:
            tok = _terms(rows, "rid", hashed=hashed)
            found = lookup_join(tok, weights, "term", "inner", table_rows=terms, head=head)
            sums = [F.sum(F.col("m")[j] * F.col("tf")).alias(f"_{j}") for j in range(len(at))]
            margin = found.groupBy("rid").agg(*sums)
            active = [
                F.when(F.coalesce(F.col(f"_{j}"), F.lit(0.0)) * F.col("y") < 1.0, c).otherwise(0)
                for j, c in enumerate(share)
            ]
            coefs = rows.join(margin, "rid", "left").select("text", _vector(active))
        # counted in whole numbers, so the sums do not depend on their order
        tok = _terms(coefs, "m", hashed=hashed)
        whole = tok.groupBy("term").agg(
            *[F.sum(F.col("m")[j] * F.col("tf")).alias(f"_{j}") for j in range(len(at))]
        )
        length = step / math.sqrt(t)
        gain = [length / n if n and go else 0.0 for n, go in zip(total, still)]
        if weights is None:
            new = whole.select("term", _vector([F.col(f"_{j}") * g for j, g in enumerate(gain)]))
            weights = spool(new, "svm")
            # terms and their frequencies are the same in all steps
            if iterations > 1 and not fits_broadcast(weights):
                terms = BROADCAST_ROWS + 1
                head = frequent_keys(_terms(rows, "rid", hashed=hashed), "term", BROADCAST_ROWS)
            continue
        kept = [1.0 - length * reg if go else 1.0 for go in still]
        new = [
            F.col("m")[j] * k + F.coalesce(F.col(f"_{j}"), F.lit(0)) * g
            for j, (k, g) in enumerate(zip(kept, gain))
        ]
        both = weights.join(whole, "term", "left").select("term", F.col("m").alias("before"), _vector(new))
        both = spool(both, "svm")
        moved = [F.sum(F.pow(F.col("m")[j] - F.col("before")[j], 2)) for j in range(len(at))]
        size = [F.sum(F.pow(F.col("m")[j], 2)) for j in range(len(at))]
        norms = both.agg(*moved, *size).first()
        weights = both.select("term", "m")
        for j in range(len(at)):
            way, norm = math.sqrt(norms[j] or 0), math.sqrt(norms[len(at) + j] or 0)
            still[j] = still[j] and way >= tolerance * max(norm, 1.0)
        if not any(still):
            break
    return weights


def svm_weights(
    train: DataFrame,
    n: int,
    folds: int,
    iterations: int,
    step: float = STEP,
    reg: float = REGULARISATION,
    tolerance: float = TOLERANCE,
    hashed: int | None = None,
) -> DataFrame:
    """(term, by_fold): vectors over scenarios by the fold that is left out, for
    train(fold, label, text, w)."""
    rows = _rows(train, hashed)
    result = None
    some = max(1, ENTRIES // n)
    for start in range(0, folds, some):
        part = list(range(start, min(folds, start + some)))
        found = _descend(rows, n, part, iterations, step, reg, tolerance, hashed)
        entries = F.array(*[
            F.struct(F.lit(f).alias("fold"), F.slice("m", i * n + 1, n).alias("v"))
            for i, f in enumerate(part)
        ])
        one = found.select("term", entries.alias("e"))
        result = one if result is None else result.join(one.withColumnRenamed("e", "more"), "term").select(
            "term", F.concat("e", "more").alias("e"))
    return result.select("term", F.map_from_entries("e").alias("by_fold"))


def svm_model(train: DataFrame, iterations: int, hashed: int | None = None, **how) -> DataFrame:
    """(term, weight) of the SVM of train(label, text)."""
    once = F.array(F.lit(1).cast("short")).alias("w")
    rows = _rows(train.select(F.lit(0).alias("fold"), "label", "text", once), hashed)
    rules = {"step": STEP, "reg": REGULARISATION, "tolerance": TOLERANCE} | how
    found = _descend(rows, 1, [ALL], iterations, hashed=hashed, **rules)
    return found.select("term", F.col("m")[0].alias("weight"))
