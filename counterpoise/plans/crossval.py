"""Cross-validation of many scenarios in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpoise.operators.changes import Vectors, bag, cell_counts
from counterpoise.operators.generate import Gen
from counterpoise.operators.metrics import binary_metrics
from counterpoise.operators.model import (
    FEATURES,
    NAIVE_BAYES,
    class_totals,
    fold_constants,
    margins,
    training_stats,
)
from counterpoise.operators.svm import SVM, svm_weights
from counterpoise.session import spool

FOLDS = 10


def fold_cells(scored: DataFrame, names: Sequence[str]) -> DataFrame:
    """(scenario, fold, tp, fp, fn, tn) of ``scored(fold, label, tw, same, prediction)``, with
    vectors over scenarios.

    Rows that are tested equally often in all scenarios are counted together; there are only a
    few such patterns, so scenarios are told apart after all rows are counted.
    """
    p, same = F.col("prediction"), F.col("same")
    hits = [F.sum(F.when(p[s] == 1, same).otherwise(0)).alias(f"_h{s}") for s in range(len(names))]
    return _cells(scored.groupBy("fold", "label", "tw").agg(F.sum("same").alias("_n"), *hits), names)


def added_cells(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """``fold_cells`` of ``counts(fold, label, tw, n, hits)``: rows, and how many are predicted as 1."""
    hits = [F.sum(F.col("hits")[s]).alias(f"_h{s}") for s in range(len(names))]
    return _cells(counts.groupBy("fold", "label", "tw").agg(F.sum("n").alias("_n"), *hits), names)


def _cells(alike: DataFrame, names: Sequence[str]) -> DataFrame:
    n = len(names)
    zipped = F.arrays_zip("tw", F.array(*[f"_h{s}" for s in range(n)]).alias("h"))
    each = alike.select("fold", "label", "_n", F.posexplode(zipped).alias("s", "x"))
    weight = F.col("x.tw").cast("bigint")
    ones, zeros = weight * F.col("x.h"), weight * (F.col("_n") - F.col("x.h"))

    def cell(count: Column, label: int) -> Column:
        return F.sum(F.when(F.col("label") == label, count).otherwise(F.lit(0).cast("bigint")))

    cells = each.filter(weight > 0).groupBy("s", "fold").agg(
        cell(ones, 1).alias("tp"),
        cell(ones, 0).alias("fp"),
        cell(zeros, 1).alias("fn"),
        cell(zeros, 0).alias("tn"),
    )
    return cells.select(_name(names).alias("scenario"), "fold", "tp", "fp", "fn", "tn")


def _name(names: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), F.col("s") + 1)


def average_over_folds(cells: DataFrame) -> DataFrame:
    """(scenario, f1_at_0, f1_at_1, aupr, auroc): means over the folds that have the metric."""
    tested = cells.filter(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn") > 0)
    return (
        binary_metrics(tested)
        .groupBy("scenario")
        .agg(*[F.avg(m).alias(m) for m in ("f1_at_0", "f1_at_1", "aupr", "auroc")])
    )


def cross_validate(
    train: DataFrame,
    test: DataFrame,
    key: Sequence[str],
    names: Sequence[str],
    classifier: str = NAIVE_BAYES,
    folds: int = FOLDS,
    features: int = FEATURES,
    hashed: int | None = None,
    iterations: int = 1,
) -> DataFrame:
    """One row per scenario: training rows per class and the averaged metrics.

    ``train(fold, label, text, w)`` and ``test(key, fold, label, text, tw)``: rows of fold f
    are scored by the model of all training rows outside fold f.  ``hashed``: buckets instead of
    terms; ``iterations``: gradient steps of the ``svm`` classifier.
    """
    n = len(names)
    stats = spool(training_stats(train, hashed), "stats")
    weights = svm_weights(train, n, folds, iterations, hashed=hashed) if classifier == SVM else None
    scored = margins(
        stats, test, key, n, classifier, folds, hashed or features, hashed, weights
    )
    metrics = average_over_folds(fold_cells(scored, names))

    docs = class_totals(stats, n).select("label", F.posexplode("docs").alias("s", "docs"))
    sizes = docs.groupBy("s").agg(
        *[
            F.sum(F.when(F.col("label") == c, F.col("docs")).otherwise(0)).alias(f"n_label_{c}")
            for c in (0, 1)
        ]
    )
    return sizes.select(_name(names).alias("scenario"), "n_label_0", "n_label_1").join(
        metrics, "scenario", "left"
    )


def cross_validate_changes(
    table: DataFrame,
    gens: Sequence[Gen],
    vectors: Vectors,
    names: Sequence[str],
    classifier: str,
    folds: int = FOLDS,
    features: int = FEATURES,
    seed: str | None = None,
) -> DataFrame:
    """``cross_validate`` of ``changes``, whose copies ``vectors`` says; ``seed`` as for ``bag``."""
    stats = spool(bag(table, gens, vectors, seed), "stats")
    constants = fold_constants(stats, len(names), folds, features)
    counts = cell_counts(table, stats, gens, vectors, classifier, constants, seed)
    metrics = average_over_folds(added_cells(counts, names))
    sizes = constants["sizes"]
    rows = [(name, *map(int, n)) for name, n in zip(names, sizes.T)] if sizes.any() else []
    shape = "scenario string, n_label_0 bigint, n_label_1 bigint"
    return table.sparkSession.createDataFrame(rows, shape).join(metrics, "scenario", "left")
