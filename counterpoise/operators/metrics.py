"""Evaluation of (prediction, label) pairs: one aggregation, then arithmetic on four cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpoise.functions import scores

CELLS = ("tp", "fp", "fn", "tn")


def cells(*by: str):
    """Returns a function from scored(prediction, label, by...) to tp, fp, fn, tn per group."""

    def count(scored: DataFrame) -> DataFrame:
        p, y = F.col("prediction"), F.col("label")
        return scored.groupBy(*by).agg(
            F.count_if((p == 1) & (y == 1)).alias("tp"),
            F.count_if((p == 1) & (y == 0)).alias("fp"),
            F.count_if((p == 0) & (y == 1)).alias("fn"),
            F.count_if((p == 0) & (y == 0)).alias("tn"),
        )

    return count


def _cols() -> list[Column]:
    return [F.col(c) for c in CELLS]


def binary_metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 at both thresholds and the two areas, per row of ``counts``.

    Threshold 0 accepts every row.  A threshold that does not occur among the predictions has
    NULL metrics.
    """
    tp, fp, fn, tn = _cols()
    others = [c for c in counts.columns if c not in CELLS]
    return counts.select(
        *others,
        scores.precision_at_0(tp, fp, fn, tn).alias("precision_at_0"),
        scores.precision_at_1(tp, fp).alias("precision_at_1"),
        scores.recall_at_0(tp, fn, tn).alias("recall_at_0"),
        scores.recall_at_1(tp, fp, fn).alias("recall_at_1"),
        scores.f1_at_0(tp, fp, fn, tn).alias("f1_at_0"),
        scores.f1_at_1(tp, fp, fn).alias("f1_at_1"),
        scores.area_under_pr(tp, fp, fn, tn).alias("aupr"),
        scores.area_under_roc(tp, fp, fn, tn).alias("auroc"),
    )


def confusion_matrix(scored: DataFrame) -> DataFrame:
    """(label, predicted_0, predicted_1): rows per true and predicted class."""
    p = F.col("prediction")
    return scored.groupBy("label").agg(
        F.count_if(p == 0).alias("predicted_0"), F.count_if(p == 1).alias("predicted_1")
    )


def metrics_by_label(scored: DataFrame) -> DataFrame:
    """(label, n, precision, recall, fpr, f1) for both classes; empty ratios count as 0."""
    one = cells()(scored)
    tp, fp, fn, tn = _cols()
    both = F.array(
        F.struct(F.lit(0).alias("label"), tn.alias("tp"), fn.alias("fp"), fp.alias("fn"),
                 tp.alias("tn")),
        F.struct(F.lit(1).alias("label"), *_cols()),
    )
    per = one.select(F.explode(both).alias("c")).select("c.*")

    def ratio(num: Column, den: Column) -> Column:
        return F.when(den > 0, num / F.when(den > 0, den)).otherwise(F.lit(0.0))

    return per.filter(tp + fp + fn > 0).select(
        "label",
        (tp + fn).alias("n"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(fp, fp + tn).alias("fpr"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def weighted_metrics(scored: DataFrame) -> DataFrame:
    """Averages of the per-class metrics, weighted by the number of rows of the class."""
    n = F.col("n")
    return metrics_by_label(scored).agg(
        *[
            (F.sum(F.col(m) * n) / F.sum(n)).alias(f"weighted_{m}")
            for m in ("precision", "recall", "f1", "fpr")
        ]
    )
