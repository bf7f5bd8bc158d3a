"""Closed forms of the ranking metrics for hard 0/1 predictions.

With only two score values the curves have one inner point, so the areas are arithmetic on
the four cells of the confusion matrix.  Label 1 is the scored class.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(num: Column, den: Column, empty: float) -> Column:
    return F.when(den == 0, F.lit(empty)).otherwise(num / F.when(den != 0, den))


def precision_at_1(tp: Column, fp: Column) -> Column:
    """NULL when nothing was predicted 1: the threshold does not occur."""
    return F.when(tp + fp > 0, tp / F.when(tp + fp != 0, tp + fp))


def recall_at_1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp + fp > 0, _ratio(tp, tp + fn, 0.0))


def f1_at_1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp + fp > 0, _ratio(2 * tp, 2 * tp + fp + fn, 0.0))


def precision_at_0(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Threshold 0 accepts every row; NULL when no row was predicted 0."""
    return F.when(fn + tn > 0, (tp + fn) / F.when(fn + tn > 0, tp + fp + fn + tn))


def recall_at_0(tp: Column, fn: Column, tn: Column) -> Column:
    return F.when(fn + tn > 0, F.when(tp + fn > 0, F.lit(1.0)).otherwise(F.lit(0.0)))


def f1_at_0(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    return F.when(fn + tn > 0, _ratio(2 * (tp + fn), 2 * (tp + fn) + fp + tn, 0.0))


def area_under_pr(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    n = tp + fp + fn + tn
    base = (tp + fn) / F.when(n != 0, n)
    p = tp / F.when(tp + fp != 0, tp + fp)
    r = _ratio(tp, tp + fn, 0.0)
    return F.when(tp + fp == 0, base).otherwise(r * p + (1 - r) * (p + base) / 2)


def area_under_roc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    pos, neg = tp + fn, fp + tn
    tpr = tp / F.when(pos != 0, pos)
    fpr = fp / F.when(neg != 0, neg)
    return (
        F.when(pos == 0, F.lit(0.0)).when(neg == 0, F.lit(1.0)).otherwise((tpr - fpr + 1) / 2)
    )
