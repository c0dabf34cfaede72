"""Segmentation metrics as aggregates: each is one pass with partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def confusion(truth: Column, pred: Column) -> list[Column]:
    """tn, fp, fn, tp."""
    cell = lambda t, p, name: F.count_if((truth == t) & (pred == p)).alias(name)
    return [cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(1, 1, "tp")]


def rates(tn: Column, fp: Column, fn: Column, tp: Column) -> list[Column]:
    """Sensitivity, specificity and accuracy, 0 for an empty denominator."""
    share = lambda a, b, name: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)).alias(name)
    return [share(tp, tp + fn, "sensitivity"), share(tn, tn + fp, "specificity"), share(tp + tn, tp + tn + fp + fn, "accuracy")]


def pixel_dice(t: Column, p: Column, smooth: float = 1e-5) -> Column:
    """Mean of the dice of each pixel; a pixel empty in both scores 1."""
    return F.avg((2 * t * p + smooth) / (t + p + smooth))


def global_dice(t: Column, p: Column, smooth: float = 1e-5) -> Column:
    return (2 * F.sum(t * p) + smooth) / (F.sum(t) + F.sum(p) + smooth)


def soft_counts(t: Column, p: Column) -> list[Column]:
    """Sums of rounded products, halves to even: tp, tn, fp, fn."""
    r = lambda x: F.sum(F.bround(x, 0))
    return [r(t * p).alias("tp"), r((1 - t) * (1 - p)).alias("tn"), r((1 - t) * p).alias("fp"), r(t * (1 - p)).alias("fn")]


def pixel_accuracy(t: Column, p: Column) -> Column:
    return F.avg(F.when(F.bround(t, 0) == F.bround(p, 0), 1.0).otherwise(0.0))


def tversky_loss(t: Column, p: Column, w: Column, alpha: float, beta: float) -> Column:
    """1 - tp / (tp + alpha * fp + beta * fn), all weighted and soft."""
    tp, fp, fn = F.sum(w * p * t), F.sum(w * p * (1 - t)), F.sum(w * (1 - p) * t)
    return 1 - tp / (tp + alpha * fp + beta * fn + 1e-5)
