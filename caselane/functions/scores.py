"""Arithmetic shared by the metric operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, with an empty denominator giving 0 (the usual zero-division rule of a recall)."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def share(top: Column, bottom: Column) -> Column:
    """``top / bottom``, with an empty denominator giving NULL."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def decide(probability: Column, threshold: float = 0.5) -> Column:
    """1 where the probability reaches the cut-off; exactly at the cut-off counts."""
    return (probability >= F.lit(threshold)).cast("int")


def confidence(probability: Column, threshold: float = 0.5) -> Column:
    return F.when(probability >= F.lit(threshold), probability).otherwise(F.lit(1.0) - probability)


def rates(tn: Column, fp: Column, fn: Column, tp: Column) -> dict[str, Column]:
    """Accuracy, per-class and macro precision / recall / F1 from the four counts."""
    out = {
        "accuracy": share(tn + tp, tn + fp + fn + tp),
        "precision_0": ratio(tn, tn + fn),
        "recall_0": ratio(tn, tn + fp),
        "f1_0": ratio(2 * tn, 2 * tn + fn + fp),
        "precision_1": ratio(tp, tp + fp),
        "recall_1": ratio(tp, tp + fn),
        "f1_1": ratio(2 * tp, 2 * tp + fn + fp),
    }
    for name in ("precision", "recall", "f1"):
        out[f"{name}_macro"] = (out[f"{name}_0"] + out[f"{name}_1"]) / 2
    return out
