"""Classifier output scalars: F19 (blended confidence), F20 (softmax), O6 (argmax)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax_index(scores: Column) -> Column:
    """0-based index of the first maximum (ties: first wins)."""
    return F.array_position(scores, F.array_max(scores)) - 1


def softmax(scores: Column) -> Column:
    """exp(x - max) / sum, as an array<double>."""
    x = F.transform(scores, lambda v: v.cast("double"))
    m = F.array_max(x)
    ex = F.transform(x, lambda v: F.exp(v - m))
    s = F.aggregate(ex, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(ex, lambda v: v / s)


def top_confidence(scores: Column) -> Column:
    """Probability of the best class after softmax, 4 decimals (= 1 / sum exp(x - max))."""
    x = F.transform(scores, lambda v: v.cast("double"))
    m = F.array_max(x)
    s = F.aggregate(F.transform(x, lambda v: F.exp(v - m)), F.lit(0.0), lambda acc, v: acc + v)
    return F.round(F.lit(1.0) / s, 4)


def blended_confidence(category_conf: Column, level_conf: Column) -> Column:
    """0.6 * category + 0.4 * level, both already 4-decimal; exact decimal arithmetic."""
    c = F.round(category_conf.cast("double"), 4).cast("decimal(12,4)")
    lv = F.round(level_conf.cast("double"), 4).cast("decimal(12,4)")
    out = F.lit(0.6).cast("decimal(2,1)") * c + F.lit(0.4).cast("decimal(2,1)") * lv
    return F.round(out, 4).cast("double")
