"""A14–A16 — service metrics as aggregates (counters and cumulative histograms).

Histograms are one aggregate pass: one conditional count per bucket bound
(the bounds are a fixed list), then ``stack`` to rows — no join with a
bucket table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtext import taxonomy as tx


def prediction_counts(history: DataFrame) -> DataFrame:
    """Predictions per (category, level); cache hits are not predictions."""
    return history.filter(~F.col("cached")).groupBy("category", "level").agg(F.count(F.lit(1)).alias("n"))


def cache_stats(flagged: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """Hits, misses and hit ratio of cache-flagged requests; rejected requests counted apart."""
    agg = flagged.agg(F.count_if(F.col("cached")).alias("hits"), F.count_if(~F.col("cached")).alias("misses"))
    agg = agg.withColumn(
        "hit_ratio",
        F.when(F.col("hits") + F.col("misses") > 0, F.round(F.col("hits") / (F.col("hits") + F.col("misses")), 4))
        .otherwise(F.lit(0.0)),
    )
    if rejected is not None:
        agg = agg.withColumn("rejected", rejected.agg(F.count(F.lit(1))).scalar())
    return agg


def bound_label(b: float) -> str:
    return repr(float(b))


def histogram(values: DataFrame, col: str, bounds: list[float] | None = None) -> DataFrame:
    """Cumulative bucket counts (le, cumulative) plus the count and sum of observations."""
    bounds = bounds or tx.HISTOGRAM_BOUNDS
    v: Column = F.col(col).cast("double")
    counts = [F.count_if(v <= F.lit(b)).alias(f"b{i}") for i, b in enumerate(bounds)]
    agg = values.agg(*counts, F.count(v).alias("total_count"), F.sum(v).alias("total_sum"))
    pairs = ", ".join(f"'{bound_label(b)}', b{i}" for i, b in enumerate(bounds))
    long = agg.selectExpr(f"stack({len(bounds) + 1}, {pairs}, '+Inf', total_count) as (le, cumulative)",
                          "total_count", "total_sum")
    return long.select("le", F.col("cumulative").cast("long").alias("cumulative"),
                       F.col("total_count").cast("long").alias("total_count"),
                       F.round("total_sum", 6).alias("total_sum"))
