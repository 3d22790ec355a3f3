"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtext.llm.common import staged


def _hooked(pairs: DataFrame) -> DataFrame:
    """Per node its smallest neighbour or itself, beside every neighbour."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(low, "u")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links`` (a, b: long) to (node, root): the smallest node reachable.

    Each round hangs every node's larger neighbours, then its smaller ones, on
    the smallest node it knows, until the links are stars. Minima are combined
    before the shuffle and the joins are plain equi-joins, so a hub with very
    many links is split like any skewed key. Only a count and a checksum reach
    the driver. Nodes without links are absent; a null end is ignored."""
    now = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _hooked(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = _hooked(large)
        small = down.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(down.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = staged(small.where("a <> b").distinct(), "links")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
