"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from debtscope.llm.shared import stored


def _hooked(pairs: DataFrame) -> DataFrame:
    """Each pair (u, v) with the smallest of u and its partners."""
    least = pairs.groupBy(F.col("u").alias("_u")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(least, F.col("u") == F.col("_u"))


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u > v)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _hooked(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    small = _hooked(large)
    lifted = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
    return lifted.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns a and b); root is the smallest node reached.

    Every round writes its edges to the shared folder and hands two numbers to
    the driver, a count and a sum of hashes; it ends when they stay the same.
    Rounds grow with the logarithm of the longest chain. Minima are summed
    before the shuffle, so a node with very many links is no hot key.
    """
    now = stored(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while mark != (mark := tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())) and mark[0]:
        now = stored(_round(now), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
