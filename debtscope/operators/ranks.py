"""Ranks and medians from value histograms.

Raw rows are first counted per distinct value, which Spark combines inside
each task, so a value that a third of all rows share is one row afterwards.
Only distinct values are then put in order, block by block.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from debtscope.operators.running import running


def _with_cuts(hist: DataFrame, keys: Sequence[str], value: str, parts: int) -> DataFrame:
    """Add ``parts`` cut points of each group's distinct values, so that blocks are of like size."""
    shares = [i / parts for i in range(1, parts)]
    cuts = hist.groupBy(*keys).agg(F.percentile_approx(F.col(value).cast("double"), shares, 10000).alias("_cuts"))
    return hist.join(cuts, list(keys)) if keys else hist.withColumn("_cuts", cuts.scalar())


def _ordered(hist: DataFrame, keys: Sequence[str], value: str, names: Sequence[str], parts: int) -> DataFrame:
    """Running sums of the named counts over the values of each group.

    Cut points only balance the blocks; results do not depend on them.
    """
    # Never null, or the join on it would filter the raw rows by this expression.
    block = F.coalesce(F.size(F.filter("_cuts", lambda cut: cut < F.col(value))), F.lit(0))
    spread = _with_cuts(hist, keys, value, parts)
    return running(spread, keys, block, [value], sums={f"up_to_{n}": F.col(n) for n in names}).drop("_cuts")


def ranked_values(
    df: DataFrame, keys: Sequence[str], value: str, counts: Mapping[str, Column], parts: int = 64, weight: str | None = None
) -> DataFrame:
    """Distinct values per group with their counts, rows up to them and average rank.

    ``counts`` maps names to row conditions; the column ``n`` counts all rows.
    A ``weight`` column tells how many rows an input row stands for.
    """
    each = F.col(weight) if weight else F.lit(1)
    hist = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(
            F.sum(each).alias("n"),
            *[F.sum(F.when(rule, each).otherwise(0)).alias(name) for name, rule in counts.items()],
        )
    )
    summed = _ordered(hist, keys, value, ["n", *counts], parts)
    return summed.withColumn("rank", F.col("up_to_n") - F.col("n") + (F.col("n") + 1) / 2)


def exact_median(df: DataFrame, keys: Sequence[str], value: str, parts: int = 64) -> DataFrame:
    """Exact median per group without holding a group in one task."""
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    totals = hist.groupBy(*keys).agg(F.sum("n").alias("rows"))
    summed = _ordered(hist, keys, value, ["n"], parts)
    counted = summed.join(totals, list(keys)) if keys else summed.withColumn("rows", totals.scalar())
    lower, upper = F.floor((F.col("rows") + 1) / 2), F.ceil((F.col("rows") + 1) / 2)
    first, last = F.col("up_to_n") - F.col("n"), F.col("up_to_n")
    pick = lambda rank: F.max(F.when((rank > first) & (rank <= last), F.col(value)))
    return counted.groupBy(*keys).agg(((pick(lower) + pick(upper)) / 2).alias("median"))
