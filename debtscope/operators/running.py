"""Running totals over long groups without one task holding a whole group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running(
    df: DataFrame,
    keys: Sequence[str],
    block: Column,
    order: Sequence[Column | str],
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running sums and maxima of each row's predecessors and itself.

    ``block`` cuts a group into consecutive stretches and must not decrease
    along ``order``. Totals run over whole blocks first, then inside each
    block, so the largest sort is one block or the list of a group's blocks,
    never a whole group. Results are the same as those of one long window. Rows
    with a null key or block are left out. Only blocks that have others before
    them are joined, so choose blocks that most groups need one of.
    """
    sums, maxima = dict(sums or {}), dict(maxima or {})
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in (*keys, "_block")])
    rows = df.withColumn("_block", block).where(known)
    for name, value in {**sums, **maxima}.items():
        rows = rows.withColumn(f"_in_{name}", value)

    totals = rows.groupBy(*keys, "_block").agg(
        *[F.sum(f"_in_{name}").alias(f"_base_{name}") for name in sums],
        *[F.max(f"_in_{name}").alias(f"_base_{name}") for name in maxima],
    )
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(
        *keys,
        "_block",
        *[F.sum(f"_base_{name}").over(earlier).alias(f"_base_{name}") for name in sums],
        *[F.max(f"_base_{name}").over(earlier).alias(f"_base_{name}") for name in maxima],
        F.row_number().over(W.partitionBy(*keys).orderBy("_block")).alias("_nth"),
    )
    bases = bases.where("_nth > 1").drop("_nth")

    inside = W.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    # The window leaves the rows as the join wants them, so they are shuffled and sorted once.
    parts = {f"_part_{name}": F.sum(f"_in_{name}").over(inside) for name in sums} | {f"_part_{name}": F.max(f"_in_{name}").over(inside) for name in maxima}
    joined = rows.withColumns(parts).join(bases, [*keys, "_block"], "left")
    for name in sums:
        joined = joined.withColumn(name, F.coalesce(F.col(f"_base_{name}"), F.lit(0)) + F.coalesce(F.col(f"_part_{name}"), F.lit(0)))
    for name in maxima:
        joined = joined.withColumn(name, F.greatest(F.col(f"_base_{name}"), F.col(f"_part_{name}")))
    helpers = ["_block", *[f"{p}_{n}" for n in (*sums, *maxima) for p in ("_in", "_base", "_part")]]
    return joined.drop(*helpers)
