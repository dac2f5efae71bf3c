"""Exact small-sample p-values by counting rank arrangements.

They run on one result row per test, never on data rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from debtscope.functions.rows import let

# Sizes up to which the exact count is used unless a method is named.
RANK_SUM_LIMIT = 8
RANK_SUM_PAIRS = 10_000
SIGNED_RANK_LIMIT = 50


def _start(length: Column) -> Column:
    zeros = F.array_repeat(F.lit(0.0), length.cast("int"))
    return F.concat(F.array(F.lit(1.0)), zeros)


def _at(values: Column, index: Column) -> Column:
    return F.when(index >= 0, F.coalesce(F.get(values, index.cast("int")), F.lit(0.0))).otherwise(F.lit(0.0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def signed_rank_p(statistic: Column, n: Column) -> Column:
    """Two-sided p of the smaller signed rank sum over all sign patterns of ``n`` untied ranks."""
    size = n.cast("int")
    counts = F.aggregate(
        F.sequence(F.lit(1), size),
        _start(size * (size + 1) / 2),
        lambda acc, i: F.transform(acc, lambda x, k: x + _at(acc, k - i)),
    )
    below = F.slice(counts, 1, (F.floor(statistic) + 1).cast("int"))
    return F.least(F.lit(1.0), 2 * _total(below) / F.pow(F.lit(2.0), size))


def rank_sum_p(statistic: Column, n1: Column, n2: Column) -> Column:
    """Two-sided p of U over all orders of two untied groups.

    The counts are the coefficients of a Gaussian binomial, built factor by
    factor: times (1 - q^(n2 + i)), then divided by (1 - q^i).
    """
    first, second = n1.cast("int"), n2.cast("int")

    def factor(acc: Column, i: Column) -> Column:
        times = F.transform(acc, lambda x, k: x - _at(acc, k - second - i))
        return let(
            times,
            lambda t: F.transform(
                t,
                lambda x, k: F.aggregate(F.sequence(k % i, k, i), F.lit(0.0), lambda s, j: s + _at(t, j)),
            ),
        )

    counts = F.aggregate(F.sequence(F.lit(1), first), _start(first * second), factor)
    extreme = F.greatest(statistic, first * second - statistic)
    return let(
        counts,
        lambda c: F.least(F.lit(1.0), 2 * _total(F.slice(c, extreme.cast("int") + 1, F.size(c))) / _total(c)),
    )
