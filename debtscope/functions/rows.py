"""Small helpers for work inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    A plain column alias may be inlined by the optimizer into a lambda and
    then run once per array element; a lambda argument never is. It also keeps
    formulas that use a value several times from multiplying when predicates
    are pushed through them.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def round_to(value: Column, places: int) -> Column:
    """Round as the stored scores are rounded.

    A tie that a double holds exactly (such as 4.125) goes to the even digit,
    any other goes up, after floating noise below 1e-10 is dropped.
    """
    return let(
        value.cast("double"),
        lambda v: F.when(v * 65536 == F.floor(v * 65536), F.bround(v, places)).otherwise(F.round(F.round(v, 10), places)),
    )


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Force a value into a range; null stays null."""
    return let(
        value.cast("double"), lambda v: F.when(v < low, F.lit(low)).when(v > high, F.lit(high)).otherwise(v)
    )


def ratio(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    """``part / whole`` with a stated value where ``whole`` is 0."""
    return F.when(whole != 0, part / whole).otherwise(F.lit(empty).cast("double"))
