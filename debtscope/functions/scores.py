"""Score formulas as column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from debtscope.functions.labels import severity
from debtscope.functions.rows import clamp, let, round_to

# Default weight of each dimension.
DEFAULT_WEIGHTS = {
    "complexity": 0.30,
    "duplication": 0.25,
    "documentation": 0.20,
    "error_handling": 0.25,
}
DIMENSIONS = tuple(DEFAULT_WEIGHTS)


def checked_weights(weights: dict[str, float] | str | None = None) -> dict[str, float]:
    """Complete weights from a mapping or JSON text; they must add up to 1.

    Missing dimensions keep their default. Unreadable JSON means all defaults.
    """
    given = weights or {}
    if isinstance(given, str):
        try:
            given = json.loads(given)
        except json.JSONDecodeError:
            given = {}
    merged = {**DEFAULT_WEIGHTS, **given}
    unknown = set(merged) - set(DEFAULT_WEIGHTS)
    if unknown:
        raise ValueError(f"unknown dimensions {sorted(unknown)}")
    total = sum(merged.values())
    if abs(total - 1.0) > 0.001:
        raise ValueError(f"weights must sum to 1.0, got {total}")
    return merged


def complexity_score(functions: Column, avg_cyclomatic: Column, max_cyclomatic: Column, avg_cognitive: Column) -> Column:
    """Complexity debt: mean cyclomatic number plus two capped surcharges."""
    base = clamp((avg_cyclomatic - 5) / 20)
    peak = F.when(max_cyclomatic > 20, F.least((max_cyclomatic - 20) / 30, F.lit(0.3))).otherwise(F.lit(0.0))
    load = F.when(avg_cognitive > 15, F.least((avg_cognitive - 15) / 30, F.lit(0.2))).otherwise(F.lit(0.0))
    total = F.least(F.least(base + peak, F.lit(1.0)) + load, F.lit(1.0))
    return F.when(functions == 0, F.lit(0.0)).otherwise(round_to(total, 4))


def duplication_score(total_lines: Column, percent: Column) -> Column:
    """Duplication debt: 3 % is free, 25 % is the maximum."""
    return F.when(total_lines == 0, F.lit(0.0)).otherwise(round_to(clamp((percent - 3) / 22), 4))


def documentation_score(coverage: Column) -> Column:
    """Documentation debt: 80 % coverage is free, 10 % is the maximum."""
    return round_to(clamp((1 - coverage - 0.2) / 0.7), 4)


def handling_score(functions: Column, coverage: Column, bare: Column) -> Column:
    """Error-handling quality, higher is better; 0.5 without functions."""
    fine = F.least(bare * 0.1, F.lit(0.3))
    return F.when(functions == 0, F.lit(0.5)).otherwise(round_to(F.greatest(coverage - fine, F.lit(0.0)), 4))


def weighted_parts(weights: dict[str, float], c: Column, d: Column, doc: Column, e: Column) -> dict[str, Column]:
    """What each dimension adds to the composite score."""
    return {
        "complexity": weights["complexity"] * c,
        "duplication": weights["duplication"] * d,
        "documentation": weights["documentation"] * doc,
        "error_handling": weights["error_handling"] * (1 - e),
    }


def composite_score(c: Column, d: Column, doc: Column, e: Column, weights: dict[str, float] | str | None = None) -> Column:
    """Weighted sum of the four dimensions, error handling inverted."""
    parts = weighted_parts(checked_weights(weights), c, d, doc, e)
    total = sum(list(parts.values())[1:], parts["complexity"])
    return round_to(clamp(total), 4)


def score_breakdown(c: Column, d: Column, doc: Column, e: Column, weights: dict[str, float] | str | None = None) -> Column:
    """Nested record: score, weight and weighted part of each dimension."""
    used = checked_weights(weights)
    parts = weighted_parts(used, c, d, doc, e)
    given = dict(zip(DIMENSIONS, (c, d, doc, e), strict=True))
    return F.struct(
        *[
            F.struct(
                given[name].alias("score"),
                F.lit(used[name]).alias("weight"),
                round_to(parts[name], 4).alias("weighted"),
            ).alias(name)
            for name in DIMENSIONS
        ]
    )


def weights_map(weights: dict[str, float] | str | None = None) -> Column:
    """The weights as a map column."""
    return F.create_map(*[F.lit(x) for pair in checked_weights(weights).items() for x in pair])


def content_size_score(lines: Column, characters: Column) -> Column:
    """Score of a text whose structure is not read: only its line count counts."""
    complexity = F.least(F.lit(0.8), lines / 1000)
    total = (complexity + 0.2 + 0.5 + 0.3) / 4
    return F.struct(
        total.alias("debt_score"),
        complexity.alias("complexity_score"),
        F.lit(0.2).alias("duplication_score"),
        F.lit(0.5).alias("documentation_score"),
        F.lit(0.3).alias("error_handling_score"),
        severity(total, "content").alias("severity"),
        characters.alias("file_size"),
    )


def _derived_dimensions(score: Column, method: Column) -> Column:
    return F.struct(
        score.alias("debt_score"),
        (score * 0.7).alias("complexity_score"),
        (score * 0.3).alias("duplication_score"),
        F.greatest(F.lit(0.2), 1 - score * 0.5).alias("documentation_score"),
        (score * 0.6).alias("error_handling_score"),
        severity(score, "metadata").alias("severity"),
        method.alias("analysis_method"),
    )


def metadata_score(size: Column, stars: Column) -> Column:
    """Score from repository size and stars; a constant where both are missing."""
    growth = F.when(size > 10000, F.lit(0.2)).when(size > 1000, F.lit(0.1)).otherwise(F.lit(0.0))
    fame = F.when(stars > 10000, F.lit(0.1)).when(stars > 1000, F.lit(0.05)).otherwise(F.lit(0.0))
    known = size.isNotNull() | stars.isNotNull()
    score = F.when(known, clamp(F.lit(0.3) + growth - fame)).otherwise(F.lit(0.35))
    method = F.when(known, "github_api_fallback").otherwise("synthetic_fallback")
    return _derived_dimensions(score, method)


def _upper_tail(size: Column) -> Column:
    # Coefficients of Abramowitz and Stegun 26.2.17.
    b1, b2, b3, b4, b5 = 0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429
    t = 1 / (1 + 0.2316419 * size)
    series = t * (b1 + t * (b2 + t * (b3 + t * (b4 + t * b5))))
    return F.exp(-size * size / 2) / 2.5066282746310002 * series


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, good to about 7e-8."""
    return let(z, lambda v: F.when(v >= 0, 1 - _upper_tail(v)).otherwise(_upper_tail(-v)))


def two_sided_p(z: Column) -> Column:
    """Two-sided p-value of a standard normal statistic."""
    return F.when(z.isNotNull(), F.least(F.lit(1.0), 2 * let(F.abs(z), _upper_tail)))


def approximate_power(d: Column, n1: Column, n2: Column) -> Column:
    """Power of a two-group comparison; 0 with a note under ten rows a group."""
    n = F.least(n1, n2)
    power = clamp(normal_cdf(d * F.sqrt(n / 2) - 1.96))
    return F.struct(
        F.when(n < 10, F.lit(0.0)).otherwise(power).alias("power"),
        F.when(n < 10, F.lit(False)).otherwise(power >= 0.8).alias("adequate"),
        F.when(n < 10, F.lit("Sample size too small"))
        .otherwise(F.format_string("Effect size: %.3f, Sample size: %d", d, n.cast("long")))
        .alias("note"),
    )
