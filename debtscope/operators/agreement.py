"""Agreement of two raters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from debtscope.functions.labels import kappa_words
from debtscope.functions.rows import round_to

# Rated metrics, in reporting order.
METRICS = {
    "ai_identification_score": "verification.ai_identification_score",
    "overall_debt_severity": "verification.overall_debt_severity",
    "debt_severity_scores.complexity": "verification.debt_severity_scores.complexity",
    "debt_severity_scores.duplication": "verification.debt_severity_scores.duplication",
    "debt_severity_scores.documentation": "verification.debt_severity_scores.documentation",
    "debt_severity_scores.error_handling": "verification.debt_severity_scores.error_handling",
}


def long_ratings(annotations: DataFrame) -> DataFrame:
    """One row per repository and metric from annotation rows."""
    metrics = [
        F.struct(F.lit(name).alias("metric"), F.col(path).cast("int").alias("rating")) for name, path in METRICS.items()
    ]
    return annotations.select("repo_id", F.explode(F.array(*metrics)).alias("m")).select("repo_id", "m.*")


def paired_ratings(first: DataFrame, second: DataFrame) -> DataFrame:
    """Ratings of two raters matched by repository; pairs with a missing rating are dropped."""
    a = long_ratings(first).withColumnRenamed("rating", "r1")
    b = long_ratings(second).withColumnRenamed("rating", "r2")
    return a.join(b, ["repo_id", "metric"]).where("r1 is not null and r2 is not null").select("metric", "r1", "r2")


def kappa(pairs: DataFrame) -> DataFrame:
    """Unweighted kappa, wording, pairs and rater means per metric.

    The rating table of a metric is tiny, so both margins and the agreement
    come from counts per rating and not from the pairs themselves. One class
    used by both raters throughout leaves kappa undefined (null).
    """
    cells = pairs.groupBy("metric", "r1", "r2").agg(F.count("*").alias("n"))
    sides = F.array(
        F.struct(F.col("r1").alias("rating"), F.col("n").alias("first"), F.lit(0).cast("long").alias("second")),
        F.struct(F.col("r2").alias("rating"), F.lit(0).cast("long").alias("first"), F.col("n").alias("second")),
    )
    margins = (
        cells.select("metric", F.explode(sides).alias("s"))
        .groupBy("metric", "s.rating")
        .agg(F.sum("s.first").cast("double").alias("first"), F.sum("s.second").cast("double").alias("second"))
        .groupBy("metric")
        .agg(F.sum(F.col("first") * F.col("second")).alias("chance"))
    )
    totals = cells.groupBy("metric").agg(
        F.sum("n").alias("n_samples"),
        F.sum(F.when(F.col("r1") == F.col("r2"), F.col("n")).otherwise(0)).alias("agreed"),
        F.sum(F.col("r1") * F.col("n")).alias("sum1"),
        F.sum(F.col("r2") * F.col("n")).alias("sum2"),
    )
    n = F.col("n_samples")
    observed, expected = F.col("agreed") / n, F.col("chance") / (n.cast("double") * n)
    raw = F.when(expected < 1, F.round((observed - expected) / (1 - expected), 10))
    return (
        totals.join(margins, "metric")
        .withColumn("raw", raw)
        .select(
            "metric",
            round_to(F.col("raw"), 4).alias("kappa"),
            kappa_words(F.col("raw")).alias("interpretation"),
            "n_samples",
            round_to(F.col("sum1") / n, 2).alias("rater1_mean"),
            round_to(F.col("sum2") / n, 2).alias("rater2_mean"),
        )
    )


def overall_agreement(kappas: DataFrame, target: float = 0.60) -> DataFrame:
    """Mean kappa over the metrics and whether it reaches the target."""
    means = kappas.agg(F.avg("kappa").alias("mean"), F.count("kappa").alias("metrics_evaluated"))
    return means.select(
        round_to(F.col("mean"), 4).alias("average_kappa"),
        (F.col("mean") >= target).alias("adequate"),
        F.lit(target).alias("target"),
        "metrics_evaluated",
    )
