"""Aggregations of file and repository scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from debtscope.functions.labels import dashboard_cohort, severity, study_cohort
from debtscope.functions.rows import ratio, round_to
from debtscope.operators.ranks import exact_median
from debtscope.schemas import DIMENSION_COLUMNS, SCORE_COLUMNS

SEVERITY_ORDER = ("LOW", "MEDIUM", "HIGH")


def repository_rollup(
    files: DataFrame,
    repo: str = "repo",
    weight: str = "file_size",
    lines: str = "total_lines",
    more_sums: Sequence[str] = (),
) -> DataFrame:
    """Size-weighted mean of the five scores per repository, with counts and severity."""
    size = F.coalesce(F.col(weight), F.lit(1)).cast("double")
    sums = [F.sum(F.coalesce(F.col(s), F.lit(0.0)) * size).alias(f"_{s}") for s in SCORE_COLUMNS]
    totals = files.groupBy(repo).agg(
        F.count("*").alias("files_analyzed"), F.sum(lines).alias("total_lines"), F.sum(size).alias("_weight"),
        *sums,
        *[F.sum(c).alias(c) for c in more_sums],
    )
    means = [F.when(F.col("_weight") > 0, F.col(f"_{s}") / F.col("_weight")).otherwise(F.lit(0.0)).alias(s) for s in SCORE_COLUMNS]
    return totals.select(
        repo, "files_analyzed", "total_lines", *more_sums, *means
    ).withColumn("severity", severity(F.round(F.col("debt_score"), 10), "repository"))


def directory_summary(scores: DataFrame, skipped: DataFrame | None = None, score: str = "debt_score") -> DataFrame:
    """Files, mean, extremes and severity counts of a directory, with the mean's own severity."""
    level = F.col("_level")
    totals = scores.withColumn("_level", severity(F.col(score), "file")).agg(
        F.count("*").alias("files_analyzed"),
        round_to(F.coalesce(F.avg(score), F.lit(0.0)), 4).alias("average_score"),
        round_to(F.max(score), 4).alias("max_score"),
        round_to(F.min(score), 4).alias("min_score"),
        *[F.count_if(level == word).alias(word) for word in ("low", "medium", "high")],
    )
    missed = skipped.agg(F.count("*")).scalar() if skipped is not None else F.lit(0).cast("long")
    return totals.withColumn("files_skipped", missed).withColumn(
        "directory_severity", severity(F.col("average_score"), "directory")
    )


def primary_language(files: DataFrame, repo: str = "repo", language: str = "language") -> DataFrame:
    """Most frequent language of each repository, ties by name; Unknown where none is known."""
    counts = files.groupBy(repo, language).agg(F.count(language).alias("n"))
    ordered = W.partitionBy(repo).orderBy(F.col("n").desc(), F.col(language))
    return (
        counts.withColumn("_rank", F.row_number().over(ordered))
        .where("_rank = 1")
        .select(repo, F.coalesce(language, F.lit("Unknown")).alias("primary_language"), F.col("n").alias("file_count"))
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first; null is not counted."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), column)
    )


def value_share(df: DataFrame, column: str) -> DataFrame:
    """Share of each value among all that have one."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(column, "n", F.round(F.col("n") / total, 6).alias("share"))


def count_map(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Per group a map from value to rows; counts are made before the map is built."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    entries = F.sort_array(F.collect_list(F.struct(column, "_n")))
    return counts.groupBy(*keys).agg(F.map_from_entries(entries).alias(name))


def cohort_description(df: DataFrame) -> DataFrame:
    """Rows, mean stars, forks and size per study cohort, with language and confidence maps."""
    labelled = df.withColumn("cohort", study_cohort(F.col("ai_confidence"))).where("cohort is not null")
    have = set(df.columns)
    mean = lambda c: (F.avg(c) if c in have else F.lit(0.0)).alias(f"avg_{c}")
    out = labelled.groupBy("cohort").agg(F.count("*").alias("total_repos"), *[mean(c) for c in ("stars", "forks", "size_kb")])
    for column in ("language", "ai_confidence"):
        name = f"{column}_distribution"
        if column in have:
            out = out.join(count_map(labelled, ["cohort"], column, name), "cohort", "left")
        else:
            out = out.withColumn(name, F.create_map().cast("map<string,bigint>"))
    return out


def validation_report(df: DataFrame, age: Column) -> DataFrame:
    """Size, age and quality figures of a dataset in one row; medians are exact."""
    sized = df.withColumn("_size", F.col("size_kb").try_cast("double")).withColumn("_age", age.cast("double"))
    cohort = study_cohort(F.col("ai_confidence"))
    report = sized.agg(
        F.count("*").alias("total_repos"),
        F.count_if(cohort == "ai").alias("ai_repos"),
        F.count_if(cohort == "human").alias("human_repos"),
        F.avg("_size").alias("size_mean"),
        F.min("_size").alias("size_min"),
        F.max("_size").alias("size_max"),
        F.stddev_samp("_size").alias("size_std"),
        F.avg("_age").alias("age_mean"),
        F.min("_age").alias("age_min"),
        F.max("_age").alias("age_max"),
        F.count_if(F.col("stars") > 0).alias("has_stars"),
        F.count("description").alias("has_description"),
        F.avg("stars").alias("avg_stars"),
        F.avg("forks").alias("avg_forks"),
    )
    medians = {n: exact_median(sized, [], f"_{n}").select("median").scalar() for n in ("size", "age")}
    return report.withColumns({f"{n}_median": m for n, m in medians.items()})


def cohort_moments(df: DataFrame, score: str = "debt_score") -> DataFrame:
    """Count, sum and sum of squares of a score per dashboard cohort: enough for mean and spread."""
    value = F.col(score)
    return df.withColumn("cohort", dashboard_cohort(F.col("ai_confidence"))).groupBy("cohort").agg(
        F.count(value).alias("n"), F.sum(value).alias("total"), F.sum(value * value).alias("squares"), F.count("*").alias("rows")
    )


def effect_of_moments(moments: DataFrame) -> DataFrame:
    """Cohort counts, means and the plain effect size from one row of moments per cohort."""
    pick = lambda cohort, c: F.coalesce(F.max(F.when(F.col("cohort") == cohort, F.col(c))), F.lit(0))
    wide = moments.agg(
        *[pick(g, c).alias(f"{g}_{c}") for g in ("ai", "human") for c in ("n", "rows", "total", "squares")]
    )

    def mean(g: str) -> Column:
        return ratio(F.col(f"{g}_total"), F.col(f"{g}_n"))

    def variance(g: str) -> Column:
        n, total = F.col(f"{g}_n"), F.col(f"{g}_total")
        return (F.col(f"{g}_squares") - total * total / n) / (n - 1)

    pooled = (variance("ai") + variance("human")) / 2
    usable = (F.col("ai_rows") > 1) & (F.col("human_rows") > 1)
    effect = F.when(usable, F.when(pooled > 1e-15, (mean("ai") - mean("human")) / F.sqrt(pooled)))
    return wide.select(
        (F.col("ai_rows") + F.col("human_rows")).alias("total_repos"),
        F.col("ai_rows").alias("ai_repos"),
        F.col("human_rows").alias("human_repos"),
        mean("ai").alias("avg_ai_score"),
        mean("human").alias("avg_human_score"),
        F.coalesce(effect, F.lit(0.0)).alias("effect_size"),
    )


def dashboard_stats(df: DataFrame) -> DataFrame:
    """Totals, cohort means, effect size and the language map in one row."""
    languages = count_map(df, [], "language", "languages")
    return effect_of_moments(cohort_moments(df)).withColumn("languages", languages.scalar())


def score_histogram(df: DataFrame, score: str = "debt_score", bins: int = 20) -> DataFrame:
    """Rows per cohort and bin of a fixed 0 to 1 range; 1 itself falls in the last bin."""
    number = F.least(F.floor(F.col(score) * bins).cast("int"), F.lit(bins - 1))
    return (
        df.where(F.col(score).isNotNull())
        .groupBy(dashboard_cohort(F.col("ai_confidence")).alias("cohort"), number.alias("bin"))
        .agg(F.count("*").alias("n"))
        .withColumn("bin_start", F.col("bin") / bins)
    )


def dimension_means(df: DataFrame) -> DataFrame:
    """Mean of each dimension per cohort, one row per cohort and dimension."""
    means = df.groupBy(dashboard_cohort(F.col("ai_confidence")).alias("cohort")).agg(
        *[F.avg(c).alias(c) for c in DIMENSION_COLUMNS]
    )
    return means.unpivot(["cohort"], list(DIMENSION_COLUMNS), "dimension", "mean_score")


def severity_counts(df: DataFrame) -> DataFrame:
    """Rows per severity for both cohorts, zeros filled also where a cohort has no row."""
    cohort = dashboard_cohort(F.col("ai_confidence"))
    pairs = [(c, s) for c in ("ai", "human") for s in SEVERITY_ORDER]
    wide = df.agg(*[F.count_if((cohort == c) & (F.col("severity") == s)).alias(f"{c}_{s}") for c, s in pairs])
    rows = F.array(*[F.struct(F.lit(c).alias("cohort"), F.lit(s).alias("severity"), F.col(f"{c}_{s}").alias("n")) for c, s in pairs])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def study_plan(df: DataFrame) -> DataFrame:
    """Readiness figures of a dataset: counts, means, difference, size and balance checks."""
    ai = dashboard_cohort(F.col("ai_confidence")) == "ai"
    score = F.col("debt_score")
    have = set(df.columns)
    distinct = lambda c: (F.count_distinct(c) if c in have else F.lit(0).cast("long")).alias(f"{c}_count")
    figures = df.agg(
        F.count("*").alias("total_repos"),
        F.count_if(ai).alias("ai_repos"),
        F.count_if(~ai).alias("human_repos"),
        distinct("language"),
        distinct("domain"),
        F.avg(score).alias("overall_mean"),
        F.avg(F.when(ai, score)).alias("ai_mean"),
        F.avg(F.when(~ai, score)).alias("human_mean"),
    )
    median = exact_median(df, [], "debt_score").select("median").scalar()
    return (
        figures.withColumn("overall_median", median)
        .withColumn("expected_effect", F.abs(F.col("ai_mean") - F.col("human_mean")))
        .withColumn("sample_size_adequate", F.col("total_repos") >= 34)
        .withColumn("balance_adequate", F.abs(F.col("ai_repos") - F.col("human_repos")) <= 5)
    )
