"""Preparation of repository datasets: merge, clean, filter, browse."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from debtscope.functions.labels import BLOB_LANGUAGES, age_days, dashboard_cohort, language_of
from debtscope.functions.paths import in_skipped_blob_folder, in_skipped_tree
from debtscope.schemas import SCORE_COLUMNS

# Bounds of a usable repository.
MIN_SIZE, MAX_SIZE = 5000, 50000
STUDY_LANGUAGES = ("Python", "JavaScript", "TypeScript", "Jupyter Notebook")
MIN_AGE_DAYS = 365


def concat_datasets(datasets: Sequence[DataFrame]) -> DataFrame:
    """Stack datasets whose columns differ; absent columns become null. ``source_ord`` keeps their order."""
    tagged = [df.withColumn("source_ord", F.lit(i)) for i, df in enumerate(datasets)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row of each key in the given order.

    A rank filter, not ``dropDuplicates``, which keeps an arbitrary row. Each
    task cuts a repeated key to one row before the shuffle.
    """
    first = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def merge_datasets(datasets: Sequence[DataFrame], key: str = "url", row_order: str = "row_ord") -> DataFrame:
    """Stack and keep the first row of each address."""
    return keep_first(concat_datasets(datasets), [key], ["source_ord", row_order])


def to_number(value: Column, kind: str = "double") -> Column:
    """Number from text, null where it is none."""
    return value.try_cast(kind)


def to_moment(value: Column) -> Column:
    """Timestamp from text, null where it is none."""
    return value.try_cast("timestamp")


def number_or(value: Column, default: float) -> Column:
    """Number with a default for null and not-a-number."""
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), F.lit(float(default))).otherwise(number)


def backfill(df: DataFrame) -> DataFrame:
    """Add and fill the columns a dashboard dataset needs."""
    if "ai_confidence" not in df.columns:
        label = F.lit("None")
        if "type" in df.columns:
            label = F.when(F.lower("type") == "human", "None").otherwise("High")
        df = df.withColumn("ai_confidence", label)
    for name, value in (("source", "static"), ("analysis_method", "dataset"), ("created_at", "")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value))
    for name in SCORE_COLUMNS:
        if name in df.columns:
            df = df.withColumn(name, F.coalesce(to_number(F.col(name)), F.lit(0.0)))
    defaults = {"ai_confidence": "None", "severity": "LOW"}
    return df.fillna({name: value for name, value in defaults.items() if name in df.columns})


def _filter_steps(df: DataFrame, as_of: Column) -> list[tuple[str, Column]]:
    have = set(df.columns)
    size = to_number(F.col("size_kb"))
    steps = [("size", (size >= MIN_SIZE) & (size <= MAX_SIZE))]
    if "language" in have:
        steps.append(("language", F.col("language").isin(*STUDY_LANGUAGES)))
    if "created_at" in have:
        steps.append(("age", age_days(to_moment(F.col("created_at")), as_of) >= MIN_AGE_DAYS))
    if "is_private" in have:
        steps.append(("public", ~F.coalesce(F.col("is_private").try_cast("boolean"), F.lit(False))))
    if "stars" in have:
        steps.append(("stars", F.coalesce(to_number(F.col("stars")), F.lit(0.0)) > 0))
    return [(name, F.coalesce(rule, F.lit(False))) for name, rule in steps]


def filter_dataset(df: DataFrame, as_of: Column) -> DataFrame:
    """Rows inside the size, language, age, visibility and star bounds; absent columns are skipped."""
    return reduce(lambda d, step: d.where(step[1]), _filter_steps(df, as_of), df)


def filter_counts(df: DataFrame, as_of: Column) -> DataFrame:
    """Rows left after each filter step, from one pass over the data."""
    passed, totals = F.lit(True), [F.count("*").alias("n_0_all")]
    for i, (name, rule) in enumerate(_filter_steps(df, as_of), start=1):
        passed = passed & rule
        totals.append(F.count_if(passed).alias(f"n_{i}_{name}"))
    return df.agg(*totals)


def usable_size(df: DataFrame, size: str = "size_kb") -> DataFrame:
    """Control candidates by size."""
    return df.where(F.col(size).between(MIN_SIZE, MAX_SIZE))


def source_paths(df: DataFrame, path: str = "path") -> DataFrame:
    """Paths outside the folders a local scan skips."""
    return df.where(~in_skipped_tree(F.col(path)))


def blob_candidates(
    blobs: DataFrame,
    partition: Sequence[str] = ("repo",),
    path: str = "path",
    size: str = "size",
    top: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Blobs to score: known language, not hidden.

    A ``top`` keeps the smallest of each repository, ``max_bytes`` caps their size after that.
    """
    kept = blobs.where(
        (F.col("type") == "blob") & ~in_skipped_blob_folder(F.col(path))
    ).withColumn("language", language_of(F.col(path), BLOB_LANGUAGES))
    kept = kept.where("language is not null")
    if top is not None:
        kept = smallest_files(kept, partition, size, path, top)
    return kept if max_bytes is None else kept.where(F.col(size) <= max_bytes)


def smallest_files(df: DataFrame, partition: Sequence[str], size: str, tiebreak: str, top: int = 40) -> DataFrame:
    """The ``top`` smallest files of each repository."""
    order = W.partitionBy(*partition).orderBy(F.col(size), F.col(tiebreak))
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= top).drop("_rank")


def browse(df: DataFrame, cohort: str = "all", language: str = "") -> DataFrame:
    """Dashboard browse filter: all, ai or human, and an exact language."""
    if cohort in ("ai", "human"):
        df = df.where(dashboard_cohort(F.col("ai_confidence")) == cohort)
    return df.where(F.col("language") == language) if language else df


def history(df: DataFrame, severity: str = "", search: str = "", as_pattern: bool = False) -> DataFrame:
    """Runtime rows, by severity and by a search in name or address (literal unless ``as_pattern``)."""
    if "source" in df.columns:
        df = df.where("source = 'quick_analysis'")
    elif "analysis_method" in df.columns:
        df = df.where("analysis_method <> 'dataset'")
    if severity.upper() in ("LOW", "MEDIUM", "HIGH") and "severity" in df.columns:
        df = df.where(F.upper("severity") == severity.upper())
    term = search.strip().lower()
    fields = [F.lower(c) for c in ("name", "url") if c in df.columns]
    if term and fields:
        hits = [f.rlike(term) if as_pattern else f.contains(term) for f in fields]
        df = df.where(reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in hits]))
    return df


def append_rows(dataset: DataFrame, analysed: DataFrame) -> DataFrame:
    """Dataset with newly analysed rows at its end."""
    return dataset.unionByName(analysed, allowMissingColumns=True)
