"""Repository datasets, annotations and exports as files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from debtscope.functions.paths import query_slug
from debtscope.functions.rows import round_to
from debtscope.schemas import ANNOTATION_FILE, DIMENSION_COLUMNS, HISTORY_COLUMNS, REPOSITORY_TYPES

_CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def _typed(name: str, text: Column) -> Column:
    kind = REPOSITORY_TYPES[name]
    if kind.startswith("array"):
        return F.coalesce(F.from_json(text, kind, {"mode": "PERMISSIVE"}), F.array().cast(kind))
    if kind in ("long", "int"):
        return F.coalesce(text.try_cast(kind), text.try_cast("double").try_cast(kind))
    return text if kind == "string" else text.try_cast(kind)


def read_repositories(spark: SparkSession, path: str | list[str], score: str | None = None) -> DataFrame:
    """Repository dataset from CSV: known columns typed, list columns decoded, others kept as text.

    The label None stays text; what does not fit its type is null. The column
    named by ``score`` is called ``debt_score``; without a name the only column
    that ends in ``_score`` and is no dimension.
    """
    raw = spark.read.options(**_CSV).csv(path)
    scores = [c for c in raw.columns if c.endswith("_score") and c not in DIMENSION_COLUMNS]
    if score is None and len(scores) == 1:
        score = scores[0]
    columns = []
    for name in raw.columns:
        known = "debt_score" if name == score else name
        text = F.col(f"`{name}`")
        columns.append((_typed(known, text) if known in REPOSITORY_TYPES else text).alias(known))
    return raw.select(*columns)


def _flat(df: DataFrame) -> DataFrame:
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema])


def write_repositories(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Repository dataset to CSV: columns in name order, lists as JSON text."""
    _flat(df.select(*sorted(df.columns))).write.mode(mode).options(header=True, escape='"').csv(path)


def write_dataset(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Whole dataset to CSV in its own column order."""
    _flat(df).write.mode(mode).options(header=True, escape='"').csv(path)


def history_columns(df: DataFrame) -> DataFrame:
    """The columns of a history export that exist, in their fixed order."""
    return df.select(*[c for c in HISTORY_COLUMNS if c in df.columns])


def write_history(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """History export as CSV."""
    write_dataset(history_columns(df), path, mode)


def read_annotations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per reviewed repository from reviewer JSON documents."""
    documents = spark.read.schema(ANNOTATION_FILE).option("multiLine", True).json(path)
    return documents.select(F.explode("repositories").alias("r")).select("r.*")


def score_summary(scores: DataFrame, tool: str = "debtscope", score: str = "debt_score") -> DataFrame:
    """Envelope of a score export: tool, file count and mean."""
    return scores.agg(
        F.lit(tool).alias("tool"),
        F.count("*").alias("total_files"),
        round_to(F.coalesce(F.avg(score), F.lit(0.0)), 4).alias("average_score"),
    )


def write_scores(scores: DataFrame, path: str, tool: str = "debtscope", mode: str = "errorifexists") -> None:
    """Score export: one JSON row per file next to a one-row envelope, so no file list passes one task."""
    scores.write.mode(mode).json(f"{path}/files")
    score_summary(scores, tool).coalesce(1).write.mode(mode).json(f"{path}/summary")


def append_query_results(df: DataFrame, query: str, path: str) -> None:
    """Append collected rows to the master table, one folder per query slug."""
    slug = query_slug(F.col(query))
    _flat(df.withColumn("query_slug", slug)).write.mode("append").partitionBy("query_slug").parquet(path)


def read_many(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several repository datasets stacked; columns may differ."""
    frames = [read_repositories(spark, p) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
