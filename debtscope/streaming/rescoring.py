"""Files scored again each time they are saved."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from debtscope.operators.dataset import keep_first
from debtscope.plans.scoring import score_by_size

# A save event: path, language, content and the time it was saved.
SAVES = "path string, language string, content string, saved_at timestamp"


def saved_files(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of save events landed as parquet files."""
    reader = spark.readStream.schema(SAVES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def latest_scores(batch: DataFrame, score: Callable[[DataFrame], DataFrame] = score_by_size) -> DataFrame:
    """Newest save of each path in a batch, scored.

    A save is known by its path and time; what it says plays no part, so a save
    that brings back earlier content counts, and a repeated delivery is scored
    to the same row.
    """
    return score(keep_first(batch, ["path"], [F.col("saved_at").desc(), F.md5("content")]))


def _read(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.parquet(folder)
    except AnalysisException:
        return None


def current_scores(spark: SparkSession, target: str) -> DataFrame:
    """Latest score of every path: the newest compaction and the batches since."""
    batches, base = spark.read.parquet(f"{target}/batches"), _read(spark, f"{target}/compacted")
    if base is not None:
        upto = base.agg(F.max("upto")).first()[0]
        since = batches.where(F.col("batch") > upto)
        batches = since.unionByName(base.where(F.col("upto") == upto).drop("upto"))
    return keep_first(batches, ["path"], [F.col("saved_at").desc(), F.col("batch").desc()])


def compact_scores(spark: SparkSession, target: str) -> None:
    """Write the latest score of every path as one table that later reads start from.

    Batches up to its number are not read any more; files are only added.
    """
    upto = spark.read.parquet(f"{target}/batches").agg(F.max("batch")).first()[0]
    current_scores(spark, target).write.mode("overwrite").parquet(f"{target}/compacted/upto={upto}")


def start_rescoring(
    saves: DataFrame, target: str, checkpoint: str, score: Callable[[DataFrame], DataFrame] = score_by_size, **trigger: object
) -> StreamingQuery:
    """Write the scores of each batch under its own number.

    A batch that is retried after a failure replaces its own folder, so every
    save is written once; readers take the newest row per path.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = latest_scores(batch, score)
        rows.write.mode("overwrite").parquet(f"{target}/batches/batch={number}")

    return (
        saves.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
