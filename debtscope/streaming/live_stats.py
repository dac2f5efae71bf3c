"""Analyses appended as they arrive, with cohort figures kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from debtscope.operators.rollup import cohort_moments, effect_of_moments

# One finished analysis.
ANALYSES = "url string, ai_confidence string, language string, debt_score double, created_at timestamp"


def analyses(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of analyses landed as parquet files, marked as runtime rows."""
    reader = spark.readStream.schema(ANALYSES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.parquet(folder)
    return rows.withColumn("source", F.lit("quick_analysis")).withColumn(
        "ai_confidence", F.coalesce("ai_confidence", F.lit("High"))
    )


def start_append(rows: DataFrame, target: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Append analyses to the dataset, each once."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", target)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def start_moments(rows: DataFrame, target: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Keep count, sum and sum of squares per cohort; the state is one row per cohort.

    Each batch writes its figures to a folder of its own, so readers never meet
    a half-written one; a batch that is retried replaces its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = cohort_moments(rows).writeStream.outputMode("complete").foreachBatch(write)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def live_figures(spark: SparkSession, target: str) -> DataFrame:
    """Counts, means and effect size from the moments of the newest batch."""
    kept = spark.read.parquet(target)
    newest = kept.agg(F.max("batch")).scalar()
    return effect_of_moments(kept.where(F.col("batch") == newest).drop("batch"))
