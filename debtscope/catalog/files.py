"""Queries that go through files and streams and read back what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from debtscope.catalog.datasets import REPOS_SQL, order_repositories
from debtscope.catalog.registry import query
from debtscope.catalog.sql import SCORED, lines, rnd, severity_repo, strip
from debtscope.functions.rows import round_to
from debtscope.plans.bindings import scored_documents
from debtscope.session import landed, table, work_path
from debtscope.sources.datasets import (
    append_query_results,
    read_repositories,
    score_summary,
    write_dataset,
    write_history,
    write_repositories,
    write_scores,
)
from debtscope.streaming.live_stats import analyses, live_figures, start_append, start_moments
from debtscope.streaming.rescoring import compact_scores, current_scores, saved_files, start_rescoring


@query(f"""
WITH {REPOS_SQL} SELECT repo_id::INTEGER AS repo_id, url, language, size_kb, is_private, description, ai_confidence,
  'a,b' AS signals FROM repos
""")
def repository_files(spark: SparkSession, folder: str) -> DataFrame:
    """Repository dataset written as CSV with an encoded list column, and read back typed."""
    path = work_path(spark, "repositories")
    signals = F.array(F.lit("a"), F.lit("b"))
    write_repositories(order_repositories(spark, folder).drop("created_at").withColumn("ai_signals", signals), path)
    return read_repositories(spark, path).select(
        "repo_id", "url", "language", "size_kb", "is_private", "description", "ai_confidence",
        F.array_join("ai_signals", ",").alias("signals"),
    )


@query(f"WITH {SCORED} SELECT source AS name, count(*) AS n, round(sum(debt_score), 4) AS total FROM scored GROUP BY 1")
def exported_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Whole dataset exported as CSV and summed from the export."""
    path = work_path(spark, "export")
    write_dataset(scored_documents(spark, folder).withColumnRenamed("repo", "name"), path)
    exported = read_repositories(spark, path)
    return exported.groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("debt_score"), 4).alias("total"))


@query("SELECT event_type AS name, value AS debt_score, count(*) AS n FROM events GROUP BY 1, 2")
def exported_history(spark: SparkSession, folder: str) -> DataFrame:
    """History export written and read back."""
    path = work_path(spark, "history")
    events = table(spark, folder, "events").select("user_id", F.col("value").alias("debt_score"), F.col("event_type").alias("name"))
    write_history(events, path)
    return read_repositories(spark, path).groupBy("name", "debt_score").agg(F.count("*").alias("n"))


@query(f"""
WITH {SCORED} SELECT 'debtscope' AS tool, count(*) AS total_files, {rnd("avg(debt_score)", 4)} AS average_score FROM scored
""")
def score_envelope(spark: SparkSession, folder: str) -> DataFrame:
    """Envelope of a score export."""
    return score_summary(scored_documents(spark, folder))


@query(f"WITH {SCORED} SELECT severity, count(*) AS n, max(debt_score) AS top FROM scored GROUP BY 1")
def exported_records(spark: SparkSession, folder: str) -> DataFrame:
    """Per-file JSON records of a score export, read back."""
    path = work_path(spark, "scores")
    write_scores(scored_documents(spark, folder), path)
    back = spark.read.schema("severity string, debt_score double").json(f"{path}/files")
    return back.groupBy("severity").agg(F.count("*").alias("n"), F.max("debt_score").alias("top"))


@query("SELECT 'type_' || event_type || '-' || substr(md5('type:' || event_type), 1, 8) AS query_slug, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def master_table(spark: SparkSession, folder: str) -> DataFrame:
    """Events appended in two runs to a master table by query slug."""
    path = work_path(spark, "master")
    events = table(spark, folder, "events").withColumn("query", F.concat(F.lit("type:"), "event_type"))
    append_query_results(events.where("value > 20"), "query", path)
    append_query_results(events.where("value <= 20"), "query", path)
    return spark.read.parquet(path).groupBy("query_slug").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query(f"""
WITH f AS (SELECT doc_id, text, len({lines("text")}) AS n FROM documents WHERE {strip("text")} <> '' AND doc_id % 3 <> 1),
s AS (SELECT *, (least(0.8, n / 1000) + 0.2 + 0.5 + 0.3) / 4 AS d FROM f)
SELECT 'doc/' || doc_id AS path, n::INTEGER AS total_lines, {rnd("d", 6)} AS debt_score, {severity_repo("d")} AS severity
FROM s WHERE true
UNION ALL
SELECT 'doc/' || doc_id, len({lines("text || chr(10) || 'x'")})::INTEGER,
  {rnd(f"(least(0.8, len({lines("text || chr(10) || 'x'")}) / 1000) + 1.0) / 4", 6)}, 'LOW' FROM documents WHERE doc_id % 3 = 1
""")
def streamed_scores(spark: SparkSession, folder: str) -> DataFrame:
    """All documents saved as a stream, two thirds saved again with a change and half of those put back: latest score per path."""

    def build() -> DataFrame:
        docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
        path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path")
        first = docs.select(path, F.lit("python").alias("language"), F.col("text").alias("content"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("saved_at"))
        changed = docs.where("doc_id % 3 > 0").select(
            path, F.lit("python").alias("language"), F.concat("text", F.lit("\nx")).alias("content"), F.lit("2024-01-01 00:01:00").cast("timestamp").alias("saved_at")
        )
        put_back = first.where("cast(substr(path, 5) as long) % 3 = 2").withColumn("saved_at", F.lit("2024-01-01 00:02:00").cast("timestamp"))
        return first.unionByName(changed).unionByName(put_back)

    landed(spark, folder, "saves", build)
    source = _folder_of(spark, folder, "saves")
    target, state = work_path(spark, "rescored"), work_path(spark, "rescoring-state")
    start_rescoring(saved_files(spark, source), target, state).awaitTermination()
    compact_scores(spark, target)
    return current_scores(spark, target).select("path", "total_lines", round_to(F.col("debt_score"), 6).alias("debt_score"), "severity")


def _folder_of(spark: SparkSession, folder: str, name: str) -> str:
    return landed(spark, folder, name, lambda: spark.range(0)).inputFiles()[0].rsplit("/", 1)[0]


@query("""
WITH a AS (SELECT event_type <> 'view' AS ai, (value - floor(value)) AS s FROM events)
SELECT count(*) AS total_repos, count(*) FILTER (ai) AS ai_repos, count(*) FILTER (NOT ai) AS human_repos,
  round(avg(s) FILTER (ai), 6) AS avg_ai_score, round(avg(s) FILTER (NOT ai), 6) AS avg_human_score,
  round((avg(s) FILTER (ai) - avg(s) FILTER (NOT ai)) / sqrt((var_samp(s) FILTER (ai) + var_samp(s) FILTER (NOT ai)) / 2), 6) AS effect_size,
  count(*) AS stored
FROM a
""")
def streamed_figures(spark: SparkSession, folder: str) -> DataFrame:
    """Events streamed in as analyses: stored rows and cohort figures kept up to date."""

    def build() -> DataFrame:
        return table(spark, folder, "events").select(
            F.col("event_id").cast("string").alias("url"),
            F.when(F.col("event_type") == "view", "None").when(F.col("event_type") == "click", "High").alias("ai_confidence"),
            F.lit("go").alias("language"),
            (F.col("value") - F.floor("value")).alias("debt_score"),
            F.col("ts").cast("timestamp").alias("created_at"),
        )

    landed(spark, folder, "analyses", build)
    rows = analyses(spark, _folder_of(spark, folder, "analyses"))
    data, moments = work_path(spark, "history-data"), work_path(spark, "moments")
    start_append(rows, data, work_path(spark, "append-state")).awaitTermination()
    start_moments(rows, moments, work_path(spark, "moments-state")).awaitTermination()
    stored = spark.read.parquet(data).agg(F.count("*")).scalar()
    figures = live_figures(spark, moments)
    rounded = {c: F.round(c, 6) for c in ("avg_ai_score", "avg_human_score", "effect_size")}
    return figures.withColumns({**rounded, "stored": stored})
