"""Commit markers, repository rollups of commits and the control group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from debtscope.functions.markers import (
    CERTAIN_WORDING,
    MARKER_PATTERNS,
    certainty_confidence,
    commit_confidence,
    likely_assisted,
    marker_count,
    marker_signals,
    ratio_confidence,
)
from debtscope.functions.rows import ratio, round_to


def latest_commits(commits: DataFrame, limit: int | None, order: Sequence[Column]) -> DataFrame:
    """The newest ``limit`` commits of each repository, with their rank.

    The rank filter becomes a group limit that runs before the shuffle, so a
    repository with very many commits sends only ``limit`` rows per task.
    Without a limit all commits are returned, unranked and unmoved.
    """
    if limit is None:
        return commits
    newest = W.partitionBy("repo").orderBy(*order)
    return commits.withColumn("recency", F.row_number().over(newest)).where(F.col("recency") <= limit)


def mark_commits(
    commits: DataFrame, patterns: Sequence[str] = MARKER_PATTERNS, certain: str = CERTAIN_WORDING
) -> DataFrame:
    """Add marker count, confidence and the list of signals to each commit."""
    message = F.col("message")
    return (
        commits.withColumn("marker_count", marker_count(message, patterns))
        .withColumn("confidence", commit_confidence(message, F.col("marker_count"), certain))
        .withColumn("signals", marker_signals(message, patterns))
    )


def commit_rollup(
    commits: DataFrame,
    order: Sequence[Column],
    patterns: Sequence[str] = MARKER_PATTERNS,
    certain: str = CERTAIN_WORDING,
    limit: int | None = None,
    kept: int | None = None,
) -> DataFrame:
    """One row per repository from its commits: counts, ratio, confidences, marked commits from the newest on.

    ``limit`` looks at the latest commits only, ``kept`` lists the first marked
    ones only; by default all are read and listed.
    """
    marked = mark_commits(latest_commits(commits, limit, order), patterns, certain)
    hit = F.col("marker_count") > 0
    counts = marked.groupBy("repo").agg(
        F.count("*").alias("total_commits_analyzed"),
        F.count_if(hit).alias("ai_commits_found"),
        F.count_if(hit & (F.col("confidence") == "High")).alias("high_commits"),
    )
    ranks = F.row_number().over(W.partitionBy("repo").orderBy(*order))
    listed = marked.where(hit).withColumn("recency", ranks)
    if kept is not None:
        listed = listed.where(F.col("recency") <= kept)
    record = F.struct(
        "recency", "sha", "message", F.col("committed_at").alias("date"), "marker_count", "confidence", "signals"
    )
    lists = listed.groupBy("repo").agg(F.sort_array(F.collect_list(record)).alias("ranked"))
    none = F.array().cast(lists.schema["ranked"].dataType)
    totals = counts.join(lists, "repo", "left").withColumn("ranked", F.coalesce("ranked", none))
    share = ratio(F.col("ai_commits_found"), F.col("total_commits_analyzed"))
    return totals.select(
        "repo",
        "total_commits_analyzed",
        "ai_commits_found",
        "high_commits",
        round_to(share, 4).alias("ai_commit_ratio"),
        certainty_confidence(F.col("high_commits"), F.col("ai_commits_found")).alias("ai_confidence_level"),
        F.transform("ranked", lambda r: r.dropFields("recency")).alias("ai_commits"),
        likely_assisted(share).alias("likely_ai_assisted"),
        ratio_confidence(share).alias("ai_confidence"),
    )


def control_repositories(
    repositories: DataFrame,
    commits: DataFrame,
    order: Sequence[Column],
    patterns: Sequence[str] = MARKER_PATTERNS,
    limit: int | None = None,
) -> DataFrame:
    """Repositories whose commits show no marker; those without commits are unknown and left out.

    ``limit`` looks at the latest commits only.
    """
    recent = latest_commits(commits, limit, order)
    clean = (
        recent.groupBy("repo")
        .agg(F.max(marker_count(F.col("message"), patterns)).alias("markers"))
        .where("markers = 0")
        .select("repo")
    )
    return repositories.join(clean, "repo", "left_semi")


def control_columns(repositories: DataFrame, query: str | None = None) -> DataFrame:
    """Columns a control repository carries: no marked commits, confidence None."""
    return repositories.withColumns(
        {
            "ai_commits_found": F.lit(0),
            "ai_commit_ratio": F.lit(0.0),
            "ai_confidence": F.lit("None"),
            "ai_confidence_level": F.lit("None"),
            "likely_ai_assisted": F.lit(False),
            "total_commits_analyzed": F.lit(0),
            "search_query": F.lit(query or ""),
            "repo_type": F.lit("human_control"),
        }
    )


def flatten_search_hits(
    hits: DataFrame, patterns: Sequence[str] = MARKER_PATTERNS, certain: str = CERTAIN_WORDING
) -> DataFrame:
    """Repository rows from landed commit-search records (``repository``, ``commit``, ``sha``)."""
    repo = lambda name, default: F.coalesce(F.col(f"repository.{name}"), F.lit(default))
    message = F.coalesce(F.col("commit.message"), F.lit(""))
    flat = hits.select(
        repo("full_name", "").alias("name"),
        repo("html_url", "").alias("url"),
        repo("description", "").alias("description"),
        repo("language", "").alias("language"),
        repo("stargazers_count", 0).alias("stars"),
        repo("forks_count", 0).alias("forks"),
        repo("created_at", "").alias("created_at"),
        repo("updated_at", "").alias("updated_at"),
        repo("size", 0).alias("size_kb"),
        repo("private", False).alias("is_private"),
        repo("default_branch", "main").alias("default_branch"),
        F.coalesce("sha", F.lit("")).alias("ai_commit_sha"),
        message.alias("ai_commit_message"),
        F.coalesce("commit.committer.date", F.lit("")).alias("ai_commit_date"),
    )
    text = F.col("ai_commit_message")
    return (
        flat.withColumn("ai_marker_count", marker_count(text, patterns))
        .withColumn("ai_confidence", commit_confidence(text, F.col("ai_marker_count"), certain))
        .withColumn("ai_signals", marker_signals(text, patterns))
    )


def collection_summary(repositories: DataFrame) -> DataFrame:
    """Total and per-confidence counts with mean stars and size."""
    level = F.col("ai_confidence")
    return repositories.agg(
        F.count("*").alias("total"),
        F.count_if(level == "High").alias("high"),
        F.count_if(level == "Medium").alias("medium"),
        F.count_if(level == "Low").alias("low"),
        round_to(F.avg("stars"), 6).alias("avg_stars"),
        round_to(F.avg("size_kb"), 6).alias("avg_size_kb"),
    )


def run_summary(progress: DataFrame) -> DataFrame:
    """Run figures from a progress table (query, status, rows, started_at, completed_at): rows per hour."""
    done = F.col("status") == "completed"
    totals = progress.agg(
        F.sum(F.when(done, F.col("rows")).otherwise(0)).alias("repositories"),
        F.count_if(done).alias("queries_completed"),
        F.count_if(F.col("status") == "failed").alias("queries_failed"),
        (F.unix_micros(F.max("completed_at").cast("timestamp")) - F.unix_micros(F.min("started_at").cast("timestamp"))).alias("micros"),
    )
    seconds = F.col("micros") / 1e6
    return totals.select(
        "repositories",
        "queries_completed",
        "queries_failed",
        round_to(seconds, 6).alias("seconds"),
        round_to(F.when(seconds > 0, F.col("repositories") / seconds * 3600), 6).alias("rows_per_hour"),
    )


def pending_queries(queries: DataFrame, progress: DataFrame) -> DataFrame:
    """Queries not yet recorded as completed."""
    done = progress.where("status = 'completed'").select("query").distinct()
    return queries.join(done, "query", "left_anti")
