"""Queries over commits: conversations stand for repositories, turns for commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from debtscope.catalog.registry import query
from debtscope.catalog.sql import rnd
from debtscope.functions.markers import MARKER_PATTERNS, marker_count
from debtscope.operators.provenance import (
    collection_summary,
    commit_rollup,
    control_columns,
    control_repositories,
    flatten_search_hits,
    latest_commits,
    mark_commits,
    pending_queries,
    run_summary,
)
from debtscope.operators.sampling import collection_quota, control_quota
from debtscope.plans.bindings import conversation_commits, newest_turn
from debtscope.session import table

# Patterns that occur in the given texts; the real ones are tested on messages.
PROSE_PATTERNS = (r"worthless", r"que\s+le\s", r"the\s+of\s+", r"ing,", r"und\s+(der|die)", r"\[a\]", r"ement[ .]a")
CERTAIN = "is the"

_HITS = " + ".join(f"regexp_matches(text, '(?i){p}')::INTEGER" for p in PROSE_PATTERNS)
_SIGNALS = ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{p}' END" for p in PROSE_PATTERNS)
COMMITS = f"""
marked AS (
  SELECT *, {_HITS} AS marker_count, array_to_string(list_filter([{_SIGNALS}], lambda x: x IS NOT NULL), ' | ') AS signals,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS recency
  FROM conversations
),
graded AS (
  SELECT *, CASE WHEN marker_count >= 2 OR contains(lower(text), '{CERTAIN}') THEN 'High' WHEN marker_count = 1 THEN 'Medium' ELSE 'Low' END AS confidence
  FROM marked
)
"""
_CERTAINTY = """CASE WHEN found = 0 THEN 'None' WHEN high / found >= 0.5 THEN 'High' WHEN high / found >= 0.2 THEN 'Medium' ELSE 'Low' END"""
_RATIO = "CASE WHEN found / total >= 0.20 THEN 'High' WHEN found / total >= 0.05 THEN 'Medium' WHEN found / total > 0 THEN 'Low' ELSE 'None' END"


@query(f"WITH {COMMITS} SELECT conv_id AS repo, turn, marker_count, confidence, signals FROM graded")
def commit_markers(spark: SparkSession, folder: str) -> DataFrame:
    """Marker count, confidence and signals of every commit."""
    marked = mark_commits(conversation_commits(spark, folder), PROSE_PATTERNS, CERTAIN)
    return marked.select("repo", "turn", "marker_count", "confidence", F.array_join("signals", " | ").alias("signals"))


@query(
    "SELECT conv_id AS repo, turn, "
    + " + ".join(f"regexp_matches(text, '(?i){p}')::INTEGER" for p in MARKER_PATTERNS)
    + " AS marker_count FROM conversations"
)
def assistant_markers(spark: SparkSession, folder: str) -> DataFrame:
    """The ten assistant patterns over every message."""
    return conversation_commits(spark, folder).select(
        "repo", "turn", marker_count(F.col("message"), MARKER_PATTERNS).alias("marker_count")
    )


@query(f"""
WITH {COMMITS},
totals AS (SELECT conv_id AS repo, count(*) AS total, count(*) FILTER (marker_count > 0) AS found,
  count(*) FILTER (marker_count > 0 AND confidence = 'High') AS high,
  coalesce(string_agg(turn || ':' || confidence, ',' ORDER BY recency) FILTER (marker_count > 0), '') AS marks
  FROM graded GROUP BY 1)
SELECT repo, total AS total_commits_analyzed, found AS ai_commits_found, {rnd("found / total", 4)} AS ai_commit_ratio,
  {_CERTAINTY} AS ai_confidence_level, {_RATIO} AS ai_confidence, found / total > 0.05 AS likely_ai_assisted,
  marks AS all_marks
FROM totals
""")
def commit_rollups(spark: SparkSession, folder: str) -> DataFrame:
    """Rollup of all commits of each repository with its marked ones."""
    rollup = commit_rollup(conversation_commits(spark, folder), newest_turn(), PROSE_PATTERNS, CERTAIN)
    marks = F.transform("ai_commits", lambda c: F.concat_ws(":", F.substring_index(c["sha"], "-", -1), c["confidence"]))
    return rollup.select(
        "repo",
        "total_commits_analyzed",
        "ai_commits_found",
        "ai_commit_ratio",
        "ai_confidence_level",
        "ai_confidence",
        "likely_ai_assisted",
        F.array_join(marks, ",").alias("all_marks"),
    )


@query(f"WITH {COMMITS} SELECT conv_id AS repo, turn, recency::INTEGER AS recency FROM graded WHERE recency <= 3")
def latest_commit_cut(spark: SparkSession, folder: str) -> DataFrame:
    """Three latest commits of each repository."""
    return latest_commits(conversation_commits(spark, folder), 3, newest_turn()).select("repo", "turn", "recency")


@query(f"""
WITH {COMMITS}
SELECT c_custkey AS repo, c_name AS name, 0 AS ai_commits_found, 'None' AS ai_confidence FROM customer
WHERE c_acctbal BETWEEN 500 AND 9000 AND c_custkey IN (
  SELECT conv_id FROM graded GROUP BY 1 HAVING max(marker_count) = 0)
""")
def control_group(spark: SparkSession, folder: str) -> DataFrame:
    """Customers of fitting balance whose conversation shows no marker."""
    customers = table(spark, folder, "customer").where("c_acctbal between 500 and 9000")
    candidates = customers.select(F.col("c_custkey").alias("repo"), F.col("c_name").alias("name"))
    clean = control_repositories(candidates, conversation_commits(spark, folder), newest_turn(), PROSE_PATTERNS)
    return control_columns(clean).select("repo", "name", "ai_commits_found", "ai_confidence")


@query(f"""
WITH {COMMITS}
SELECT count(*) AS total, count(*) FILTER (confidence = 'High') AS high, count(*) FILTER (confidence = 'Medium') AS medium,
  count(*) FILTER (confidence = 'Low') AS low, {rnd("avg(length(text))", 6)} AS avg_stars, {rnd("avg(turn)", 6)} AS avg_size_kb
FROM graded
""")
def collection_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Collection summary over all commits."""
    marked = mark_commits(conversation_commits(spark, folder), PROSE_PATTERNS, CERTAIN)
    return collection_summary(
        marked.select(
            F.col("confidence").alias("ai_confidence"), F.length("message").alias("stars"), F.col("turn").alias("size_kb")
        )
    )


@query(f"""
SELECT sum(CASE WHEN event_type <> 'error' THEN user_id ELSE 0 END)::BIGINT AS repositories,
  count(*) FILTER (event_type <> 'error') AS queries_completed, count(*) FILTER (event_type = 'error') AS queries_failed,
  {rnd("epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6", 4)} AS seconds,
  {rnd("sum(CASE WHEN event_type <> 'error' THEN user_id ELSE 0 END) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) * 3600", 4)} AS rows_per_hour
FROM events
""")
def run_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Run summary with rows per hour, events as finished or failed queries."""
    events = table(spark, folder, "events")
    status = F.when(F.col("event_type") == "error", "failed").otherwise("completed")
    progress = events.select(
        F.col("event_id").alias("query"),
        status.alias("status"),
        F.col("user_id").alias("rows"),
        F.col("ts").alias("started_at"),
        F.col("ts").alias("completed_at"),
    )
    totals = run_summary(progress)
    return totals.withColumns({c: F.round(c, 4) for c in ("seconds", "rows_per_hour")})


@query("""
SELECT DISTINCT user_id AS query FROM events
WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 58)
""")
def pending_work(spark: SparkSession, folder: str) -> DataFrame:
    """Users without a large purchase, as queries still to run."""
    events = table(spark, folder, "events").select(F.col("user_id").alias("query"), "event_type", "value")
    done = F.when((F.col("event_type") == "purchase") & (F.col("value") > 58), "completed")
    return pending_queries(events.select("query").distinct(), events.withColumn("status", done))


@query("""
SELECT event_type, event_id, value FROM (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= 50
  ORDER BY event_type, event_id LIMIT 120)
""")
def collection_quotas(spark: SparkSession, folder: str) -> DataFrame:
    """At most fifty rows per query and 120 in all."""
    events = table(spark, folder, "events").select("event_type", "event_id", "value")
    return collection_quota(events, "event_type", ["event_id"], 50, 120)


@query("""
WITH taken AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= 20 // 5
  ORDER BY event_type, event_id LIMIT 20)
SELECT event_type, event_id, user_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id) AS k FROM taken) WHERE k = 1
""")
def control_quotas(spark: SparkSession, folder: str) -> DataFrame:
    """Equal share per query, each user once, cut to the total."""
    events = table(spark, folder, "events").select("event_type", "event_id", "user_id")
    return control_quota(events, "event_type", ["event_id"], queries=5, total=20, key="user_id")


@query(f"""
WITH {COMMITS}
SELECT 'owner/' || conv_id AS name, CASE WHEN turn % 2 = 0 THEN turn ELSE 0 END AS stars, 'main' AS default_branch,
  false AS is_private, conv_id || '-' || turn AS ai_commit_sha, marker_count AS ai_marker_count, confidence AS ai_confidence, signals
FROM graded
""")
def flattened_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Search hits flattened to repository rows with defaults."""
    none = lambda kind: F.lit(None).cast(kind)
    stars = F.when(F.col("turn") % 2 == 0, F.col("turn"))
    repository = F.struct(
        F.concat(F.lit("owner/"), F.col("repo").cast("string")).alias("full_name"),
        *[none("string").alias(c) for c in ("html_url", "description", "language", "created_at", "updated_at", "default_branch")],
        stars.alias("stargazers_count"),
        *[none("long").alias(c) for c in ("forks_count", "size")],
        none("boolean").alias("private"),
    )
    commit = F.struct(F.col("message"), F.struct(F.col("committed_at").cast("string").alias("date")).alias("committer"))
    hits = conversation_commits(spark, folder).select("sha", commit.alias("commit"), repository.alias("repository"))
    flat = flatten_search_hits(hits, PROSE_PATTERNS, CERTAIN)
    return flat.select(
        "name", "stars", "default_branch", "is_private", "ai_commit_sha", "ai_marker_count", "ai_confidence",
        F.array_join("ai_signals", " | ").alias("signals"),
    )
