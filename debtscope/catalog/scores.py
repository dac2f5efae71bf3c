"""Queries over scored documents: composite, rollups, charts, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from debtscope.catalog.registry import query
from debtscope.catalog.sql import COHORT1, COHORT2, IS_AI, SCORED, rnd, severity_repo
from debtscope.functions.rows import round_to
from debtscope.functions.scores import checked_weights, metadata_score, score_breakdown, weighted_parts
from debtscope.operators.dataset import append_rows, browse, smallest_files
from debtscope.operators.paging import newest, page, page_info, top_files
from debtscope.operators.ranks import exact_median
from debtscope.operators.rollup import (
    cohort_description,
    dashboard_stats,
    dimension_means,
    directory_summary,
    primary_language,
    repository_rollup,
    score_histogram,
    severity_counts,
    study_plan,
    value_counts,
    value_share,
)
from debtscope.plans.bindings import document_files, scored_documents
from debtscope.session import table

DIMS = ("complexity_score", "duplication_score", "documentation_score", "error_handling_score")


def _dashboard(spark: SparkSession, folder: str) -> DataFrame:
    scored = scored_documents(spark, folder)
    return scored.withColumn("domain", F.col("repo"))


@query(f"WITH {SCORED} SELECT doc_id AS file_id, {', '.join(DIMS)}, debt_score, severity, ai_confidence FROM scored")
def composite_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Composite score of every document under the default weights."""
    return scored_documents(spark, folder).select("file_id", *DIMS, "debt_score", "severity", "ai_confidence")


@query(f"""
WITH {SCORED}
SELECT doc_id AS file_id, 0.5::DOUBLE AS complexity_weight, {rnd("0.5 * complexity_score", 4)} AS complexity_part,
  {rnd("0.25 * duplication_score", 4)} AS duplication_part, {rnd("0.125 * documentation_score", 4)} AS documentation_part,
  {rnd("0.125 * (1 - error_handling_score)", 4)} AS error_handling_part
FROM scored
""")
def score_breakdowns(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted parts of each dimension under custom weights."""
    weights = '{"complexity": 0.5, "duplication": 0.25, "documentation": 0.125, "error_handling": 0.125}'
    scored = scored_documents(spark, folder).withColumn("b", score_breakdown(*[F.col(d) for d in DIMS], weights))
    parts = [F.col(f"b.{d}.weighted").alias(f"{d}_part") for d in weighted_parts(checked_weights(), *[F.lit(0.0)] * 4)]
    return scored.select("file_id", F.col("b.complexity.weight").alias("complexity_weight"), *parts)


@query(f"""
WITH {SCORED}
SELECT source AS repo, count(*) AS files_analyzed, sum(n)::BIGINT AS total_lines,
  {rnd("sum(debt_score * n_chars) / sum(n_chars)", 6)} AS debt_score,
  {", ".join(rnd(f"sum({d} * n_chars) / sum(n_chars)", 6) + f" AS {d}" for d in DIMS)},
  {severity_repo("(sum(debt_score * n_chars) / sum(n_chars))")} AS severity
FROM scored GROUP BY source
""")
def repository_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Size-weighted rollup of all five scores by source."""
    rollup = repository_rollup(scored_documents(spark, folder))
    return rollup.select(
        "repo", "files_analyzed", "total_lines", *[round_to(F.col(c), 6).alias(c) for c in ("debt_score", *DIMS)], "severity"
    )


@query(f"""
WITH {SCORED}
SELECT count(*) AS files_analyzed, {rnd("avg(debt_score)", 4)} AS average_score, max(debt_score) AS max_score,
  min(debt_score) AS min_score, count(*) FILTER (debt_score < 0.3) AS low,
  count(*) FILTER (debt_score >= 0.3 AND debt_score < 0.6) AS medium, count(*) FILTER (debt_score >= 0.6) AS high,
  (SELECT count(*) FROM documents WHERE n_chars = 0) AS files_skipped,
  CASE WHEN avg(debt_score) > 0.6 THEN 'high' WHEN avg(debt_score) > 0.3 THEN 'medium' ELSE 'low' END AS directory_severity
FROM scored
""")
def directory_report(spark: SparkSession, folder: str) -> DataFrame:
    """One-row summary of all documents as a directory."""
    skipped = document_files(spark, folder).where("file_size = 0")
    return directory_summary(scored_documents(spark, folder), skipped)


@query("""
SELECT source AS repo, lang AS primary_language, n AS file_count FROM (
  SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r
  FROM documents GROUP BY source, lang) WHERE r = 1
""")
def primary_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Most frequent language of each source."""
    return primary_language(document_files(spark, folder))


@query("SELECT lang AS language, count(*) AS n FROM documents GROUP BY lang")
def language_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents per language."""
    return value_counts(document_files(spark, folder), "language")


@query(f"""
SELECT lang AS language, count(*) AS n, {rnd("count(*) / (SELECT count(*) FROM documents)", 6)} AS share
FROM documents GROUP BY lang
""")
def language_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each language."""
    return value_share(document_files(spark, folder), "language")


@query("SELECT DISTINCT lang AS language FROM documents")
def distinct_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Languages that occur."""
    return document_files(spark, folder).select("language").distinct()


def _as_text(column: str) -> F.Column:
    return F.array_join(
        F.transform(F.map_entries(column), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","
    )


@query(f"""
WITH {SCORED},
l AS (SELECT *, {COHORT1} AS cohort FROM scored)
SELECT a.cohort, a.total_repos, a.avg_stars, a.avg_forks, a.avg_size_kb, b.langs AS languages, c.confs AS confidences FROM
 (SELECT cohort, count(*) AS total_repos, {rnd("avg(n_chars)", 4)} AS avg_stars, {rnd("avg(n)", 4)} AS avg_forks,
   {rnd("avg(n_chars)", 4)} AS avg_size_kb FROM l GROUP BY cohort) a
 JOIN (SELECT cohort, string_agg(lang || '=' || k, ',' ORDER BY lang) AS langs FROM
   (SELECT cohort, lang, count(*) AS k FROM l GROUP BY 1, 2) GROUP BY 1) b USING (cohort)
 JOIN (SELECT cohort, string_agg(ai_confidence || '=' || k, ',' ORDER BY ai_confidence) AS confs FROM
   (SELECT cohort, ai_confidence, count(*) AS k FROM l GROUP BY 1, 2) GROUP BY 1) c USING (cohort)
""")
def cohort_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, means and value maps of both study cohorts."""
    scored = scored_documents(spark, folder).withColumns(
        {"stars": F.col("file_size"), "forks": F.col("total_lines"), "size_kb": F.col("file_size")}
    )
    out = cohort_description(scored)
    return out.select(
        "cohort",
        "total_repos",
        *[round_to(F.col(c), 4).alias(c) for c in ("avg_stars", "avg_forks", "avg_size_kb")],
        _as_text("language_distribution").alias("languages"),
        _as_text("ai_confidence_distribution").alias("confidences"),
    )


_EFFECT = """
(SELECT CASE WHEN count(*) FILTER ({ai}) > 1 AND count(*) FILTER (NOT ({ai})) > 1 THEN
  (avg(debt_score) FILTER ({ai}) - avg(debt_score) FILTER (NOT ({ai})))
  / sqrt((var_samp(debt_score) FILTER ({ai}) + var_samp(debt_score) FILTER (NOT ({ai}))) / 2) ELSE 0.0 END FROM scored)
""".format(ai=IS_AI)


@query(f"""
WITH {SCORED}
SELECT count(*) AS total_repos, count(*) FILTER ({IS_AI}) AS ai_repos, count(*) FILTER (NOT ({IS_AI})) AS human_repos,
  {rnd(f"(avg(debt_score) FILTER ({IS_AI}))", 6)} AS avg_ai_score,
  {rnd(f"(avg(debt_score) FILTER (NOT ({IS_AI})))", 6)} AS avg_human_score,
  round({_EFFECT}, 6) AS effect_size,
  (SELECT string_agg(lang || '=' || k, ',' ORDER BY lang) FROM (SELECT lang, count(*) AS k FROM scored GROUP BY 1)) AS languages
FROM scored
""")
def dashboard_figures(spark: SparkSession, folder: str) -> DataFrame:
    """Totals, cohort means, effect size and languages in one row."""
    stats = dashboard_stats(_dashboard(spark, folder))
    return stats.select(
        "total_repos",
        "ai_repos",
        "human_repos",
        *[round_to(F.col(c), 6).alias(c) for c in ("avg_ai_score", "avg_human_score")],
        F.round("effect_size", 6).alias("effect_size"),
        _as_text("languages").alias("languages"),
    )


@query(f"""
WITH {SCORED}
SELECT {COHORT2} AS cohort, least(floor(debt_score * 20), 19)::INTEGER AS bin, count(*) AS n,
  least(floor(debt_score * 20), 19) / 20 AS bin_start FROM scored GROUP BY 1, 2, 4
""")
def score_histograms(spark: SparkSession, folder: str) -> DataFrame:
    """Score histogram of both cohorts."""
    return score_histogram(_dashboard(spark, folder))


@query(f"""
WITH {SCORED},
m AS (SELECT {COHORT2} AS cohort, {", ".join(f"avg({d}) AS {d}" for d in DIMS)} FROM scored GROUP BY 1)
SELECT cohort, dimension, {rnd("mean_score", 6)} AS mean_score FROM (
  UNPIVOT m ON {", ".join(DIMS)} INTO NAME dimension VALUE mean_score)
""")
def dimension_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of each dimension per cohort."""
    return dimension_means(_dashboard(spark, folder)).withColumn("mean_score", round_to(F.col("mean_score"), 6))


@query(f"""
WITH {SCORED}
SELECT c.cohort, s.severity, count(d.severity) AS n
FROM (VALUES ('ai'), ('human')) c(cohort) CROSS JOIN (VALUES ('LOW'), ('MEDIUM'), ('HIGH')) s(severity)
LEFT JOIN (SELECT {COHORT2} AS cohort, severity FROM scored) d ON d.cohort = c.cohort AND d.severity = s.severity
GROUP BY 1, 2
""")
def severity_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Severity counts per cohort with zeros."""
    return severity_counts(_dashboard(spark, folder))


@query(f"""
WITH {SCORED}
SELECT count(*) AS total_repos, count(*) FILTER ({IS_AI}) AS ai_repos, count(*) FILTER (NOT ({IS_AI})) AS human_repos,
  count(DISTINCT lang) AS language_count, count(DISTINCT source) AS domain_count,
  {rnd("avg(debt_score)", 6)} AS overall_mean, {rnd("median(debt_score)", 6)} AS overall_median,
  {rnd(f"(avg(debt_score) FILTER ({IS_AI}))", 6)} AS ai_mean, {rnd(f"(avg(debt_score) FILTER (NOT ({IS_AI})))", 6)} AS human_mean,
  {rnd(f"abs((avg(debt_score) FILTER ({IS_AI})) - (avg(debt_score) FILTER (NOT ({IS_AI}))))", 6)} AS expected_effect,
  count(*) >= 34 AS sample_size_adequate,
  abs(count(*) FILTER ({IS_AI}) - count(*) FILTER (NOT ({IS_AI}))) <= 5 AS balance_adequate
FROM scored
""")
def study_readiness(spark: SparkSession, folder: str) -> DataFrame:
    """Study-plan figures."""
    plan = study_plan(_dashboard(spark, folder))
    rounded = ("overall_mean", "overall_median", "ai_mean", "human_mean", "expected_effect")
    return plan.withColumns({c: round_to(F.col(c), 6) for c in rounded})


@query(f"WITH {SCORED} SELECT source AS repo, {rnd('median(debt_score)', 6)} AS median FROM scored GROUP BY source")
def median_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Exact median score of each source."""
    medians = exact_median(scored_documents(spark, folder), ["repo"], "debt_score")
    return medians.withColumn("median", round_to(F.col("median"), 6))


@query(f"""
WITH {SCORED} SELECT doc_id AS file_id, source AS repo, debt_score FROM scored ORDER BY debt_score DESC, doc_id LIMIT 40
""")
def top_files_by_score(spark: SparkSession, folder: str) -> DataFrame:
    """Forty files with the highest score."""
    return top_files(scored_documents(spark, folder), tiebreak="file_id").select("file_id", "repo", "debt_score")


@query("""
SELECT doc_id AS file_id, source AS repo, n_chars AS file_size FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS r FROM documents) WHERE r <= 40
""")
def smallest_files_per_repository(spark: SparkSession, folder: str) -> DataFrame:
    """Forty smallest documents of each source."""
    return smallest_files(document_files(spark, folder), ["repo"], "file_size", "file_id").select("file_id", "repo", "file_size")


@query(f"""
WITH {SCORED}
SELECT doc_id AS file_id, lang AS language, ai_confidence, debt_score FROM scored WHERE {IS_AI} AND lang = 'en'
""")
def browse_assisted_english(spark: SparkSession, folder: str) -> DataFrame:
    """Browse filter: assisted cohort, one language."""
    return browse(_dashboard(spark, folder), "ai", "en").select("file_id", "language", "ai_confidence", "debt_score")


@query("""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40
""")
def order_page(spark: SparkSession, folder: str) -> DataFrame:
    """Third page of orders by price."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return page(orders, "o_totalprice", ["o_orderkey"], number=3)


@query("""
SELECT count(*) AS total, 3 AS page, 20 AS per_page, CAST(ceil(count(*) / 20) AS BIGINT) AS pages FROM orders
""")
def order_page_info(spark: SparkSession, folder: str) -> DataFrame:
    """Totals that go with a page."""
    return page_info(table(spark, folder, "orders"), 3, 20)


@query("SELECT event_id, ts AS created_at, event_type FROM events ORDER BY ts DESC, event_id LIMIT 20 OFFSET 20")
def history_page(spark: SparkSession, folder: str) -> DataFrame:
    """Second page of events, newest first."""
    events = table(spark, folder, "events").select("event_id", F.col("ts").alias("created_at"), "event_type")
    return newest(events, ["event_id"], number=2)


@query("""
WITH b AS (SELECT p_partkey, p_size * 500 AS size_kb, p_retailprice * 5 AS stars FROM part),
s AS (SELECT *, least(greatest(0.3 + CASE WHEN size_kb > 10000 THEN 0.2 WHEN size_kb > 1000 THEN 0.1 ELSE 0.0 END
  - CASE WHEN stars > 10000 THEN 0.1 WHEN stars > 1000 THEN 0.05 ELSE 0.0 END, 0.0), 1.0)::DOUBLE AS x FROM b)
SELECT p_partkey, round(x, 6) AS debt_score, round(x * 0.7, 6) AS complexity_score, round(x * 0.3, 6) AS duplication_score,
  round(greatest(0.2, 1 - x * 0.5), 6) AS documentation_score, round(x * 0.6, 6) AS error_handling_score,
  'github_api_fallback' AS analysis_method FROM s
""")
def metadata_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata-only score from part size and price."""
    scored = table(spark, folder, "part").select(
        "p_partkey", metadata_score(F.col("p_size") * 500, F.col("p_retailprice") * 5).alias("s")
    )
    return scored.select(
        "p_partkey", *[F.round(f"s.{c}", 6).alias(c) for c in ("debt_score", *DIMS)], F.col("s.analysis_method")
    )


@query("""
SELECT event_id, event_type, 'kept' AS origin FROM events WHERE event_type <> 'error'
UNION ALL SELECT event_id, NULL, 'new' FROM events WHERE event_type = 'error'
""")
def appended_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Dataset with analysed rows appended; their missing columns stay null."""
    events = table(spark, folder, "events")
    old = events.where("event_type <> 'error'").select("event_id", "event_type", F.lit("kept").alias("origin"))
    new = events.where("event_type = 'error'").select("event_id", F.lit("new").alias("origin"))
    return append_rows(old, new)
