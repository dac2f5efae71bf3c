"""Queries that prepare repository datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from debtscope.catalog.registry import query
from debtscope.catalog.sql import rnd
from debtscope.functions.labels import (
    PARSER_LANGUAGES,
    age_days,
    dashboard_cohort,
    language_of,
    size_tier,
    study_cohort,
)
from debtscope.functions.paths import in_skipped_blob_folder, in_skipped_tree, query_slug, repository_address
from debtscope.functions.rows import round_to
from debtscope.operators.annotations import review_forms
from debtscope.operators.dataset import (
    backfill,
    blob_candidates,
    concat_datasets,
    filter_counts,
    filter_dataset,
    history,
    keep_first,
    merge_datasets,
    number_or,
    to_moment,
    to_number,
    usable_size,
)
from debtscope.operators.rollup import validation_report
from debtscope.operators.sampling import balanced_sample, draw, not_sampled, shuffle, verification_sample
from debtscope.session import table
from debtscope.sources.datasets import history_columns

AS_OF = "1999-06-01 00:00:00"

# Orders joined to customers, as repository rows.
REPOS_SQL = """
repos AS (
  SELECT o_orderkey AS repo_id, 'repo' || o_orderkey AS url,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Python' WHEN '2-HIGH' THEN 'JavaScript' WHEN '3-MEDIUM' THEN 'TypeScript'
      WHEN '4-NOT SPECIFIED' THEN 'Go' ELSE 'Jupyter Notebook' END AS language,
    floor(o_totalprice / 8)::BIGINT AS size_kb, o_orderdate AS created_at, o_orderstatus = 'P' AS is_private,
    o_custkey % 50 AS stars, o_custkey % 7 AS forks,
    CASE WHEN o_custkey % 3 = 0 THEN 'text' END AS description,
    CASE WHEN o_custkey % 10 < 2 THEN 'High' WHEN o_custkey % 10 < 4 THEN 'Medium' WHEN o_custkey % 10 < 6 THEN 'Low' ELSE 'None' END AS ai_confidence
  FROM orders
)
"""


def order_repositories(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as repository rows."""
    languages = {"1-URGENT": "Python", "2-HIGH": "JavaScript", "3-MEDIUM": "TypeScript", "4-NOT SPECIFIED": "Go"}
    names = F.create_map(*[F.lit(x) for pair in languages.items() for x in pair])
    last = F.col("o_custkey") % 10
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("repo_id"),
        F.concat(F.lit("repo"), F.col("o_orderkey").cast("string")).alias("url"),
        F.coalesce(F.try_element_at(names, F.col("o_orderpriority")), F.lit("Jupyter Notebook")).alias("language"),
        F.floor(F.col("o_totalprice") / 8).alias("size_kb"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderstatus") == "P").alias("is_private"),
        (F.col("o_custkey") % 50).alias("stars"),
        (F.col("o_custkey") % 7).alias("forks"),
        F.when(F.col("o_custkey") % 3 == 0, "text").alias("description"),
        F.when(last < 2, "High").when(last < 4, "Medium").when(last < 6, "Low").otherwise("None").alias("ai_confidence"),
    )


_STEPS = [
    "size_kb BETWEEN 5000 AND 50000",
    "language IN ('Python', 'JavaScript', 'TypeScript', 'Jupyter Notebook')",
    f"floor((epoch(TIMESTAMP '{AS_OF}') - epoch(created_at)) / 86400) >= 365",
    "NOT is_private",
    "stars > 0",
]


@query(f"""
WITH {REPOS_SQL} SELECT repo_id, language, size_kb, stars FROM repos WHERE {" AND ".join(_STEPS)}
""")
def filtered_repositories(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that pass all quality filters."""
    kept = filter_dataset(order_repositories(spark, folder), F.lit(AS_OF).cast("timestamp"))
    return kept.select("repo_id", "language", "size_kb", "stars")


@query(
    f"WITH {REPOS_SQL} SELECT count(*) AS n_0_all, "
    + ", ".join(
        f"count(*) FILTER ({' AND '.join(_STEPS[: i + 1])}) AS n_{i + 1}_{name}"
        for i, name in enumerate(("size", "language", "age", "public", "stars"))
    )
    + " FROM repos"
)
def filter_step_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows left after each quality filter, in one pass."""
    return filter_counts(order_repositories(spark, folder), F.lit(AS_OF).cast("timestamp"))


@query(f"WITH {REPOS_SQL} SELECT repo_id, size_kb FROM repos WHERE size_kb BETWEEN 5000 AND 50000")
def control_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of usable size."""
    return usable_size(order_repositories(spark, folder)).select("repo_id", "size_kb")


@query(f"""
WITH {REPOS_SQL} SELECT repo_id, CASE WHEN size_kb > 0 AND size_kb <= 15000 THEN 'Small'
  WHEN size_kb > 15000 AND size_kb <= 35000 THEN 'Medium' WHEN size_kb > 35000 AND size_kb <= 50000 THEN 'Large' END AS size_tier,
  floor((epoch(TIMESTAMP '{AS_OF}') - epoch(created_at)) / 86400)::BIGINT AS age,
  CASE WHEN ai_confidence IN ('High', 'Medium') THEN 'ai' ELSE 'human' END AS study,
  CASE WHEN ai_confidence = 'None' THEN 'human' ELSE 'ai' END AS dashboard
FROM repos
""")
def row_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Size tier, age in days and both cohort labels of every row."""
    return order_repositories(spark, folder).select(
        "repo_id",
        size_tier(F.col("size_kb")).alias("size_tier"),
        age_days(F.col("created_at"), F.lit(AS_OF).cast("timestamp")).alias("age"),
        study_cohort(F.col("ai_confidence")).alias("study"),
        dashboard_cohort(F.col("ai_confidence")).alias("dashboard"),
    )


_AGE = f"floor((epoch(TIMESTAMP '{AS_OF}') - epoch(created_at)) / 86400)"


@query(f"""
WITH {REPOS_SQL}
SELECT count(*) AS total_repos, count(*) FILTER (ai_confidence IN ('High', 'Medium')) AS ai_repos,
  count(*) FILTER (ai_confidence IN ('Low', 'None')) AS human_repos,
  {rnd("avg(size_kb)", 4)} AS size_mean, min(size_kb)::DOUBLE AS size_min, max(size_kb)::DOUBLE AS size_max,
  round(stddev_samp(size_kb), 4) AS size_std, median(size_kb) AS size_median,
  {rnd(f"avg({_AGE})", 4)} AS age_mean, min({_AGE}) AS age_min, max({_AGE}) AS age_max, median({_AGE}) AS age_median,
  count(*) FILTER (stars > 0) AS has_stars, count(description) AS has_description,
  {rnd("avg(stars)", 4)} AS avg_stars, {rnd("avg(forks)", 4)} AS avg_forks
FROM repos
""")
def dataset_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Validation report in one row."""
    repos = order_repositories(spark, folder)
    report = validation_report(repos, age_days(F.col("created_at"), F.lit(AS_OF).cast("timestamp")))
    rounded = {c: round_to(F.col(c), 4) for c in ("size_mean", "age_mean", "avg_stars", "avg_forks")}
    return report.withColumns({**rounded, "size_std": F.round("size_std", 4)})


_DRAW = "md5('42:' || {key}::VARCHAR)"


def _sample_sql() -> str:
    draw = _DRAW.format(key="repo_id")
    return f"""
WITH {REPOS_SQL},
ai AS (SELECT repo_id, language, ai_confidence, 'ai' AS cohort FROM repos WHERE ai_confidence IN ('High', 'Medium')
  ORDER BY CASE WHEN ai_confidence = 'High' THEN 0 ELSE 1 END, {draw}, repo_id LIMIT 20),
human AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY {draw}, repo_id) AS r FROM repos WHERE ai_confidence IN ('Low', 'None')),
picked AS (SELECT repo_id, language, ai_confidence, 'human' AS cohort FROM human
  ORDER BY CASE WHEN r <= greatest(1, 20 // (SELECT count(DISTINCT language) FROM human)) THEN 0 ELSE 1 END, {draw}, repo_id LIMIT 20)
SELECT * FROM ai UNION ALL SELECT * FROM picked
"""


@query(_sample_sql())
def balanced_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty rows of each cohort."""
    sample = balanced_sample(order_repositories(spark, folder), key="repo_id")
    return sample.select("repo_id", "language", "ai_confidence", "cohort")


def _review_sql() -> str:
    draw = _DRAW.format(key="repo_id")
    return f"""
WITH {REPOS_SQL},
tiered AS (SELECT *, CASE WHEN size_kb > 0 AND size_kb <= 15000 THEN 'Small' WHEN size_kb > 15000 AND size_kb <= 35000 THEN 'Medium'
  WHEN size_kb > 35000 AND size_kb <= 50000 THEN 'Large' END AS tier FROM repos),
celled AS (SELECT *, row_number() OVER (PARTITION BY ai_confidence, language, tier ORDER BY {draw}, repo_id) = 1 AND tier IS NOT NULL AS lead FROM tiered),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ai_confidence ORDER BY CASE WHEN lead THEN 0 ELSE 1 END, {draw}, repo_id) AS r FROM celled)
SELECT repo_id, ai_confidence, language, tier AS size_tier FROM ranked
WHERE lead OR r <= 30 // (SELECT count(DISTINCT ai_confidence) FROM repos) ORDER BY ai_confidence, r LIMIT 30
"""


@query(_review_sql())
def verification_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Thirty rows for manual review."""
    sample = verification_sample(order_repositories(spark, folder), n=30)
    return sample.select("repo_id", "ai_confidence", "language", "size_tier")


@query(f"""
SELECT repo_id, '' AS name, url, language, size_kb, 0.0::DOUBLE AS ai_commit_ratio, ai_confidence AS ai_confidence_auto, 0 AS evidence, TRUE AS blank
FROM (WITH {REPOS_SQL} SELECT * FROM repos)
""")
def review_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Blank review entry of every row."""
    repos = order_repositories(spark, folder).withColumns({"name": F.lit(None).cast("string"), "ai_commit_ratio": F.lit(None).cast("double")})
    forms = review_forms(repos)
    return forms.select(
        "repo_id", "name", "url", "language", "size_kb", "ai_commit_ratio", "ai_confidence_auto",
        F.size("verification.ai_identification_evidence").alias("evidence"),
        (F.col("verification.ai_identification_score").isNull() & F.col("verification.debt_severity_scores.complexity").isNull()).alias("blank"),
    )


@query(f"""
SELECT part_ord, p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY {_DRAW.format(key='p_partkey')}, p_partkey)::INTEGER AS part_ord FROM part)
WHERE part_ord <= 25
""")
def shuffled_head(spark: SparkSession, folder: str) -> DataFrame:
    """First rows of a reproducible shuffle of all parts, with their place."""
    head = shuffle(table(spark, folder, "part").select("p_partkey"), "p_partkey").limit(25)
    place = F.row_number().over(W.orderBy(draw("p_partkey"), "p_partkey"))
    return head.select(place.alias("part_ord"), "p_partkey")


@query(f"""
WITH {REPOS_SQL}, s AS (SELECT repo_id FROM repos ORDER BY {_DRAW.format(key="repo_id")}, repo_id LIMIT 40)
SELECT repo_id FROM repos WHERE repo_id NOT IN (SELECT repo_id FROM s)
""")
def rows_left_out(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that a forty-row draw left out."""
    repos = order_repositories(spark, folder)
    return not_sampled(repos, shuffle(repos, "repo_id").limit(40), "repo_id").select("repo_id")


@query("""
SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, 0 AS source_ord FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, 1 FROM supplier
""")
def stacked_datasets(spark: SparkSession, folder: str) -> DataFrame:
    """Customers and suppliers stacked although their columns differ."""
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    suppliers = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )
    return concat_datasets([customers, suppliers])


@query("""
WITH a AS (SELECT 'n' || c_nationkey || '-' || c_custkey % 40 AS url, 0 AS source_ord, c_custkey AS row_ord FROM customer
  UNION ALL SELECT 'n' || s_nationkey || '-' || s_suppkey % 40, 1, s_suppkey FROM supplier)
SELECT url, source_ord, row_ord FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY source_ord, row_ord) AS r FROM a) WHERE r = 1
""")
def merged_datasets(spark: SparkSession, folder: str) -> DataFrame:
    """Two datasets merged, first row of each address kept."""
    def address(nation: str, key: str) -> F.Column:
        return F.concat(F.lit("n"), F.col(nation), F.lit("-"), F.col(key) % 40)

    customers = table(spark, folder, "customer").select(address("c_nationkey", "c_custkey").alias("url"), F.col("c_custkey").alias("row_ord"))
    suppliers = table(spark, folder, "supplier").select(address("s_nationkey", "s_suppkey").alias("url"), F.col("s_suppkey").alias("row_ord"))
    return merge_datasets([customers, suppliers])


@query("SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY md5(text)")
def first_copies(spark: SparkSession, folder: str) -> DataFrame:
    """First document of each text."""
    docs = table(spark, folder, "documents").select("doc_id", F.md5("text").alias("digest"))
    return keep_first(docs, ["digest"], ["doc_id"])


@query(r"""
SELECT page_id, nullif(regexp_extract(url, 'example\.(com|net|org)/([^/]+)/([^/]+?)(\.git)?/?$', 2), '') AS owner,
  replace(nullif(regexp_extract(url, 'example\.(com|net|org)/([^/]+)/([^/]+?)(\.git)?/?$', 3), ''), '.git', '') AS repo,
  CASE WHEN regexp_matches(url, 'example\.(com|net|org)/([^/]+)/([^/]+?)(\.git)?/?$') THEN 'main' END AS branch
FROM pages
""")
def page_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """Owner and repository parts of page addresses."""
    address = repository_address(F.col("url"), host=r"example\.(?:com|net|org)")
    parsed = table(spark, folder, "pages").select("page_id", address.alias("a"))
    return parsed.select("page_id", "a.owner", "a.repo", "a.branch")


_EXTENSIONS = (".py", ".JS", ".ts", ".tsx", ".rs", ".md", "")
_EXT_SQL = "['" + "', '".join(_EXTENSIONS) + "']"
_LANG_SQL = "CASE lower(ext) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PARSER_LANGUAGES.items()) + " END"
_PATH_SQL = f"""
paths AS (
  SELECT p_partkey, ({_EXT_SQL})[p_partkey % 7 + 1] AS ext,
    (['src', '.hidden', 'node_modules', 'lib', 'vendor'])[p_partkey % 5 + 1] || '/' || p_brand || '/' || replace(p_name, ' ', '_') || ({_EXT_SQL})[p_partkey % 7 + 1] AS path
  FROM part
)
"""


def part_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as repository paths."""
    roots = F.array(*[F.lit(x) for x in ("src", ".hidden", "node_modules", "lib", "vendor")])
    ends = F.array(*[F.lit(x) for x in _EXTENSIONS])
    return table(spark, folder, "part").select(
        "p_partkey",
        F.concat(
            F.get(roots, F.col("p_partkey") % 5), F.lit("/"), "p_brand", F.lit("/"), F.translate("p_name", " ", "_"),
            F.get(ends, F.col("p_partkey") % 7),
        ).alias("path"),
        "p_brand",
        "p_size",
    )


@query(f"""
WITH {_PATH_SQL}
SELECT p_partkey, path, {_LANG_SQL} AS language, split_part(path, '/', 1) = 'node_modules' AS tree_skip,
  split_part(path, '/', 1) IN ('.hidden', 'node_modules', 'vendor') AS blob_skip
FROM paths
""")
def path_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Language and skip flags of every path."""
    path = F.col("path")
    return part_paths(spark, folder).select(
        "p_partkey",
        "path",
        language_of(path).alias("language"),
        in_skipped_tree(path).alias("tree_skip"),
        in_skipped_blob_folder(path).alias("blob_skip"),
    )


@query(f"""
WITH {_PATH_SQL},
blobs AS (SELECT q.p_partkey, p.p_brand AS repo, q.path, p.p_size * 4000 AS size,
  CASE lower(ext) WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' END AS language
  FROM paths q JOIN part p USING (p_partkey) WHERE p.p_partkey % 11 <> 0),
shown AS (SELECT * FROM blobs WHERE language IS NOT NULL AND split_part(path, '/', 1) NOT IN ('.hidden', 'node_modules', 'vendor'))
SELECT repo, path, size, language FROM shown
""")
def scorable_blobs(spark: SparkSession, folder: str) -> DataFrame:
    """All scorable blobs of each repository."""
    kind = F.when(F.col("p_partkey") % 11 == 0, "tree").otherwise("blob")
    blobs = part_paths(spark, folder).select(
        F.col("p_brand").alias("repo"), "path", (F.col("p_size") * 4000).alias("size"), kind.alias("type")
    )
    return blob_candidates(blobs).select("repo", "path", "size", "language")


@query("""
SELECT event_id, json_extract(props, '$.k')::DOUBLE AS k, try_cast(event_type AS DOUBLE) AS not_a_number,
  coalesce(try_cast(event_type AS DOUBLE), -1.0) AS with_default, try_cast(ts::VARCHAR AS TIMESTAMP) AS moment,
  try_cast(event_type AS TIMESTAMP) AS not_a_moment
FROM events
""")
def tolerant_casts(spark: SparkSession, folder: str) -> DataFrame:
    """Text to numbers and timestamps, null or a default where it is none."""
    return table(spark, folder, "events").select(
        "event_id",
        to_number(F.get_json_object("props", "$.k")).alias("k"),
        to_number(F.col("event_type")).alias("not_a_number"),
        number_or(F.col("event_type"), -1.0).alias("with_default"),
        to_moment(F.col("ts").cast("string")).alias("moment"),
        to_moment(F.col("event_type")).alias("not_a_moment"),
    )


@query("""
SELECT d.doc_id, CASE WHEN l.quality = 0 THEN 'None' ELSE 'High' END AS ai_confidence, 'static' AS source,
  'dataset' AS analysis_method, '' AS created_at, coalesce(l.toxic, 0)::DOUBLE AS debt_score, 'LOW' AS severity
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def backfilled_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Missing dashboard columns added and filled."""
    docs = table(spark, folder, "documents").select("doc_id")
    labels = table(spark, folder, "labels")
    typed = docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.when(F.col("quality") == 0, "Human").otherwise("AI").alias("type"),
        F.col("toxic").alias("debt_score"),
        F.lit(None).cast("string").alias("severity"),
    )
    return backfill(typed).drop("type")


@query("""
SELECT event_id, event_type AS name, CASE WHEN value > 20 THEN 'high' WHEN value > 8 THEN 'medium' ELSE 'low' END AS severity
FROM events WHERE user_id % 2 = 0 AND value > 8 AND value <= 20 AND (contains(event_type, 'ic') OR contains(props, '"k": 1'))
""")
def history_rows(spark: SparkSession, folder: str) -> DataFrame:
    """History filter by origin, severity and search."""
    value = F.col("value")
    rows = table(spark, folder, "events").select(
        "event_id",
        F.col("event_type").alias("name"),
        F.when(F.col("props").contains('"k": 1'), "MAGIC").otherwise("plain").alias("url"),
        F.when(value > 20, "high").when(value > 8, "medium").otherwise("low").alias("severity"),
        F.when(F.col("user_id") % 2 == 0, "quick_analysis").otherwise("static").alias("source"),
    )
    return history(rows, severity="medium", search=" Ic ").select("event_id", "name", "severity")


@query("""
SELECT event_type AS name, props AS url, value AS debt_score, event_id AS files_analyzed, ts AS created_at FROM events
""")
def history_export_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a history export: known columns only, in their fixed order."""
    events = table(spark, folder, "events").select(
        F.col("ts").alias("created_at"),
        F.col("event_id").alias("files_analyzed"),
        F.col("value").alias("debt_score"),
        F.col("props").alias("url"),
        F.col("event_type").alias("name"),
        "user_id",
    )
    return history_columns(events)


@query(r"""
SELECT substr(replace(replace(replace(event_type || ': "k" ' || props, '"', ''), ':', '_'), ' ', '_'), 1, 50) || '-' ||
  substr(md5(event_type || ': "k" ' || props), 1, 8) AS slug, count(*) AS n
FROM events GROUP BY 1
""")
def query_slugs(spark: SparkSession, folder: str) -> DataFrame:
    """File-name slug of every query text with its rows."""
    text = F.concat("event_type", F.lit(': "k" '), "props")
    return table(spark, folder, "events").groupBy(query_slug(text).alias("slug")).agg(F.count("*").alias("n"))
