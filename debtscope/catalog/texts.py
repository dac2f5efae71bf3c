"""Queries over document texts: lines, comments, duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from debtscope.catalog.registry import query
from debtscope.catalog.sql import DOCUMENT_LINES, clamp, rnd, severity_repo, strip
from debtscope.functions.labels import severity
from debtscope.functions.rows import round_to
from debtscope.functions.scores import content_size_score
from debtscope.functions.text import byte_span, line_count
from debtscope.operators.duplication import duplicate_blocks, file_duplication, repeated_windows, scoped_duplication, shared_blocks
from debtscope.operators.nodes import comments_of
from debtscope.operators.rollup import repository_rollup
from debtscope.plans.bindings import document_files
from debtscope.session import table
from debtscope.sources.code import blob_texts

_ROLLUP = f"""
WITH {DOCUMENT_LINES},
files AS (
  SELECT source, n, d, n_chars::DOUBLE AS w,
    CASE WHEN n = 0 THEN 0.0 ELSE {rnd(clamp("(pct - 3) / 22"), 4)} END AS dscore,
    least(0.8, n / 1000) AS c
  FROM dup
),
totals AS (
  SELECT source AS repo, count(*) AS files_analyzed, sum(n)::BIGINT AS total_lines, sum(d)::BIGINT AS duplicated_lines,
    sum((c + 0.2 + 0.5 + 0.3) / 4 * w) / sum(w) AS debt, sum(c * w) / sum(w) AS c, sum(dscore * w) / sum(w) AS dd
  FROM files GROUP BY source
)
SELECT repo, files_analyzed, total_lines, duplicated_lines,
  {rnd("debt", 6)} AS debt_score, {rnd("c", 6)} AS complexity_score, {rnd("dd", 6)} AS measured_duplication,
  {severity_repo("debt")} AS severity
FROM totals
"""


@query(_ROLLUP)
def repository_debt(spark: SparkSession, folder: str) -> DataFrame:
    """Texts to lines, repeated blocks, content-size score, weighted repository rollup and severity."""
    files = file_duplication(document_files(spark, folder))
    scored = files.withColumn("s", content_size_score(F.col("total_lines"), F.col("file_size"))).select(
        "repo",
        "file_size",
        "total_lines",
        "duplicated_lines",
        "duplication_score",
        "s.debt_score",
        "s.complexity_score",
        "s.documentation_score",
        "s.error_handling_score",
    )
    return repository_rollup(scored, more_sums=["duplicated_lines"]).select(
        "repo",
        "files_analyzed",
        "total_lines",
        "duplicated_lines",
        round_to(F.col("debt_score"), 6).alias("debt_score"),
        round_to(F.col("complexity_score"), 6).alias("complexity_score"),
        round_to(F.col("duplication_score"), 6).alias("measured_duplication"),
        "severity",
    )


@query(f"""
WITH {DOCUMENT_LINES}
SELECT doc_id AS file_id, n AS total_lines, d AS duplicated_lines, pct AS duplication_percent,
  CASE WHEN n = 0 THEN 0.0 ELSE {rnd(clamp("(pct - 3) / 22"), 4)} END AS duplication_score
FROM dup
""")
def duplication_by_file(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated lines, percent and duplication score of every document."""
    return file_duplication(document_files(spark, folder)).select(
        "file_id",
        F.col("total_lines").cast("long").alias("total_lines"),
        F.col("duplicated_lines").cast("long").alias("duplicated_lines"),
        "duplication_percent",
        "duplication_score",
    )


@query(f"""
WITH {DOCUMENT_LINES}
SELECT doc_id AS file_id, hash, array_to_string(list(pos ORDER BY pos), ',') AS positions, count(*) AS occurrences,
  6::BIGINT AS line_count, array_to_string(arg_min(rw, pos), chr(10)) AS sample_text
FROM repeats GROUP BY doc_id, hash
""")
def duplicate_block_list(spark: SparkSession, folder: str) -> DataFrame:
    """Every repeated block with positions, count and sample."""
    blocks = duplicate_blocks(document_files(spark, folder))
    return blocks.select(
        "file_id",
        "hash",
        F.array_join("positions", ",").alias("positions"),
        "occurrences",
        F.col("line_count").cast("long").alias("line_count"),
        "sample_text",
    )


_SCOPED = """
WITH {lines}, scoped AS (SELECT g.*, source FROM good g JOIN doc_lines USING (doc_id)),
often AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY {keys}) AS n FROM scoped) WHERE n > 1),
hit AS (SELECT doc_id, count(DISTINCT pos + k) AS d FROM often, range(6) AS t(k) GROUP BY doc_id)
SELECT doc_id AS file_id, len(ls)::BIGINT AS total_lines, coalesce(d, 0)::BIGINT AS duplicated_lines FROM doc_lines LEFT JOIN hit USING (doc_id)
"""


@query(_SCOPED.format(lines=DOCUMENT_LINES, keys="source, hash"))
def duplication_in_repositories(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of every document in blocks that its source holds elsewhere too."""
    return scoped_duplication(document_files(spark, folder), "repo")


@query(_SCOPED.format(lines=DOCUMENT_LINES, keys="hash"))
def duplication_in_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of every document in blocks that any document holds elsewhere too."""
    return scoped_duplication(document_files(spark, folder), "corpus")


@query(f"""
WITH {DOCUMENT_LINES} SELECT hash, count(*) AS occurrences, count(DISTINCT doc_id) AS files FROM good GROUP BY hash HAVING count(*) > 1
""")
def corpus_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Every block that the corpus holds more than once."""
    return shared_blocks(document_files(spark, folder))


@query(f"""
WITH {DOCUMENT_LINES}
SELECT doc_id AS file_id, count(*) AS repeated_windows, count(DISTINCT hash) AS distinct_windows
FROM repeats GROUP BY doc_id
""")
def repeated_window_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Windows that occur more than once per document, from the in-row list."""
    found = repeated_windows(document_files(spark, folder)).where(F.size("repeats") > 0)
    return found.select(
        "file_id",
        F.size("repeats").cast("long").alias("repeated_windows"),
        F.size(F.array_distinct(F.transform("repeats", lambda x: x["hash"]))).cast("long").alias("distinct_windows"),
    )


@query(f"""
WITH {DOCUMENT_LINES},
c AS (SELECT doc_id, n, n_chars, least(0.8, n / 1000) AS complexity FROM dup)
SELECT doc_id AS file_id, n AS total_lines, {rnd("complexity", 6)} AS complexity_score,
  {rnd("(complexity + 0.2 + 0.5 + 0.3) / 4", 6)} AS debt_score,
  {severity_repo("((complexity + 0.2 + 0.5 + 0.3) / 4)")} AS severity, n_chars AS file_size
FROM c
""")
def content_size_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Content-size score of every document, characters counted from the text."""
    files = document_files(spark, folder)
    scored = files.select(
        "file_id",
        line_count(F.col("content")).cast("long").alias("total_lines"),
        F.length("content").cast("long").alias("chars"),
    ).withColumn("s", content_size_score(F.col("total_lines"), F.col("chars")))
    return scored.select(
        "file_id",
        "total_lines",
        round_to(F.col("s.complexity_score"), 6).alias("complexity_score"),
        round_to(F.col("s.debt_score"), 6).alias("debt_score"),
        "s.severity",
        "s.file_size",
    )


_COMMENT_SQL = """
WITH texts AS ({source}),
parts AS (
  SELECT id, unnest(ls) AS body, unnest(range(len(ls))) + 1 AS line FROM (SELECT id, {lines} AS ls FROM texts)
)
SELECT id AS file_id, line::BIGINT AS line, {strip} AS text FROM (
  SELECT id, line, CASE WHEN contains(body, '#') THEN substr(body, strpos(body, '#'))
    WHEN contains(body, '//') THEN substr(body, strpos(body, '//')) END AS found FROM parts)
WHERE found IS NOT NULL
"""


def _comment_sql(source: str) -> str:
    from debtscope.catalog.sql import lines

    return _COMMENT_SQL.format(source=source, lines=lines("text"), strip=strip("found"))


@query(_comment_sql("SELECT page_id AS id, html AS text FROM pages"))
def page_comments(spark: SparkSession, folder: str) -> DataFrame:
    """Line comments by text scan over raw pages."""
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("file_id"), F.col("html").alias("content"))
    return comments_of(pages).withColumn("line", F.col("line").cast("long"))


@query(_comment_sql("SELECT doc_id AS id, text FROM documents"))
def document_comments(spark: SparkSession, folder: str) -> DataFrame:
    """Line comments by text scan over documents."""
    return comments_of(document_files(spark, folder)).withColumn("line", F.col("line").cast("long"))


@query("SELECT doc_id AS file_id, substr(text, 4, 7) AS head, md5(substr(text, 4)) AS rest FROM documents")
def byte_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of each document by byte offsets that follow from characters: its fourth to tenth, and all from the fourth on."""
    text, bytes_of = F.col("content"), lambda n: F.octet_length(F.substring("content", 1, n))
    return document_files(spark, folder).select(
        "file_id",
        byte_span(text, bytes_of(3), bytes_of(10)).alias("head"),
        F.md5(byte_span(text, bytes_of(3), F.octet_length(text))).alias("rest"),
    )


@query(f"""
SELECT doc_id AS file_id, md5(text) AS digest, length(text)::BIGINT AS chars FROM documents WHERE {strip("text")} <> ''
""")
def blob_contents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents sent through base64 blobs and read back; blank ones dropped."""
    blobs = document_files(spark, folder).select("file_id", F.base64(F.encode("content", "UTF-8")).alias("content"))
    return blob_texts(blobs).select(
        "file_id", F.md5("content").alias("digest"), F.length("content").cast("long").alias("chars")
    )


@query("""
SELECT doc_id AS file_id, CASE WHEN n_chars / 60000.0 < 0.3 THEN 'low' WHEN n_chars / 60000.0 < 0.6 THEN 'medium' ELSE 'high' END AS file_word,
  CASE WHEN n_chars / 60000.0 < 0.4 THEN 'LOW' WHEN n_chars / 60000.0 < 0.7 THEN 'MEDIUM' ELSE 'HIGH' END AS content_word,
  CASE WHEN n_chars / 60000.0 < 0.4 THEN 'LOW' WHEN n_chars / 60000.0 < 0.7 THEN 'MEDIUM' ELSE 'HIGH' END AS repository_word,
  CASE WHEN n_chars / 60000.0 > 0.6 THEN 'HIGH' WHEN n_chars / 60000.0 > 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS metadata_word,
  CASE WHEN n_chars / 60000.0 >= 0.6 THEN 'HIGH' WHEN n_chars / 60000.0 >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS dataset_word,
  CASE WHEN n_chars / 1000 > 15 THEN 'high' WHEN n_chars / 1000 > 7 THEN 'medium' ELSE 'low' END AS function_word,
  CASE WHEN n_chars / 60000.0 > 0.6 THEN 'high' WHEN n_chars / 60000.0 > 0.3 THEN 'medium' ELSE 'low' END AS directory_word
FROM documents
""")
def severity_schemes(spark: SparkSession, folder: str) -> DataFrame:
    """All severity schemes side by side over a size-based value."""
    share = F.col("file_size") / 60000.0
    words = [severity(share, s).alias(f"{s}_word") for s in ("file", "content", "repository", "metadata", "dataset", "directory")]
    size = severity(F.col("file_size") / 1000, "function").alias("function_word")
    return document_files(spark, folder).select("file_id", *words, size)
