"""Queries over programs: each customer is a Python module, each order a function, each line item a statement.

The texts are written from the given tables, read by the outline and scored by
all four analyzers; the check SQL takes the figures from the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from debtscope.catalog.registry import query
from debtscope.catalog.sql import DOCUMENT_LINES, clamp, rnd
from debtscope.catalog.structure import FILE_COMPLEXITY, FILE_DOCS, FILE_HANDLING
from debtscope.operators.complexity import function_complexity
from debtscope.operators.duplication import duplicate_blocks
from debtscope.operators.nodes import file_outline_metrics, imports_of
from debtscope.operators.outline import outline
from debtscope.plans.scoring import score_files
from debtscope.session import landed, table

_NL = " || chr(10) || "
CODE = f"""
statements AS (
  SELECT l_orderkey, l_linenumber, l_returnflag AS kind, l_returnflag = 'A' AND l_linestatus = 'F' AS bare,
    CASE l_returnflag WHEN 'R' THEN '    if a > ' || l_linenumber || ':' {_NL} '        a = open(a)'
      WHEN 'A' THEN '    try:' {_NL} '        a = open(a)' {_NL} '    except' || CASE WHEN l_linestatus = 'F' THEN '' ELSE ' ValueError' END || ':' {_NL} '        pass'
      ELSE '    a = a and ' || l_linenumber END AS body
  FROM lineitem
),
bodies AS (
  SELECT l_orderkey, string_agg(body, chr(10) ORDER BY l_linenumber, body) AS body, count(*) FILTER (kind = 'R') AS r,
    count(*) FILTER (kind = 'A') AS t, count(*) FILTER (kind NOT IN ('R', 'A')) AS n, bool_or(bare) AS bare FROM statements GROUP BY 1
),
written AS (
  SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS doc, coalesce(r, 0) AS r, coalesce(t, 0) AS t, coalesce(n, 0) AS n, coalesce(bare, false) AS bare,
    'def order_' || o_orderkey || '(a):' {_NL} CASE WHEN o_orderstatus = 'F' THEN '    \"\"\"Doc.\"\"\"' || chr(10) ELSE '' END
      || CASE WHEN body IS NULL THEN '' ELSE body || chr(10) END || '    return a' AS text
  FROM orders LEFT JOIN bodies ON l_orderkey = o_orderkey
),
code AS (
  SELECT c_custkey AS doc_id, 'r' || c_nationkey AS source, 'python' AS lang, 0 AS n_chars,
    CASE WHEN c_custkey % 2 = 0 THEN '\"\"\"Module.\"\"\"' ELSE 'import os' END
      || coalesce(chr(10) || (SELECT string_agg(text, chr(10) ORDER BY o_orderkey) FROM written WHERE o_custkey = c_custkey), '') AS text
  FROM customer
)
""".replace('\\"', '"')
FIGURES = f"""{CODE}, {DOCUMENT_LINES.replace("FROM documents", "FROM code")},
fn AS (
  SELECT o_custkey AS file_id, o_orderkey AS function_id, doc, (1 + r + t + 0.5 * n)::DOUBLE AS cyclomatic, (r + t)::BIGINT AS cognitive FROM written
),
placed AS (SELECT 0::BIGINT AS o_custkey, true AS is_function, '' AS o_orderstatus WHERE false),
eh AS (SELECT o_custkey AS file_id, o_orderkey AS function_id, t > 0 AS has_try, bare AS has_bare, r + t AS risky_calls, t AS handled_calls FROM written),
module AS (SELECT doc_id AS file_id, doc_id % 2 = 0 AS module_doc, 0 AS comment_lines, n AS total_lines FROM dup)
"""


def code_files(spark: SparkSession, folder: str) -> DataFrame:
    """The texts below, landed once: the outline reads them by language, other queries by line."""
    return landed(spark, folder, "code-files", lambda: code_texts(spark, folder))


def code_texts(spark: SparkSession, folder: str) -> DataFrame:
    """One Python text per customer: a function per order, a statement per line item."""
    kind, number = F.col("l_returnflag"), F.col("l_linenumber").cast("string")
    caught = F.when(F.col("l_linestatus") == "F", "    except:").otherwise("    except ValueError:")
    body = (
        F.when(kind == "R", F.concat(F.lit("    if a > "), number, F.lit(":\n        a = open(a)")))
        .when(kind == "A", F.concat(F.lit("    try:\n        a = open(a)\n"), caught, F.lit("\n        pass")))
        .otherwise(F.concat(F.lit("    a = a and "), number))
    )
    ordered = lambda *c: F.sort_array(F.collect_list(F.struct(*c)))
    bodies = (
        table(spark, folder, "lineitem")
        .select("l_orderkey", "l_linenumber", body.alias("body"))
        .groupBy("l_orderkey")
        .agg(F.transform(ordered("l_linenumber", "body"), lambda x: x["body"]).alias("bodies"))
    )
    orders = table(spark, folder, "orders").join(bodies, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    lines = F.concat(
        F.array(F.concat(F.lit("def order_"), F.col("o_orderkey").cast("string"), F.lit("(a):"))),
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit('    """Doc."""'))).otherwise(F.array().cast("array<string>")),
        F.coalesce("bodies", F.array().cast("array<string>")),
        F.array(F.lit("    return a")),
    )
    functions = (
        orders.select("o_custkey", "o_orderkey", F.array_join(lines, "\n").alias("text"))
        .groupBy("o_custkey")
        .agg(F.transform(ordered("o_orderkey", "text"), lambda x: x["text"]).alias("texts"))
    )
    first = F.when(F.col("c_custkey") % 2 == 0, '"""Module."""').otherwise("import os")
    customers = table(spark, folder, "customer").join(functions, F.col("c_custkey") == F.col("o_custkey"), "left")
    return customers.select(
        F.col("c_custkey").alias("file_id"),
        F.concat(F.lit("r"), F.col("c_nationkey").cast("string")).alias("repo"),
        F.lit("python").alias("language"),
        F.array_join(F.concat(F.array(first), F.coalesce("texts", F.array().cast("array<string>"))), "\n").alias("content"),
    )


def code_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Outline of all programs, landed once: every analyzer reads it."""
    return landed(spark, folder, "code-nodes", lambda: outline(code_files(spark, folder)))


@query(f"""
WITH {FIGURES}, {FILE_COMPLEXITY}, {FILE_DOCS}, {FILE_HANDLING},
d AS (SELECT doc_id AS file_id, CASE WHEN n = 0 THEN 0.0 ELSE {rnd(clamp("(pct - 3) / 22"), 4)} END AS duplication_score FROM dup),
t AS (
  SELECT file_id, complexity_score, duplication_score, documentation_score, error_handling_score, {rnd(clamp(
    "0.30 * complexity_score + 0.25 * duplication_score + 0.20 * documentation_score + 0.25 * (1 - error_handling_score)"), 4)} AS debt_score
  FROM cx_scored JOIN docs_scored USING (file_id) JOIN ehf_scored USING (file_id) JOIN d USING (file_id)
)
SELECT *, CASE WHEN debt_score < 0.3 THEN 'low' WHEN debt_score < 0.6 THEN 'medium' ELSE 'high' END AS severity FROM t
""")
def code_file_scores(spark: SparkSession, folder: str) -> DataFrame:
    """All four dimensions of every program, from its text."""
    scores, _ = score_files(code_files(spark, folder), code_nodes(spark, folder))
    return scores.select(
        "file_id", "complexity_score", "duplication_score", "documentation_score", "error_handling_score", "debt_score", "severity"
    )


@query(f"WITH {FIGURES} SELECT file_id, cyclomatic, cognitive, count(*) AS functions FROM fn GROUP BY ALL")
def code_function_complexities(spark: SparkSession, folder: str) -> DataFrame:
    """Complexities of the functions of every program, from its text."""
    figures = function_complexity(code_nodes(spark, folder))
    return figures.groupBy("file_id", "cyclomatic", "cognitive").agg(F.count("*").alias("functions"))


@query(f"""
WITH {FIGURES}, s AS (SELECT sum(r) AS r, sum(t) AS t, sum(n) AS n, count(*) AS f, count(*) FILTER (doc) AS d FROM written),
m AS (SELECT count(*) AS files, count(*) FILTER (doc_id % 2 = 0) AS docs FROM code),
rows AS (
  SELECT unnest(['module', 'function_definition', 'identifier', 'block', 'if_statement', 'try_statement', 'except_clause', 'boolean_operator',
      'call', 'string', 'expression_statement', 'import_statement']) AS type,
    unnest([files, f, f, f, r, t, t, n, r + t, d + docs, d + docs, files - docs]) AS nodes FROM s, m
)
SELECT type, nodes::BIGINT AS nodes FROM rows WHERE nodes > 0
""")
def code_outline_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of each type in the outlines of all programs."""
    return code_nodes(spark, folder).groupBy("type").agg(F.count("*").alias("nodes"))


@query(f"""
WITH {CODE}, {DOCUMENT_LINES.replace("FROM documents", "FROM code")}
SELECT doc_id AS file_id, hash, count(*) AS occurrences FROM repeats GROUP BY ALL
""")
def code_duplicate_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of lines that a program repeats."""
    return duplicate_blocks(code_files(spark, folder)).select("file_id", "hash", "occurrences")


@query("SELECT c_custkey AS file_id, 1::BIGINT AS line, 'import os' AS text FROM customer WHERE c_custkey % 2 = 1")
def code_import_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Imports of every program with their lines."""
    return imports_of(code_nodes(spark, folder), code_files(spark, folder)).select("file_id", F.col("line").cast("long").alias("line"), "text")


@query(f"""
WITH {FIGURES}, sized AS (SELECT o_custkey AS file_id, 2 + doc::INT + 2 * r + 4 * t + n AS size FROM written)
SELECT c_custkey AS file_id, (1 + coalesce(sum(size), 0))::BIGINT AS line_count, count(size) AS function_count, 0::BIGINT AS class_count,
  any_value(c_custkey % 2)::BIGINT AS import_count, 0::BIGINT AS comment_count, coalesce(max(size), 0)::BIGINT AS max_function_length, 0::BIGINT AS max_class_length
FROM customer LEFT JOIN sized ON file_id = c_custkey GROUP BY c_custkey
""")
def code_outline_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Line, function, class, import and comment counts of every program."""
    return file_outline_metrics(code_nodes(spark, folder), code_files(spark, folder))
