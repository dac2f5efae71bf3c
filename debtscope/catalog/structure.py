"""Queries over syntax nodes made of orders and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from debtscope.catalog.registry import query
from debtscope.catalog.sql import DOCUMENT_LINES, clamp, lines, rnd, strip
from debtscope.functions.labels import severity
from debtscope.operators.annotations import documentation_gaps, file_records, function_notes
from debtscope.operators.complexity import file_complexity, function_complexity, function_table, with_nesting_level
from debtscope.operators.documentation import documented_entities, documented_modules, file_documentation
from debtscope.operators.handling import file_handling, function_handling
from debtscope.functions.text import split_lines
from debtscope.operators.nodes import classes_of, file_outline_metrics, functions_of, imports_of, inside, nodes_of_type
from debtscope.operators.outline import outline
from debtscope.operators.paging import first_gaps, top_functions
from debtscope.plans.bindings import document_files, node_files, syntax_nodes
from debtscope.plans.scoring import combine_scores, score_files
from debtscope.session import landed

# Orders as functions, lines as body nodes, in the check's own terms.
NODES = """
sized AS (
  SELECT o.*, coalesce(l.m, 0) AS m FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS m FROM lineitem GROUP BY 1) l
  ON l.l_orderkey = o.o_orderkey
),
placed AS (
  SELECT *, (4 + sum(5 + m) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - (5 + m))::BIGINT AS base,
    o_orderpriority <> '1-URGENT' AS is_function,
    CASE WHEN o_totalprice >= 100000 THEN 'fn_' || o_orderkey ELSE '<anonymous>' END AS name
  FROM sized
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS r FROM lineitem
),
body AS (
  SELECT p.o_custkey AS file_id, p.base AS function_id, p.is_function, p.base + 4 + r AS spot, r,
    l_returnflag = 'R' OR (l_returnflag = 'N' AND l_linestatus = 'O')
      OR (l_returnflag = 'A' AND l_linestatus = 'F' AND l_linenumber % 2 = 0) AS decision,
    l_returnflag = 'A' AND l_linestatus = 'F' AND l_linenumber % 2 = 1 AS operator,
    (l_returnflag IN ('R', 'N') AND l_linestatus = 'O') OR (l_returnflag = 'A' AND l_linestatus = 'F' AND l_linenumber % 2 = 0) AS nesting,
    l_returnflag IN ('R', 'N') AND l_linestatus = 'O' AS holds,
    l_returnflag = 'A' AND l_linestatus = 'O' AS try,
    l_returnflag = 'A' AND l_linestatus = 'F' AND l_linenumber % 2 = 0 AS clause,
    l_returnflag = 'A' AND l_linestatus = 'F' AND l_linenumber % 2 = 0 AND l_tax < 0.02 AS bare,
    l_returnflag = 'N' AND l_linestatus = 'F' AND l_partkey % 3 <> 2 AS risky,
    CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN floor(l_discount * 50 + 0.5)
      WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN floor(l_quantity / 10) ELSE 0 END AS len
  FROM ranked JOIN placed p ON p.o_orderkey = l_orderkey
),
levels AS (
  SELECT *, (CASE WHEN is_function THEN 1 ELSE 0 END + coalesce(sum(CASE WHEN holds THEN 1 ELSE 0 END) OVER (
      PARTITION BY file_id, function_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    + CASE WHEN nesting THEN 1 ELSE 0 END)::BIGINT AS level
  FROM body
),
fn AS (
  SELECT p.o_custkey AS file_id, p.base AS function_id, p.name, p.base + 1 AS start_line, p.base + 5 + p.m AS end_line,
    p.o_orderstatus = 'F' AS doc, p.m,
    (1 + count(*) FILTER (b.decision) + 0.5 * count(*) FILTER (b.operator))::DOUBLE AS cyclomatic,
    coalesce(sum(CASE WHEN b.decision THEN 1 + greatest(b.level - 2, 0) ELSE 0 END), 0)::BIGINT AS cognitive
  FROM placed p LEFT JOIN levels b ON b.file_id = p.o_custkey AND b.function_id = p.base
  WHERE p.is_function GROUP BY ALL
),
handled AS (
  SELECT c.file_id, c.function_id, count(*) AS risky_calls, count(*) FILTER (EXISTS (
    SELECT 1 FROM body t WHERE t.try AND t.file_id = c.file_id AND t.function_id = c.function_id
      AND t.spot <= c.spot AND c.spot + c.len <= t.spot + t.len)) AS handled_calls
  FROM body c WHERE c.risky GROUP BY 1, 2
),
flags AS (
  SELECT file_id, function_id, bool_or(try) AS has_try, bool_or(bare) AS has_bare, bool_or(clause AND NOT bare) AS has_specific
  FROM body GROUP BY 1, 2
),
eh AS (
  SELECT fn.file_id, fn.function_id, coalesce(has_try, false) AS has_try, coalesce(has_bare, false) AS has_bare,
    coalesce(has_specific, false) AS has_specific, false AS has_finally,
    coalesce(risky_calls, 0) AS risky_calls, coalesce(handled_calls, 0) AS handled_calls
  FROM fn LEFT JOIN flags USING (file_id, function_id) LEFT JOIN handled USING (file_id, function_id)
),
module AS (
  SELECT c_custkey AS file_id, c_nationkey % 3 = 0 AS module_doc,
    CASE WHEN c_nationkey % 2 = 0 THEN 1 + c_nationkey % 4 ELSE 0 END AS comment_lines,
    (4 + coalesce((SELECT sum(m + 5) FROM sized s WHERE s.o_custkey = c.c_custkey), 0))::BIGINT AS total_lines
  FROM customer c
)
"""

_AVG = lambda c: rnd(f"sum({c}) / count(*)", 2)
FILE_COMPLEXITY = f"""
cx AS (
  SELECT m.file_id, coalesce(a.tc, 0) AS total_cyclomatic, coalesce(a.tg, 0)::BIGINT AS total_cognitive,
    coalesce(a.mc, 0) AS max_cyclomatic, coalesce(a.mg, 0) AS max_cognitive, coalesce(a.k, 0) AS function_count,
    coalesce(a.ac, 0) AS avg_cyclomatic, coalesce(a.ag, 0) AS avg_cognitive
  FROM module m LEFT JOIN (
    SELECT file_id, sum(cyclomatic) AS tc, sum(cognitive) AS tg, max(cyclomatic) AS mc, max(cognitive) AS mg, count(*) AS k,
      {_AVG("cyclomatic")} AS ac, {_AVG("cognitive")} AS ag FROM fn GROUP BY 1) a USING (file_id)
),
cx_scored AS (
  SELECT *, CASE WHEN function_count = 0 THEN 0.0 ELSE {rnd(
    "least(least(" + clamp("(avg_cyclomatic - 5) / 20")
    + " + CASE WHEN max_cyclomatic > 20 THEN least((max_cyclomatic - 20) / 30, 0.3) ELSE 0.0 END, 1.0)"
    + " + CASE WHEN avg_cognitive > 15 THEN least((avg_cognitive - 15) / 30, 0.2) ELSE 0.0 END, 1.0)", 4)} END AS complexity_score
  FROM cx
)
"""
_COVERED = rnd("(df + dc + CASE WHEN module_doc THEN 1 ELSE 0 END) / (k + c + 1)", 4)
FILE_DOCS = f"""
docs AS (
  SELECT m.*, coalesce(a.k, 0) AS k, coalesce(a.df, 0) AS df, coalesce(b.c, 0) AS c, coalesce(b.dc, 0) AS dc
  FROM module m
  LEFT JOIN (SELECT file_id, count(*) AS k, count(*) FILTER (doc) AS df FROM fn GROUP BY 1) a USING (file_id)
  LEFT JOIN (SELECT o_custkey AS file_id, count(*) AS c, count(*) FILTER (o_orderstatus = 'F') AS dc FROM placed
    WHERE NOT is_function GROUP BY 1) b USING (file_id)
),
docs_scored AS (
  SELECT *, {_COVERED} AS doc_coverage, {rnd("comment_lines / total_lines", 4)} AS comment_density,
    {rnd(clamp(f"(1 - {_COVERED} - 0.2) / 0.7"), 4)} AS documentation_score FROM docs
)
"""
_SHARE = rnd("functions_with_handling / function_count", 4)
FILE_HANDLING = f"""
ehf AS (
  SELECT m.file_id, coalesce(a.k, 0) AS function_count, coalesce(a.t, 0) AS functions_with_handling, coalesce(a.b, 0) AS bare_except_count,
    coalesce(a.r, 0)::BIGINT AS total_risky_calls, coalesce(a.h, 0)::BIGINT AS handled_risky_calls
  FROM module m LEFT JOIN (SELECT file_id, count(*) AS k, count(*) FILTER (has_try) AS t, count(*) FILTER (has_bare) AS b,
    sum(risky_calls) AS r, sum(handled_calls) AS h FROM eh GROUP BY 1) a USING (file_id)
),
ehf_scored AS (
  SELECT *, CASE WHEN function_count = 0 THEN 0.0 ELSE {_SHARE} END AS handling_coverage,
    CASE WHEN function_count = 0 THEN 0.5
      ELSE {rnd(f"greatest({_SHARE} - least(bare_except_count * 0.1, 0.3), 0.0)", 4)} END AS error_handling_score
  FROM ehf
)
"""
_TOTAL = rnd(
    clamp(
        "0.30 * c.complexity_score + 0.20 * d.documentation_score + 0.25 * (1 - e.error_handling_score)"
    ),
    4,
)


@query(f"WITH {NODES} SELECT file_id, spot + 1 AS start_line, spot AS node_id FROM body WHERE try")
def nodes_by_type(spark: SparkSession, folder: str) -> DataFrame:
    """All nodes of one type."""
    return nodes_of_type(syntax_nodes(spark, folder), "try_statement").select("file_id", "start_line", "node_id")


@query(f"""
WITH {NODES} SELECT file_id, function_id, name, start_line, end_line, end_line - start_line + 1 AS line_count FROM fn
""")
def function_list(spark: SparkSession, folder: str) -> DataFrame:
    """Functions with names and extents."""
    found = functions_of(syntax_nodes(spark, folder)).withColumnRenamed("node_id", "function_id")
    return found.select("file_id", "function_id", "name", "start_line", "end_line", "line_count")


@query(f"""
WITH {NODES} SELECT o_custkey AS file_id, name, base + 1 AS start_line, m + 5 AS line_count FROM placed WHERE NOT is_function
""")
def class_list(spark: SparkSession, folder: str) -> DataFrame:
    """Classes with names and extents."""
    return classes_of(syntax_nodes(spark, folder)).select("file_id", "name", "start_line", "line_count")


@query(f"""
WITH {NODES}, f AS (SELECT file_id, count(*) AS k, max(m + 5) AS longest FROM fn GROUP BY 1),
c AS (SELECT o_custkey AS file_id, count(*) AS k, max(m + 5) AS longest FROM placed WHERE NOT is_function GROUP BY 1)
SELECT m.file_id, coalesce(f.k, 0) AS function_count, coalesce(c.k, 0) AS class_count,
  coalesce(f.longest, 0) AS max_function_length, coalesce(c.longest, 0) AS max_class_length
FROM module m LEFT JOIN f USING (file_id) LEFT JOIN c USING (file_id)
""")
def outline_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Function and class counts and longest extents per file."""
    kind, span = F.col("type"), F.col("end_line") - F.col("start_line") + 1
    longest = lambda t: F.coalesce(F.max(F.when(kind == t, span)), F.lit(0))
    return syntax_nodes(spark, folder).groupBy("file_id").agg(
        F.count_if(kind == "function_definition").alias("function_count"),
        F.count_if(kind == "class_definition").alias("class_count"),
        longest("function_definition").alias("max_function_length"),
        longest("class_definition").alias("max_class_length"),
    )


@query(f"WITH {NODES} SELECT file_id, spot AS node_id, level FROM levels WHERE decision")
def nesting_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Open nesting nodes at every decision."""
    return with_nesting_level(syntax_nodes(spark, folder)).where("decision").select("file_id", "node_id", "level")


@query(f"WITH {NODES} SELECT file_id, function_id, count(*) AS members FROM body WHERE is_function GROUP BY 1, 2")
def function_members(spark: SparkSession, folder: str) -> DataFrame:
    """Body nodes contained in each function, by the containment join."""
    nodes = syntax_nodes(spark, folder)
    owners = nodes.where("type = 'function_definition'").select(
        "file_id", F.col("node_id").alias("function_id"), F.col("pre").alias("f_pre"), F.col("post").alias("f_post")
    )
    structural = ("module", "function_definition", "class_definition", "identifier", "block", "expression_statement", "string", "comment")
    members = nodes.where(~F.col("type").isin(*structural)).select("file_id", "pre")
    return inside(owners, members).groupBy("file_id", "function_id").agg(F.count("*").alias("members"))


@query(f"WITH {NODES} SELECT file_id, function_id, cyclomatic, cognitive FROM fn")
def function_complexities(spark: SparkSession, folder: str) -> DataFrame:
    """Cyclomatic and cognitive complexity of each function."""
    return function_complexity(syntax_nodes(spark, folder))


@query(f"""
WITH {NODES}, {FILE_COMPLEXITY}
SELECT file_id, total_cyclomatic, total_cognitive, avg_cyclomatic, avg_cognitive, max_cyclomatic, max_cognitive,
  function_count, complexity_score FROM cx_scored
""")
def file_complexities(spark: SparkSession, folder: str) -> DataFrame:
    """File totals and complexity score, files without functions included."""
    metrics = function_complexity(syntax_nodes(spark, folder))
    return file_complexity(metrics, node_files(spark, folder)).select(
        "file_id", "total_cyclomatic", "total_cognitive", "avg_cyclomatic", "avg_cognitive",
        "max_cyclomatic", "max_cognitive", "function_count", "complexity_score",
    )


@query(f"WITH {NODES} SELECT file_id FROM module WHERE module_doc")
def module_docstrings(spark: SparkSession, folder: str) -> DataFrame:
    """Files that open with a docstring."""
    return documented_modules(syntax_nodes(spark, folder))


@query(f"""
WITH {NODES} SELECT file_id, 'function' AS kind, name, doc AS has_docstring, start_line FROM fn
UNION ALL SELECT o_custkey, 'class', name, o_orderstatus = 'F', base + 1 FROM placed WHERE NOT is_function
""")
def entity_docstrings(spark: SparkSession, folder: str) -> DataFrame:
    """Functions and classes with their documentation flag."""
    return documented_entities(syntax_nodes(spark, folder))


@query(f"""
WITH {NODES}, {FILE_DOCS}
SELECT file_id, total_lines, k AS total_functions, df AS documented_functions, c AS total_classes, dc AS documented_classes,
  comment_lines::BIGINT AS comment_lines, doc_coverage, comment_density, module_doc AS has_module_docstring, documentation_score
FROM docs_scored
""")
def file_documentations(spark: SparkSession, folder: str) -> DataFrame:
    """Documentation coverage, comment density and score per file."""
    return file_documentation(syntax_nodes(spark, folder), node_files(spark, folder))


@query(f"""
WITH {NODES} SELECT *, CASE WHEN risky_calls > 0 THEN {rnd("handled_calls / risky_calls", 4)}
  WHEN has_try THEN 1.0 ELSE 0.0 END AS coverage FROM eh
""")
def function_handlings(spark: SparkSession, folder: str) -> DataFrame:
    """Try, except and risky-call figures of each function."""
    return function_handling(syntax_nodes(spark, folder))


@query(f"""
WITH {NODES}, {FILE_HANDLING}
SELECT file_id, function_count, functions_with_handling, bare_except_count, functions_with_handling AS total_try_blocks,
  total_risky_calls, handled_risky_calls, handling_coverage, error_handling_score FROM ehf_scored
""")
def file_handlings(spark: SparkSession, folder: str) -> DataFrame:
    """File error-handling totals and quality score."""
    return file_handling(function_handling(syntax_nodes(spark, folder)), node_files(spark, folder))


@query(f"""
WITH {NODES} SELECT file_id, name, start_line - 1 AS start_line, end_line - 1 AS end_line, cyclomatic, cognitive,
  CASE WHEN cyclomatic > 15 THEN 'high' WHEN cyclomatic > 7 THEN 'medium' ELSE 'low' END AS severity
FROM fn WHERE cyclomatic > 7
""")
def inline_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Functions an editor marks at the low threshold."""
    return function_notes(function_table(syntax_nodes(spark, folder)), threshold="low")


@query(f"""
WITH {NODES} SELECT file_id, function_id, name, cyclomatic, cognitive, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY cyclomatic DESC, start_line, name)::INTEGER AS rank FROM fn)
WHERE rank <= 20
""")
def top_complex_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty most complex functions of each file."""
    top = top_functions(function_table(syntax_nodes(spark, folder)))
    return top.select("file_id", "function_id", "name", "cyclomatic", "cognitive", "rank")


@query(f"""
WITH {NODES}, gaps AS (
  SELECT file_id, name, 'function' AS kind, start_line - 1 AS start_line FROM fn WHERE NOT doc
  UNION ALL SELECT o_custkey, name, 'class', base FROM placed WHERE NOT is_function AND o_orderstatus <> 'F')
SELECT file_id, name, kind, start_line, rank FROM (SELECT *, row_number() OVER (
  PARTITION BY file_id ORDER BY kind DESC, start_line, name)::INTEGER AS rank FROM gaps) WHERE rank <= 15
""")
def first_documentation_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """First fifteen undocumented entities of each file."""
    return first_gaps(documentation_gaps(documented_entities(syntax_nodes(spark, folder))))


def _combined(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    nodes, files = syntax_nodes(spark, folder), node_files(spark, folder)
    no_text = files.withColumns(
        {
            "duplicated_lines": F.lit(0),
            "duplication_percent": F.lit(0.0),
            "duplication_score": F.lit(0.0),
            "language": F.lit("python"),
        }
    )
    return nodes, combine_scores(no_text, nodes)


@query(f"""
WITH {NODES}, {FILE_COMPLEXITY}, {FILE_DOCS}, {FILE_HANDLING},
t AS (SELECT file_id, c.complexity_score, d.documentation_score, e.error_handling_score, {_TOTAL} AS debt_score
  FROM cx_scored c JOIN docs_scored d USING (file_id) JOIN ehf_scored e USING (file_id))
SELECT *, CASE WHEN debt_score < 0.3 THEN 'low' WHEN debt_score < 0.6 THEN 'medium' ELSE 'high' END AS severity FROM t
""")
def node_file_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Composite file score from the node-based analyzers."""
    _, scores = _combined(spark, folder)
    return scores.select(
        "file_id", "complexity_score", "documentation_score", "error_handling_score", "debt_score", "severity"
    )


@query(f"""
WITH {NODES}, {FILE_COMPLEXITY}, {FILE_DOCS}, {FILE_HANDLING}
SELECT file_id, {_TOTAL} AS total_score, c.function_count, d.df AS documented_funcs, e.bare_except_count,
  (SELECT string_agg(name || ':' || cyclomatic, ',' ORDER BY start_line) FROM fn WHERE fn.file_id = c.file_id) AS functions
FROM cx_scored c JOIN docs_scored d USING (file_id) JOIN ehf_scored e USING (file_id)
""")
def nested_file_records(spark: SparkSession, folder: str) -> DataFrame:
    """Nested per-file records, read back through their paths."""
    nodes, scores = _combined(spark, folder)
    records = file_records(scores, function_table(nodes), documented_entities(nodes))
    names = F.transform("annotations.functions", lambda f: F.concat_ws(":", f["name"], f["cyclomatic"].cast("string")))
    return records.select(
        "file_id",
        "total_score",
        "dimensions.complexity.function_count",
        "dimensions.documentation.documented_funcs",
        "dimensions.error_handling.bare_except_count",
        F.when(F.size(names) > 0, F.array_join(names, ",")).alias("functions"),
    )


@query(f"""
WITH {NODES} SELECT CASE WHEN cyclomatic > 15 THEN 'high' WHEN cyclomatic > 7 THEN 'medium' ELSE 'low' END AS severity,
  count(*) AS functions FROM fn GROUP BY 1
""")
def function_severities(spark: SparkSession, folder: str) -> DataFrame:
    """Functions per severity of their cyclomatic number."""
    levels = function_complexity(syntax_nodes(spark, folder)).withColumn("severity", severity(F.col("cyclomatic"), "function"))
    return levels.groupBy("severity").agg(F.count("*").alias("functions"))


def python_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents read as Python files."""
    return document_files(spark, folder).withColumn("language", F.lit("python"))


def document_outline(spark: SparkSession, folder: str) -> DataFrame:
    """Outline nodes of all documents, landed once."""
    return landed(spark, folder, "document-outline", lambda: outline(python_documents(spark, folder)))


@query(f"""
WITH l AS (SELECT doc_id, unnest(ls) AS body, unnest(range(len(ls))) + 1 AS line FROM (SELECT doc_id, {lines("text")} AS ls FROM documents))
SELECT doc_id AS file_id, line::BIGINT AS line, {strip("body")} AS text FROM l WHERE starts_with(body, 'The ') OR starts_with(body, 'La ')
""")
def import_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Statements found by node with the trimmed text of their line."""
    files = document_files(spark, folder)
    rows = files.select("file_id", F.posexplode(split_lines(F.col("content"))).alias("i", "body"))
    starts = F.col("body").startswith("The ") | F.col("body").startswith("La ")
    nodes = rows.where(starts).select(
        "file_id", F.lit("import_statement").alias("type"), (F.col("i") + 1).alias("start_line")
    )
    return imports_of(nodes, files, may_import=starts).withColumn("line", F.col("line").cast("long"))


@query()
def outline_node_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Outline of all documents as Python text, nodes per type."""
    return document_outline(spark, folder).groupBy("type").agg(
        F.count("*").alias("nodes"), F.count_distinct("file_id").alias("files")
    )


@query(f"""
WITH l AS (SELECT doc_id, text, {lines("text")} AS ls FROM documents)
SELECT doc_id AS file_id, len(ls)::BIGINT AS line_count, 0::BIGINT AS function_count, 0::BIGINT AS class_count, 0::BIGINT AS import_count,
  CASE WHEN {strip("text")} = '' THEN 0 ELSE len(list_filter(ls, lambda x: contains(x, '#') OR contains(x, '//'))) END AS comment_count,
  0::BIGINT AS max_function_length, 0::BIGINT AS max_class_length FROM l
""")
def outline_file_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Basic metrics of every document from its outline."""
    return file_outline_metrics(document_outline(spark, folder), python_documents(spark, folder))


@query(f"""
WITH {DOCUMENT_LINES},
s AS (SELECT doc_id, CASE WHEN n = 0 THEN 0.0 ELSE {rnd(clamp("(pct - 3) / 22"), 4)} END AS d FROM dup WHERE {strip("text")} <> ''),
t AS (SELECT doc_id AS file_id, 0.0::DOUBLE AS complexity_score, d AS duplication_score, 1.0::DOUBLE AS documentation_score,
  0.5::DOUBLE AS error_handling_score, {rnd("0.25 * d + 0.20 + 0.25 * 0.5", 4)} AS debt_score FROM s)
SELECT *, CASE WHEN debt_score < 0.3 THEN 'low' WHEN debt_score < 0.6 THEN 'medium' ELSE 'high' END AS severity FROM t
""")
def outline_file_scores(spark: SparkSession, folder: str) -> DataFrame:
    """All four analyzers and the composite over the outline of every document."""
    scores, _ = score_files(python_documents(spark, folder), document_outline(spark, folder))
    return scores.select(
        "file_id", "complexity_score", "duplication_score", "documentation_score", "error_handling_score", "debt_score", "severity"
    )
