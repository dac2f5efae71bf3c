"""Queries over programs in seven more languages: each customer is a file, each order a function, each line item a statement.

A customer's number chooses the language. The texts are written from the given
tables and read by the outline; the check SQL takes the figures from the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from debtscope.catalog.registry import query
from debtscope.operators.complexity import function_complexity
from debtscope.operators.documentation import file_documentation
from debtscope.operators.handling import function_handling
from debtscope.operators.outline import outline
from debtscope.session import landed, table

LANGUAGES = ("c", "cpp", "go", "java", "php", "ruby", "rust")

#: By language: what starts a file and ends it, the note above a function, its first line and its last ones,
#: and a choice, a guarded call or a loop, and a plain statement. K is the order's number, N the line's.
TEMPLATES: dict[str, tuple[str, str, str, str, str, str, str, str]] = {
    "c": ("", "", "/** Doc\n * of it {. */", "int order_K(int a)\n{", "return a;\n}", "if (a > N) {\na = open(a, \"}\");\n}", "while (a < N) {\na = open(a);\n}", "a = a &&\n  N; // }"),
    "cpp": ("", "", "/** Doc\n * of it {. */", "int order_K(int a) {", "return a;\n}", "if (a > N) {\na = open(a, R\"x(\" } )x\");\n}", "try {\na = open(a);\n} catch (const E& e) {\n}", "a = a &&\n  N; // }"),
    "go": ("package main", "", "/** Doc\n * of it {. */", "func order_K(a int, b interface{}) (int, error) {", "return a\n}", "if a > N {\na = open(a, `}\n`)\n}", "for a < N {\na = open(a)\n}", "a = a &&\n  N // }"),
    "java": ("class Program {", "}", "/** Doc\n * of it {. */", "int order_K(int a) throws E {", "return a;\n}", "if (a > N) {\na = open(a, '}', \"\"\"\n}\"\"\");\n}", "try {\na = open(a);\n} catch (E e) {\n}", "a = a &&\n  N; // }"),
    "php": ("<b> { <?php", "?> }", "/** Doc\n * of it {. */", "function order_K($a) {", "return $a;\n}", "if ($a > N) {\n$a = open($a, <<<TXT\n}\nTXT);\n}", "try {\n$a = open($a);\n} catch (E $e) {\n}", "$a = $a &&\n  N; # }"),
    "ruby": ("", "", "=begin\ndef no\n=end", "def order_K(a)", "return a if a\nend", "if a > N\na = open(a, \"end {\")\nend", "begin\na = open(a)\nrescue E\nend", "a = a &&\n  N # end"),
    "rust": ("", "", "/** Doc /* of { */ it. */", "fn order_K<'a>(a: &'a i32) -> i32 {", "a\n}", "if a > N {\na = open(a, '}', r#\"\" } \"#);\n}", "while a < N {\na = open(a);\n}", "a = a &&\n  N; // }"),
}

FIGURES = f"""
statements AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag = 'A') AS t,
  count(*) FILTER (l_returnflag NOT IN ('R', 'A')) AS n FROM lineitem GROUP BY 1),
files AS (SELECT c_custkey AS file_id, {list(LANGUAGES)}[c_custkey % 7 + 1] AS language FROM customer),
fn AS (SELECT f.file_id, f.language, o_orderkey AS function_id, o_orderstatus = 'F' AS doc, coalesce(r, 0) AS r, coalesce(t, 0) AS t, coalesce(n, 0) AS n,
  row_number() OVER (PARTITION BY file_id ORDER BY o_orderkey) = 1 AS first
  FROM files f JOIN orders ON o_custkey = f.file_id LEFT JOIN statements ON l_orderkey = o_orderkey)
"""


def language_files(spark: SparkSession, folder: str) -> DataFrame:
    """The texts below, landed once: every branch of the outline reads those of its languages."""
    return landed(spark, folder, "language-files", lambda: language_texts(spark, folder))


def language_texts(spark: SparkSession, folder: str) -> DataFrame:
    """One text per customer in the language that the customer's number chooses."""
    language = F.element_at(F.array(*map(F.lit, LANGUAGES)), F.pmod(F.col("c_custkey"), F.lit(7)).cast("int") + 1)
    written = spark.createDataFrame(
        [(name, *parts) for name, parts in TEMPLATES.items()], "language string, head string, foot string, note string, begin string, done string, choice string, guard string, plain string"
    )
    kind = F.col("l_returnflag")
    customers = table(spark, folder, "customer").select("c_custkey", language.alias("language")).join(F.broadcast(written), "language")
    body = F.when(kind == "R", F.col("choice")).when(kind == "A", F.col("guard")).otherwise(F.col("plain"))
    ordered = lambda *c: F.sort_array(F.collect_list(F.struct(*c)))
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    keyed = customers.join(orders, F.col("c_custkey") == F.col("o_custkey"))
    number = F.col("l_linenumber").cast("string")
    bodies = (
        table(spark, folder, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_returnflag")
        .join(keyed.select("o_orderkey", "choice", "guard", "plain"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select("l_orderkey", "l_linenumber", F.replace(body, F.lit("N"), number).alias("body"))
        .groupBy("l_orderkey")
        .agg(F.transform(ordered("l_linenumber", "body"), lambda x: x["body"]).alias("bodies"))
    )
    empty = F.array().cast("array<string>")
    lines = F.concat(
        F.when(F.col("o_orderstatus") == "F", F.array("note")).otherwise(empty),
        F.array(F.replace("begin", F.lit("K"), F.col("o_orderkey").cast("string"))),
        F.coalesce("bodies", empty),
        F.array("done"),
    )
    functions = (
        keyed.join(bodies, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select("o_custkey", "o_orderkey", F.array_join(lines, "\n").alias("text"))
        .groupBy("o_custkey")
        .agg(F.transform(ordered("o_orderkey", "text"), lambda x: x["text"]).alias("texts"))
    )
    filled = lambda c: F.when(F.col(c) != "", F.array(c)).otherwise(empty)
    return customers.join(functions, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("file_id"), "language", F.array_join(F.concat(filled("head"), F.coalesce("texts", empty), filled("foot")), "\n").alias("content")
    )


def language_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Outline of all those texts, landed once."""
    return landed(spark, folder, "language-nodes", lambda: outline(language_files(spark, folder)))


@query(f"""
WITH {FIGURES}, s AS (
  SELECT language, count(*) AS f, count(*) FILTER (doc) AS d, sum(r) AS r, sum(t) AS t, sum(n) AS n FROM fn GROUP BY 1
), m AS (SELECT language, count(*) AS files FROM files JOIN (SELECT DISTINCT o_custkey FROM orders) ON o_custkey = file_id GROUP BY 1),
everything AS (SELECT language, count(*) AS files FROM files GROUP BY 1),
rows AS (
  SELECT language, unnest(CASE language
    WHEN 'c' THEN [('translation_unit', m.files), ('function_definition', f), ('comment', d + n), ('if_statement', r), ('while_statement', t), ('binary_expression', r + t + n), ('call_expression', r + t)]
    WHEN 'cpp' THEN [('translation_unit', m.files), ('function_definition', f), ('comment', d + n), ('if_statement', r), ('try_statement', t), ('catch_clause', t), ('binary_expression', r + n), ('call_expression', r + t)]
    WHEN 'go' THEN [('source_file', e.files), ('function_declaration', f), ('identifier', f), ('comment', d + n), ('if_statement', r), ('for_statement', t), ('binary_expression', r + t + n), ('call_expression', r + t)]
    WHEN 'java' THEN [('program', e.files), ('class_declaration', e.files), ('method_declaration', f), ('identifier', f + e.files), ('block_comment', d), ('line_comment', n), ('if_statement', r), ('try_statement', t), ('catch_clause', t), ('binary_expression', r + n), ('method_invocation', r + t)]
    WHEN 'php' THEN [('program', e.files), ('function_definition', f), ('name', f), ('comment', d + n), ('if_statement', r), ('try_statement', t), ('catch_clause', t), ('binary_expression', r + n), ('function_call_expression', r + t)]
    WHEN 'ruby' THEN [('program', m.files), ('method', f), ('identifier', f), ('comment', d + n), ('if', r), ('if_modifier', f), ('begin', t), ('rescue', t), ('binary', r + n), ('call', r + t)]
    WHEN 'rust' THEN [('source_file', m.files), ('function_item', f), ('identifier', f), ('block_comment', d), ('line_comment', n), ('if_expression', r), ('while_expression', t), ('binary_expression', r + t + n), ('call_expression', r + t)]
  END) AS x FROM s JOIN m USING (language) JOIN everything e USING (language)
)
SELECT language, x[1] AS type, x[2]::BIGINT AS nodes FROM rows WHERE x[2] > 0
""")
def language_outline_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of each type in the outlines of all texts of seven languages."""
    return language_nodes(spark, folder).groupBy("language", "type").agg(F.count("*").alias("nodes"))


@query(f"""
WITH {FIGURES}
SELECT language, file_id, (1 + 0.5 * (CASE WHEN language IN ('cpp', 'php') THEN r + n ELSE r + t + n END))::DOUBLE AS cyclomatic, 0::BIGINT AS cognitive,
  t > 0 AND language IN ('cpp', 'php') AS has_try, count(*) AS functions
FROM fn WHERE language IN ('c', 'cpp', 'go', 'php') GROUP BY ALL
""")
def language_function_figures(spark: SparkSession, folder: str) -> DataFrame:
    """Complexities and handling of the functions of all those texts; the analyzers know functions of four of the languages."""
    nodes = language_nodes(spark, folder)
    languages = nodes.where("parent_id is null").select("file_id", "language")
    figures = function_complexity(nodes).join(function_handling(nodes).select("file_id", "function_id", "has_try"), ["file_id", "function_id"])
    return figures.join(languages, "file_id").groupBy("language", "file_id", "cyclomatic", "cognitive", "has_try").agg(F.count("*").alias("functions"))


@query(f"""
WITH {FIGURES}, s AS (SELECT file_id, count(*) AS f, count(*) FILTER (doc) AS d, bool_or(first AND doc) AS top, sum(n) AS n FROM fn GROUP BY 1)
SELECT language, file_id, CASE WHEN language IN ('c', 'cpp', 'go', 'php') THEN coalesce(f, 0) ELSE 0 END::BIGINT AS total_functions,
  CASE WHEN language IN ('c', 'cpp', 'go', 'php') THEN coalesce(d, 0) ELSE 0 END::BIGINT AS documented_functions,
  (language = 'java')::BIGINT AS total_classes, language IN ('c', 'cpp') AND coalesce(top, false) AS has_module_docstring,
  CASE WHEN language IN ('c', 'cpp', 'go', 'php') THEN coalesce(2 * d + n, 0) WHEN language = 'ruby' THEN coalesce(3 * d + n, 0) ELSE 0 END::BIGINT AS comment_lines
FROM files LEFT JOIN s USING (file_id)
""")
def language_documentations(spark: SparkSession, folder: str) -> DataFrame:
    """Documentation of all those texts."""
    files = language_files(spark, folder).select("file_id", "language", F.lit(1).alias("total_lines"))
    found = file_documentation(language_nodes(spark, folder), files)
    return files.select("file_id", "language").join(found, "file_id").select(
        "language", "file_id", "total_functions", "documented_functions", "total_classes", "has_module_docstring", "comment_lines"
    )
