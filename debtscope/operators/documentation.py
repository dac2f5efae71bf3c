"""Documentation coverage on the node table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from debtscope.functions.rows import ratio, round_to
from debtscope.functions.scores import documentation_score
from debtscope.functions.text import strip
from debtscope.operators.nodes import FUNCTION_TYPES, classes_of, functions_of, is_class


def _leading(nodes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Parents whose first candidate child is preceded by comments only.

    Children count from 0, so a child comes first when exactly as many comment
    siblings stand before it as its own ordinal says.
    """
    first = candidates.groupBy("file_id", "parent_id").agg(F.min("sibling_ord").alias("first"))
    comments = nodes.where("type = 'comment'").select("file_id", "parent_id", "sibling_ord")
    before = (
        first.where("first > 0")
        .join(comments, ["file_id", "parent_id"])
        .where("sibling_ord < first")
        .groupBy("file_id", "parent_id", "first")
        .agg(F.count("*").alias("before"))
        .where("before = first")
    )
    return first.where("first = 0").select("file_id", "parent_id").union(before.select("file_id", "parent_id"))


def _docstring_parents(nodes: DataFrame) -> DataFrame:
    """Python blocks and modules whose first statement is a triple-quoted string."""
    python = nodes.where("language = 'python'")
    text = F.col("text")
    strings = python.where((F.col("type") == "string") & (text.startswith('"""') | text.startswith("'''"))).select(
        "file_id", F.col("parent_id").alias("node_id")
    )
    statements = python.where("type = 'expression_statement'").select("file_id", "node_id", "parent_id", "sibling_ord")
    return _leading(python, statements.join(strings, ["file_id", "node_id"], "left_semi"))


def _documented_nodes(nodes: DataFrame) -> DataFrame:
    """Functions and classes that carry a docstring or a leading doc comment."""
    blocks = nodes.where("language = 'python' and type = 'block'").select(
        "file_id", F.col("parent_id").alias("owner"), F.col("node_id").alias("parent_id")
    )
    python = blocks.join(_docstring_parents(nodes), ["file_id", "parent_id"], "left_semi").select(
        "file_id", F.col("owner").alias("node_id")
    )
    script = nodes.where("language <> 'python'")
    notes = script.where((F.col("type") == "comment") & strip(F.col("text")).startswith("/**")).select(
        "file_id", "parent_id", (F.col("sibling_ord") + 1).alias("sibling_ord")
    )
    owners = script.where(F.col("type").isin(*FUNCTION_TYPES, "class_declaration")).select(
        "file_id", "parent_id", "sibling_ord", "node_id"
    )
    commented = owners.join(notes, ["file_id", "parent_id", "sibling_ord"], "left_semi").select("file_id", "node_id")
    return python.union(commented).distinct()


def documented_modules(nodes: DataFrame) -> DataFrame:
    """Files that open with a docstring, or in scripts with a block comment."""
    roots = nodes.where("parent_id is null").select("file_id", F.col("node_id").alias("parent_id"))
    block_comments = nodes.where(
        (F.col("language") != "python") & (F.col("type") == "comment") & F.col("text").startswith("/*")
    ).select("file_id", "parent_id", "sibling_ord")
    opened = _docstring_parents(nodes).union(_leading(nodes, block_comments))
    return roots.join(opened, ["file_id", "parent_id"], "left_semi").select("file_id")


def documented_entities(nodes: DataFrame) -> DataFrame:
    """Functions and classes with a flag telling whether they are documented."""
    owners = functions_of(nodes).withColumn("kind", F.lit("function")).union(
        classes_of(nodes).withColumn("kind", F.lit("class"))
    )
    marked = _documented_nodes(nodes).withColumn("has_docstring", F.lit(True))
    return owners.join(marked, ["file_id", "node_id"], "left").select(
        "file_id",
        "kind",
        "name",
        F.coalesce("has_docstring", F.lit(False)).alias("has_docstring"),
        "start_line",
    )


def _doc_marks(nodes: DataFrame) -> DataFrame:
    """Functions, classes, roots and comments in one pass over the nodes: ``file_id, role, documented, lines``.

    A string marks its statement, a statement or comment that comes first marks
    what holds it, a block marks its owner. Each step is one aggregation or
    window keyed by a node or its parent; rows that take no part in a step pass
    through it under their own key.
    """
    language, kind, text = F.col("language"), F.col("type"), F.col("text")
    python = language == "python"
    quoted = python & (kind == "string") & (text.startswith('"""') | text.startswith("'''"))
    role = (
        F.when(F.col("parent_id").isNull(), "root")
        .when(kind.isin(*FUNCTION_TYPES), "function")
        .when(is_class(language, kind), "class")
        .when(kind == "comment", "comment")
        .when(python & (kind == "block"), "block")
        .when(python & (kind == "expression_statement"), "statement")
    )
    own = F.struct(
        role.alias("role"), python.alias("python"), "parent_id", "sibling_ord",
        F.when(kind == "comment", F.col("end_line") - F.col("start_line") + 1).otherwise(0).alias("lines"),
        (~python & (kind == "comment") & text.startswith("/*")).alias("block_note"),
        (~python & (kind == "comment") & strip(text).startswith("/**")).alias("doc_note"),
    )
    keyed = nodes.where(role.isNotNull() | quoted).select(
        "file_id", F.when(quoted, F.col("parent_id")).otherwise(F.col("node_id")).alias("node_id"), F.when(role.isNotNull(), own).alias("own"), quoted.alias("quoted")
    )
    stated = (
        keyed.groupBy("file_id", "node_id")
        .agg(F.max("own").alias("own"), F.bool_or("quoted").alias("quoted"))
        .where(F.col("own").isNotNull() & ((F.col("own.role") != "statement") | F.col("quoted")))
        .select("file_id", "node_id", "own.*")
    )

    siblings = W.partitionBy("file_id", "parent_id").orderBy("sibling_ord", "node_id")
    before = F.count_if(F.col("role") == "comment").over(siblings.rowsBetween(W.unboundedPreceding, -1))
    last = F.lag(F.when(F.col("doc_note"), F.col("sibling_ord"))).over(siblings)
    first = F.col("sibling_ord") == F.col("before")
    placed = stated.withColumn("before", before).withColumn("last", last)
    leads = first & ((F.col("role") == "statement") | F.col("block_note"))
    noted = F.col("role").isin("function", "class") & ~F.col("python") & (F.col("last") + 1 == F.col("sibling_ord"))
    # A leading statement or comment speaks for its parent, everything else but a statement for itself.
    mark = lambda node, mine, said, note, itself: F.struct(
        node.alias("node_id"), F.when(mine, F.struct("role", "parent_id", "lines")).alias("own"), said.alias("stated"), note.alias("block_note"), itself.alias("noted")
    )
    no, yes = F.lit(False), F.lit(True)
    marks = F.array_compact(
        F.array(
            F.when(F.col("role") != "statement", mark(F.col("node_id"), yes, no, no, F.coalesce(noted, no))),
            F.when(leads, mark(F.col("parent_id"), no, F.col("role") == "statement", F.col("block_note"), no)),
        )
    )
    held = (
        placed.select("file_id", F.inline(marks))
        .groupBy("file_id", "node_id")
        .agg(F.max("own").alias("own"), F.bool_or("stated").alias("stated"), F.bool_or("block_note").alias("block_note"), F.bool_or("noted").alias("noted"))
        .where(F.col("own").isNotNull() & ((F.col("own.role") != "block") | F.col("stated")))
        .select("file_id", "node_id", "own.*", "stated", "block_note", "noted")
    )
    block = F.col("role") == "block"
    owners = held.select(
        "file_id",
        F.when(block, F.col("parent_id")).otherwise(F.col("node_id")).alias("node_id"),
        F.when(~block, F.struct("role", "lines")).alias("own"),
        F.when(block, yes).when(F.col("role") == "root", F.col("stated") | F.col("block_note")).otherwise(F.col("noted")).alias("documented"),
    )
    return (
        owners.groupBy("file_id", "node_id")
        .agg(F.max("own").alias("own"), F.bool_or("documented").alias("documented"))
        .where(F.col("own").isNotNull())
        .select("file_id", "own.role", "own.lines", F.col("documented").cast("int").alias("documented"))
    )


def file_documentation(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Coverage, comment density and score per file; ``files`` gives ``file_id`` and ``total_lines``."""
    is_role = lambda name: (F.col("role") == name).cast("int")
    totals = _doc_marks(nodes).groupBy("file_id").agg(
        F.sum(is_role("function")).alias("total_functions"),
        F.sum(is_role("function") * F.col("documented")).alias("documented_functions"),
        F.sum(is_role("class")).alias("total_classes"),
        F.sum(is_role("class") * F.col("documented")).alias("documented_classes"),
        F.max(is_role("root") * F.col("documented")).alias("module_doc"),
        F.sum("lines").cast("long").alias("comment_lines"),
    )
    joined = files.select("file_id", F.col("total_lines").cast("long").alias("total_lines")).join(totals, "file_id", "left").na.fill(0)
    units = F.col("total_functions") + F.col("total_classes") + F.when(F.col("total_lines") > 0, 1).otherwise(0)
    documented = F.col("documented_functions") + F.col("documented_classes") + F.col("module_doc")
    return (
        joined.withColumn("doc_coverage", round_to(ratio(documented, units, 1.0), 4))
        .withColumn("comment_density", round_to(ratio(F.col("comment_lines"), F.col("total_lines")), 4))
        .withColumn("has_module_docstring", F.col("module_doc") > 0)
        .drop("module_doc")
        .withColumn("documentation_score", documentation_score(F.col("doc_coverage")))
    )
