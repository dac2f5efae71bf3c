"""Selections and containment on the syntax-node table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from debtscope.functions.text import line_comment, split_lines, strip

FUNCTION_TYPES = ("function_definition", "function_declaration")
NAME_TYPES = ("identifier", "property_identifier")
IMPORT_TYPES = ("import_statement", "import_from_statement")
SCRIPT_LANGUAGES = ("javascript", "typescript")


def nodes_of_type(nodes: DataFrame, *types: str) -> DataFrame:
    """Nodes of the given types."""
    return nodes.where(F.col("type").isin(*types))


def is_class(language: Column, type_: Column, parser_rule: bool = False) -> Column:
    """Class nodes: ``class_definition`` in the parser, and in scripts ``class_declaration`` for documentation."""
    if parser_rule:
        return type_ == "class_definition"
    return type_ == F.when(language == "python", "class_definition").otherwise("class_declaration")


def named(nodes: DataFrame, wanted: Column) -> DataFrame:
    """Wanted nodes with the text of their first identifier child as ``name``.

    Owners and identifiers meet in one aggregation keyed by the owner, so no
    join and no sort of the siblings is needed.
    """
    owner = F.struct("language", "type", "parent_id", "sibling_ord", "pre", "post", "start_line", "end_line")
    keyed = nodes.withColumn("_own", wanted).where(F.col("_own") | F.col("type").isin(*NAME_TYPES))
    grouped = (
        keyed.select(
            "file_id",
            F.when(F.col("_own"), F.col("node_id")).otherwise(F.col("parent_id")).alias("node_id"),
            F.when(F.col("_own"), owner).alias("owner"),
            F.when(~F.col("_own"), F.struct("sibling_ord", "text")).alias("child"),
        )
        .groupBy("file_id", "node_id")
        .agg(F.max("owner").alias("owner"), F.min("child").alias("child"))
    )
    return grouped.where(F.col("owner").isNotNull()).select(
        "file_id",
        "node_id",
        "owner.*",
        F.coalesce("child.text", F.lit("<anonymous>")).alias("name"),
        (F.col("owner.end_line") - F.col("owner.start_line") + 1).alias("line_count"),
    )


def functions_of(nodes: DataFrame) -> DataFrame:
    """Named functions; arrows and methods are not functions here."""
    return named(nodes, F.col("type").isin(*FUNCTION_TYPES))


def classes_of(nodes: DataFrame, parser_rule: bool = False) -> DataFrame:
    """Named classes."""
    return named(nodes, is_class(F.col("language"), F.col("type"), parser_rule))


def imports_of(
    nodes: DataFrame, files: DataFrame, content: str = "content", may_import: Column | None = None
) -> DataFrame:
    """Import statements with their line number and the trimmed text of that line.

    ``may_import`` is a condition on ``body``, the line. Only lines that meet it
    are shuffled; by default those with the words the grammars start imports with.
    """
    wanted = nodes_of_type(nodes, *IMPORT_TYPES).select("file_id", F.col("start_line").alias("line"))
    lines = files.select("file_id", F.posexplode(split_lines(F.col(content))).alias("at", "body"))
    keyword = F.col("body").rlike(r"\b(?:import|from|require)\b")
    kept = lines.where(keyword if may_import is None else may_import).withColumn("line", F.col("at") + 1).drop("at")
    return wanted.join(kept, ["file_id", "line"]).select(
        "file_id", "line", strip(F.col("body")).alias("text")
    )


def comments_of(files: DataFrame, content: str = "content", key: str = "file_id") -> DataFrame:
    """Line comments found by text scan."""
    lines = files.select(key, F.posexplode(split_lines(F.col(content))).alias("at", "body"))
    return lines.select(key, (F.col("at") + 1).alias("line"), line_comment(F.col("body")).alias("text")).where(
        F.length("text") > 0
    )


def comment_count(content: Column) -> Column:
    """Number of line comments of a text, inside the row."""
    return F.size(F.filter(split_lines(content), lambda line: F.length(line_comment(line)) > 0))


def inside(functions: DataFrame, members: DataFrame, block: int = 256) -> DataFrame:
    """Pairs of a function and the nodes of its subtree, itself included.

    Positions are cut into short blocks; a function is sent to the blocks it
    spans and a node to its own one. The join key is (file, block), so a huge
    file is spread over many keys and each candidate list stays short.
    """
    spans = functions.withColumn(
        "_block", F.explode(F.sequence(F.floor(F.col("f_pre") / block), F.floor(F.col("f_post") / block)))
    )
    points = members.withColumn("_block", F.floor(F.col("pre") / block))
    return (
        spans.join(points, ["file_id", "_block"])
        .where((F.col("pre") >= F.col("f_pre")) & (F.col("pre") <= F.col("f_post")))
        .drop("_block")
    )


def file_outline_metrics(nodes: DataFrame, files: DataFrame, content: str = "content") -> DataFrame:
    """Line, function, class, import and comment counts per file; all but lines are 0 without nodes."""
    kind = F.col("type")
    span = F.col("end_line") - F.col("start_line") + 1
    counts = nodes.groupBy("file_id").agg(
        F.count_if(kind.isin(*FUNCTION_TYPES)).alias("function_count"),
        F.count_if(kind == "class_definition").alias("class_count"),
        F.count_if(kind.isin(*IMPORT_TYPES)).alias("import_count"),
        F.max(F.when(kind.isin(*FUNCTION_TYPES), span)).alias("max_function_length"),
        F.max(F.when(kind == "class_definition", span)).alias("max_class_length"),
    )
    text = files.select(
        "file_id", F.size(split_lines(F.col(content))).alias("line_count"), comment_count(F.col(content)).alias("_comments")
    )
    joined = text.join(counts, "file_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.select(
        "file_id",
        F.col("line_count").cast("long").alias("line_count"),
        zero("function_count"),
        zero("class_count"),
        zero("import_count"),
        F.when(F.col("function_count").isNotNull(), F.col("_comments")).otherwise(0).cast("long").alias("comment_count"),
        zero("max_function_length"),
        zero("max_class_length"),
    )
