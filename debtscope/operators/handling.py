"""Error handling on the node table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from debtscope.functions.rows import round_to
from debtscope.functions.scores import handling_score
from debtscope.functions.text import strip
from debtscope.operators.nodes import FUNCTION_TYPES, SCRIPT_LANGUAGES, inside
from debtscope.operators.running import running

# Names of calls that may fail, by language.
PYTHON_RISKY = (
    "open",
    "read",
    "write",
    "connect",
    "request",
    "get",
    "post",
    "execute",
    "cursor",
    "load",
    "dump",
    "loads",
    "dumps",
    "urlopen",
    "fetch",
    "send",
    "recv",
    "close",
)
SCRIPT_RISKY = (
    "fetch",
    "axios",
    "request",
    "readFile",
    "writeFile",
    "connect",
    "query",
    "execute",
    "parse",
    "stringify",
    "open",
    "send",
    "createElement",
)


def callee(text: Column) -> Column:
    """Last dotted part of what stands before the first bracket of a call."""
    return strip(F.element_at(F.split(F.substring_index(text, "(", 1), r"\.", -1), -1))


def is_risky(language: Column, type_: Column, text: Column) -> Column:
    """Call of a name in the risky set of its language."""
    name = callee(text)
    python = (language == "python") & (type_ == "call") & name.isin(*PYTHON_RISKY)
    script = language.isin(*SCRIPT_LANGUAGES) & (type_ == "call_expression") & name.isin(*SCRIPT_RISKY)
    return F.coalesce(python | script, F.lit(False))


def _handler_marks() -> list[Column]:
    language, kind = F.col("language"), F.col("type")
    python = language == "python"
    clause = python & (kind == "except_clause")
    bare = F.coalesce(F.col("text").rlike(r"^except\s*:"), F.lit(False))
    return [
        (kind == "try_statement").alias("opens_try"),
        (clause & bare).alias("bare"),
        ((clause & ~bare) | (~python & (kind == "catch_clause"))).alias("specific"),
        (kind == "finally_clause").alias("closes"),
        is_risky(language, kind, F.col("text")).alias("risky"),
        kind.isin(*FUNCTION_TYPES).alias("function"),
    ]


def function_handling(nodes: DataFrame) -> DataFrame:
    """Per function: try, bare, specific and finally flags, risky and handled calls, coverage.

    A risky call is handled when its lines lie inside those of a try of the
    same function. Instead of pairing calls with tries, a running maximum of
    the try ends in line order tells whether one reaches far enough.
    """
    marked = nodes.select("file_id", "node_id", "pre", "post", "start_line", "end_line", *_handler_marks()).where(
        "opens_try or bare or specific or closes or risky or function"
    )
    owners = marked.where("function").select(
        "file_id", F.col("node_id").alias("function_id"), F.col("pre").alias("f_pre"), F.col("post").alias("f_post")
    )
    spans = (
        inside(owners, marked.drop("node_id", "post", "function"))
        .groupBy("file_id", "function_id", "start_line", "end_line")
        .agg(
            F.bool_or("opens_try").alias("opens_try"),
            F.bool_or("bare").alias("bare"),
            F.bool_or("specific").alias("specific"),
            F.bool_or("closes").alias("closes"),
            F.count_if("risky").alias("risky"),
        )
    )
    reached = running(
        spans,
        ["file_id", "function_id"],
        F.floor(F.col("start_line") / 1024),
        ["start_line", F.col("end_line").desc()],
        maxima={"reach": F.when(F.col("opens_try"), F.col("end_line"))},
    )
    totals = reached.groupBy("file_id", "function_id").agg(
        F.bool_or("opens_try").alias("has_try"),
        F.bool_or("bare").alias("has_bare"),
        F.bool_or("specific").alias("has_specific"),
        F.bool_or("closes").alias("has_finally"),
        F.sum("risky").alias("risky_calls"),
        F.sum(F.when(F.col("reach") >= F.col("end_line"), F.col("risky")).otherwise(0)).alias("handled_calls"),
    )
    share = F.when(F.col("risky_calls") > 0, round_to(F.col("handled_calls") / F.col("risky_calls"), 4))
    return totals.withColumn("coverage", F.coalesce(share, F.col("has_try").cast("double")))


def file_handling(functions: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """File totals: functions with a try or a bare handler, calls, coverage and quality score."""
    totals = functions.groupBy("file_id").agg(
        F.count("*").alias("function_count"),
        F.count_if("has_try").alias("functions_with_handling"),
        F.count_if("has_bare").alias("bare_except_count"),
        F.count_if("has_try").alias("total_try_blocks"),
        F.sum("risky_calls").alias("total_risky_calls"),
        F.sum("handled_calls").alias("handled_risky_calls"),
    )
    if files is not None:
        totals = files.select("file_id").join(totals, "file_id", "left").na.fill(0)
    count = F.col("function_count")
    share = F.when(count > 0, round_to(F.col("functions_with_handling") / count, 4)).otherwise(F.lit(0.0))
    covered = totals.withColumn("handling_coverage", share)
    return covered.withColumn(
        "error_handling_score", handling_score(count, F.col("handling_coverage"), F.col("bare_except_count"))
    )
