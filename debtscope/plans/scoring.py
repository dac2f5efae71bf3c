"""File scores end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from debtscope.functions.labels import severity
from debtscope.functions.scores import composite_score, content_size_score
from debtscope.functions.text import is_blank, line_count
from debtscope.operators.complexity import file_complexity, function_complexity
from debtscope.operators.documentation import file_documentation
from debtscope.operators.duplication import file_duplication
from debtscope.operators.handling import file_handling, function_handling

_DIMENSIONS = ("complexity_score", "duplication_score", "documentation_score", "error_handling_score")


def combine_scores(measured: DataFrame, nodes: DataFrame, weights: dict[str, float] | str | None = None) -> DataFrame:
    """Join the analyzers' file rows on the file and add composite and severity.

    ``measured`` holds ``file_id``, ``total_lines`` and the duplication columns.
    """
    keys = measured.select("file_id", "total_lines")
    complexity = file_complexity(function_complexity(nodes), keys)
    documentation = file_documentation(nodes, keys).drop("total_lines")
    handling = file_handling(function_handling(nodes), keys).drop("function_count")
    joined = measured.join(complexity, "file_id").join(documentation, "file_id").join(handling, "file_id")
    total = composite_score(*[F.col(c) for c in _DIMENSIONS], weights)
    return joined.withColumn("debt_score", total).withColumn("severity", severity(F.col("debt_score"), "file"))


def score_files(
    files: DataFrame, nodes: DataFrame, weights: dict[str, float] | str | None = None, min_block: int = 4, window: int = 6
) -> tuple[DataFrame, DataFrame]:
    """Scores of all readable files, and the rows that could not be scored with the reason.

    A file without a known language, with blank content or without nodes is an
    error row; the others are scored.
    """
    reason = (
        F.when(F.col("language").isNull(), "unsupported language")
        .when(F.col("content").isNull() | is_blank(F.col("content")), "empty file")
    )
    checked = files.withColumn("error", reason)
    parsed = nodes.where("parent_id is null").select("file_id")
    good = checked.where("error is null").drop("error")
    unparsed = good.join(parsed, "file_id", "left_anti").select("file_id", F.lit("no syntax tree").alias("error"))
    errors = checked.where("error is not null").select("file_id", "error").unionByName(unparsed)
    measured = file_duplication(good.join(parsed, "file_id", "left_semi"), min_block, window)
    return combine_scores(measured, nodes, weights), errors


def score_by_size(files: DataFrame) -> DataFrame:
    """Content-size scores of non-blank files: the path repositories take when structure is not read."""
    readable = files.where(~is_blank(F.col("content")))
    scored = readable.withColumn("total_lines", line_count(F.col("content"))).withColumn(
        "s", content_size_score(F.col("total_lines"), F.length("content"))
    )
    return scored.select(*[c for c in files.columns if c not in ("content", "file_size")], "total_lines", "s.*")
