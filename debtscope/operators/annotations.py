"""Per-file and per-review nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from debtscope.functions.labels import severity
from debtscope.functions.scores import checked_weights, score_breakdown, weights_map
from debtscope.schemas import VERIFICATION

# What reviewers are told and the scale they rate on.
REVIEW_RULES = (
    "Review each repository independently",
    "Do not discuss with other reviewers until both complete",
    "Use the 4-point rubric (0=None, 1=Minor, 2=Moderate, 3=Severe)",
    "AI identification: Score confidence 0-3 based on evidence",
)
RATING_LEVELS = ("None", "Minor", "Moderate", "Severe")


def function_notes(functions: DataFrame, threshold: str | None = None) -> DataFrame:
    """Functions with severity and lines counted from 0.

    With a ``threshold`` only what an editor shows inline stays: high always,
    medium only when the threshold is low.
    """
    notes = functions.select(
        "file_id",
        "name",
        (F.col("start_line") - 1).alias("start_line"),
        (F.col("end_line") - 1).alias("end_line"),
        "cyclomatic",
        "cognitive",
        severity(F.col("cyclomatic"), "function").alias("severity"),
    )
    if threshold is None:
        return notes
    shown = ["high", "medium"] if threshold == "low" else ["high"]
    return notes.where(F.col("severity").isin(*shown))


def documentation_gaps(entities: DataFrame) -> DataFrame:
    """Undocumented functions and classes, lines counted from 0."""
    return entities.where(~F.col("has_docstring")).select(
        "file_id", "name", "kind", (F.col("start_line") - 1).alias("start_line")
    )


def file_records(
    scores: DataFrame, functions: DataFrame, entities: DataFrame, weights: dict[str, float] | str | None = None
) -> DataFrame:
    """One nested record per file: score, severity, dimensions and annotation arrays."""
    used = checked_weights(weights)
    note = F.struct("start_line", "end_line", "name", "cyclomatic", "cognitive", "severity")
    notes = function_notes(functions).groupBy("file_id").agg(F.sort_array(F.collect_list(note)).alias("functions"))
    gap = F.struct("start_line", "name", F.col("kind").alias("type"))
    gaps = documentation_gaps(entities).groupBy("file_id").agg(F.sort_array(F.collect_list(gap)).alias("doc_gaps"))
    joined = scores.join(notes, "file_id", "left").join(gaps, "file_id", "left")
    dims = F.struct(
        F.struct(
            F.col("complexity_score").alias("score"), "avg_cyclomatic", "max_cyclomatic", "avg_cognitive", "function_count"
        ).alias("complexity"),
        F.struct(
            F.col("duplication_score").alias("score"),
            F.col("duplication_percent").alias("ratio_pct"),
            "duplicated_lines",
            "total_lines",
        ).alias("duplication"),
        F.struct(
            F.col("documentation_score").alias("score"),
            F.col("doc_coverage").alias("coverage_ratio"),
            F.col("documented_functions").alias("documented_funcs"),
            F.col("total_functions").alias("total_funcs"),
            F.col("has_module_docstring").alias("has_module_doc"),
        ).alias("documentation"),
        F.struct(
            F.col("error_handling_score").alias("score"),
            F.col("handling_coverage").alias("coverage_ratio"),
            "bare_except_count",
            F.col("functions_with_handling").alias("funcs_handled"),
            F.col("function_count").alias("total_functions"),
        ).alias("error_handling"),
    )
    return joined.select(
        "file_id",
        "language",
        F.col("debt_score").alias("total_score"),
        "severity",
        dims.alias("dimensions"),
        score_breakdown(
            *[F.col(f"{d}_score") for d in ("complexity", "duplication", "documentation", "error_handling")], used
        ).alias("breakdown"),
        weights_map(used).alias("weights"),
        F.struct(F.coalesce("functions", F.array()).alias("functions"), F.coalesce("doc_gaps", F.array()).alias("doc_gaps")).alias(
            "annotations"
        ),
    )


def review_forms(sample: DataFrame) -> DataFrame:
    """One blank review entry per sampled repository."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    blank = F.from_json(
        F.lit('{"ai_identification_evidence": [], "debt_severity_scores": {}, "comments": ""}'), VERIFICATION
    )
    return sample.select(
        "repo_id",
        text("name"),
        text("url"),
        text("language"),
        F.coalesce(F.col("size_kb").cast("long"), F.lit(0)).alias("size_kb"),
        F.coalesce(F.col("ai_commit_ratio").cast("double"), F.lit(0.0)).alias("ai_commit_ratio"),
        F.coalesce("ai_confidence", F.lit("")).alias("ai_confidence_auto"),
        blank.alias("verification"),
    )


def review_document(sample: DataFrame, created_at: str) -> DataFrame:
    """The whole review form as one row; the sample it holds is small by its own quota."""
    entry = F.struct(*review_forms(sample).columns)
    rubric = F.create_map(*[F.lit(x) for i, level in enumerate(RATING_LEVELS) for x in (str(i), level)])
    return review_forms(sample).agg(
        F.struct(
            F.lit(created_at).alias("created_at"),
            F.count("*").alias("total_repositories"),
            F.lit("1.0").alias("rubric_version"),
            F.array(*[F.lit(r) for r in REVIEW_RULES]).alias("reviewer_instructions"),
        ).alias("metadata"),
        F.first(rubric).alias("rubric"),
        F.sort_array(F.collect_list(entry)).alias("repositories"),
    )
