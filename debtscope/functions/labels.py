"""Labels: languages, severities, tiers, cohorts and wordings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language by file extension.
PARSER_LANGUAGES = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".java": "java",
    ".c": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".go": "go",
    ".rs": "rust",
    ".rb": "ruby",
    ".php": "php",
}

# Languages of a repository blob that are read for scoring.
BLOB_LANGUAGES = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
}

# Walked repositories also count markup and style sheets.
REPOSITORY_LANGUAGES = {
    **PARSER_LANGUAGES,
    ".html": "html",
    ".htm": "html",
    ".css": "css",
}


def file_extension(path: Column) -> Column:
    """Lower-cased suffix of the last path part, with its dot; empty when none.

    A leading dot does not make a suffix and neither does a trailing one.
    """
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def language_of(path: Column, languages: dict[str, str] | None = None) -> Column:
    """Language of a path by its extension, null when unknown."""
    pairs = (languages or PARSER_LANGUAGES).items()
    mapping = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.try_element_at(mapping, file_extension(path))


def file_severity(score: Column) -> Column:
    """Severity of one file score: cuts at 0.30 and 0.60."""
    return F.when(score < 0.30, "low").when(score < 0.60, "medium").when(score.isNotNull(), "high")


def repository_severity(score: Column) -> Column:
    """Severity of a repository score: cuts at 0.4 and 0.7."""
    return F.when(score < 0.4, "LOW").when(score < 0.7, "MEDIUM").when(score.isNotNull(), "HIGH")


def _strict(score: Column, words: tuple[str, str, str]) -> Column:
    low, medium, high = words
    return F.when(score > 0.6, high).when(score > 0.3, medium).when(score.isNotNull(), low)


SEVERITY_SCHEMES = {
    # file score, half-open cuts
    "file": file_severity,
    # content-size score of a single text
    "content": repository_severity,
    # repository rollup
    "repository": repository_severity,
    # score from metadata alone, strict cuts
    "metadata": lambda s: _strict(s, ("LOW", "MEDIUM", "HIGH")),
    # stored dataset rows, closed cuts
    "dataset": lambda s: F.when(s >= 0.6, "HIGH").when(s >= 0.3, "MEDIUM").when(s.isNotNull(), "LOW"),
    # cyclomatic number of one function
    "function": lambda s: F.when(s > 15, "high").when(s > 7, "medium").when(s.isNotNull(), "low"),
    # mean score of a directory, strict cuts
    "directory": lambda s: _strict(s, ("low", "medium", "high")),
}


def severity(score: Column, scheme: str) -> Column:
    """Severity word under a named scheme of ``SEVERITY_SCHEMES``."""
    if scheme not in SEVERITY_SCHEMES:
        raise ValueError(f"unknown severity scheme {scheme!r}, use one of {sorted(SEVERITY_SCHEMES)}")
    return SEVERITY_SCHEMES[scheme](score)


def size_tier(size: Column) -> Column:
    """Small, Medium or Large with right-closed bounds; null outside them."""
    return (
        F.when((size > 0) & (size <= 15000), "Small")
        .when((size > 15000) & (size <= 35000), "Medium")
        .when((size > 35000) & (size <= 50000), "Large")
    )


def study_cohort(confidence: Column) -> Column:
    """AI for High and Medium, human for Low and None."""
    return F.when(confidence.isin("High", "Medium"), "ai").when(confidence.isin("Low", "None"), "human")


def dashboard_cohort(confidence: Column) -> Column:
    """AI for anything but the label None, a missing label included."""
    return F.when(confidence == "None", "human").otherwise("ai")


def effect_words(d: Column) -> Column:
    """Wording of an effect size; a missing one is undefined."""
    size = F.abs(d)
    return (
        F.when(d.isNull() | F.isnan(d), "undefined")
        .when(size < 0.2, "negligible")
        .when(size < 0.5, "small")
        .when(size < 0.8, "medium")
        .otherwise("large")
    )


def kappa_words(kappa: Column) -> Column:
    """Wording of an agreement value."""
    return (
        F.when(kappa.isNull(), "undefined")
        .when(kappa < 0, "poor (less than chance)")
        .when(kappa < 0.2, "slight agreement")
        .when(kappa < 0.4, "fair agreement")
        .when(kappa < 0.6, "moderate agreement")
        .when(kappa < 0.8, "substantial agreement")
        .otherwise("almost perfect agreement")
    )


def age_days(moment: Column, as_of: Column) -> Column:
    """Whole days between a timestamp and a reference time."""
    return F.floor((F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(moment.cast("timestamp"))) / 86400)
