"""Assistant markers in commit messages and the confidence they give."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Case-insensitive marker patterns, in reporting order.
MARKER_PATTERNS = (
    r"co-authored-by:\s*github\s*copilot",
    r"generated\s+by\s+(copilot|chatgpt|gpt-?4|claude|ai|llm)",
    r"ai[- ]generated",
    r"ai[- ]assisted",
    r"copilot[- ]suggested",
    r"\[copilot\]",
    r"\[ai\]",
    r"\[chatgpt\]",
    r"\[claude\]",
    r"auto[- ]generated\s+by\s+(ai|llm|copilot|chatgpt)",
)

# Fixed value: wording that alone makes a commit certain.
CERTAIN_WORDING = "co-authored-by: github copilot"


def marker_signals(message: Column, patterns: Sequence[str] = MARKER_PATTERNS) -> Column:
    """Patterns found in a message, in pattern order."""
    return F.array_compact(F.array(*[F.when(message.rlike(f"(?i){p}"), F.lit(p)) for p in patterns]))


def marker_count(message: Column, patterns: Sequence[str] = MARKER_PATTERNS) -> Column:
    """Number of different patterns found; repeated hits count once."""
    total = F.lit(0)
    for pattern in patterns:
        total = total + F.coalesce(message.rlike(f"(?i){pattern}"), F.lit(False)).cast("int")
    return total


def commit_confidence(message: Column, count: Column, certain: str = CERTAIN_WORDING) -> Column:
    """High, Medium or Low confidence for one commit."""
    sure = F.coalesce(F.lower(message).contains(certain), F.lit(False))
    return F.when((count >= 2) | sure, "High").when(count == 1, "Medium").otherwise("Low")


def ratio_confidence(share: Column) -> Column:
    """Repository confidence from its share of marked commits."""
    return F.when(share >= 0.20, "High").when(share >= 0.05, "Medium").when(share > 0, "Low").otherwise("None")


def likely_assisted(share: Column) -> Column:
    """More than one commit in twenty is marked."""
    return share > 0.05


def certainty_confidence(high: Column, marked: Column) -> Column:
    """Repository confidence from the share of High commits among marked ones."""
    share = high / marked
    return F.when(marked == 0, "None").when(share >= 0.5, "High").when(share >= 0.2, "Medium").otherwise("Low")
