"""Sorted pages and top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def page(
    df: DataFrame, sort_by: str, tiebreak: Sequence[str], number: int = 1, per_page: int = 20, descending: bool = True
) -> DataFrame:
    """One page of the sorted rows.

    Limit and offset on a sort run as a top-k, so only the rows up to the end
    of the page leave each task. An unknown sort column leaves the tiebreak.
    """
    order: list[Column] = [F.col(c).asc() for c in tiebreak]
    if sort_by in df.columns:
        key = F.col(sort_by)
        order.insert(0, key.desc_nulls_last() if descending else key.asc_nulls_last())
    return df.orderBy(*order).offset((number - 1) * per_page).limit(per_page)


def page_info(df: DataFrame, number: int = 1, per_page: int = 20) -> DataFrame:
    """Row count and page count that go with a page."""
    return df.agg(F.count("*").alias("total")).select(
        "total",
        F.lit(number).alias("page"),
        F.lit(per_page).alias("per_page"),
        F.ceil(F.col("total") / per_page).alias("pages"),
    )


def newest(df: DataFrame, tiebreak: Sequence[str], number: int = 1, per_page: int = 20, stamp: str = "created_at") -> DataFrame:
    """One page of a history, newest first."""
    return page(df, stamp, tiebreak, number, per_page)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows of each group with their ``rank``."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def top_functions(functions: DataFrame, k: int = 20) -> DataFrame:
    """Most complex functions of each file."""
    return top_per_group(functions, ["file_id"], [F.col("cyclomatic").desc(), F.col("start_line"), F.col("name")], k)


def first_gaps(gaps: DataFrame, k: int = 15) -> DataFrame:
    """First undocumented entities of each file: functions, then classes, in line order."""
    kind = F.when(F.col("kind") == "function", 0).otherwise(1)
    return top_per_group(gaps, ["file_id"], [kind, F.col("start_line"), F.col("name")], k)


def top_files(scores: DataFrame, k: int = 40, score: str = "debt_score", tiebreak: str = "path") -> DataFrame:
    """Files with the highest scores."""
    return scores.orderBy(F.col(score).desc(), F.col(tiebreak)).limit(k)
