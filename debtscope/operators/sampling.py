"""Seeded samples and quotas.

Random order comes from an MD5 of seed and key, so a sample is the same on any
cluster and after any retry. Every cut is a rank filter, which Spark limits
inside each task before it shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from debtscope.functions.labels import size_tier, study_cohort
from debtscope.operators.dataset import keep_first
from debtscope.operators.paging import top_per_group


def draw(key: str, seed: int = 42) -> Column:
    """Sort value of a row in random order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows in a reproducible random order."""
    return df.orderBy(draw(key, seed), key)


def _quota_fill(df: DataFrame, priority: Column, key: str, seed: int, quota: int) -> DataFrame:
    """First ``quota`` rows by priority, then by draw."""
    return df.orderBy(priority, draw(key, seed), key).limit(quota)


def balanced_sample(df: DataFrame, key: str = "url", total: int = 40, ai_share: float = 0.5, seed: int = 42) -> DataFrame:
    """Equal cohorts: AI by confidence, human spread over languages; short cohorts are taken whole.

    Adds ``cohort``. The human part takes ``max(1, quota // languages)`` rows of
    each language, then random ones up to its quota.
    """
    ai_quota = int(total * ai_share)
    human_quota = total - ai_quota
    labelled = df.withColumn("cohort", study_cohort(F.col("ai_confidence")))
    high_first = F.when(F.col("ai_confidence") == "High", 0).otherwise(1)
    ai = _quota_fill(labelled.where("cohort = 'ai'"), high_first, key, seed, ai_quota)

    human = labelled.where("cohort = 'human'")
    languages = human.agg(F.greatest(F.lit(1), F.count_distinct(F.coalesce("language", F.lit(""))))).scalar()
    share = F.greatest(F.lit(1), F.floor(F.lit(human_quota) / languages))
    by_language = W.partitionBy("language").orderBy(draw(key, seed), key)
    # No language can give more than the quota, which bounds what is kept of a hot one.
    ranked = human.withColumn("_rank", F.row_number().over(by_language)).where(F.col("_rank") <= human_quota)
    stratum = F.col("language").isNotNull() & (F.col("_rank") <= share)
    strata = ranked.withColumn("_extra", F.when(stratum, 0).otherwise(1))
    chosen = strata.orderBy("_extra", draw(key, seed), key).limit(human_quota).drop("_rank", "_extra")
    return ai.unionByName(chosen)


def verification_sample(df: DataFrame, key: str = "repo_id", n: int = 10, seed: int = 42) -> DataFrame:
    """Rows for manual review, spread over confidence, then language and size tier.

    Each confidence level gives one row per (language, tier) and random ones up
    to ``n // levels``; levels follow in name order and the whole is cut to ``n``.
    """
    tiered = df.where("ai_confidence is not null").withColumn("size_tier", size_tier(F.col("size_kb")))
    levels = tiered.agg(F.greatest(F.lit(1), F.count_distinct("ai_confidence"))).scalar()
    random_order = [draw(key, seed), F.col(key)]
    in_cell = W.partitionBy("ai_confidence", "language", "size_tier").orderBy(*random_order)
    # More than n rows of one cell can never be chosen.
    celled = tiered.withColumn("_cell", F.row_number().over(in_cell)).where(F.col("_cell") <= n)
    stratified = (F.col("_cell") == 1) & F.col("language").isNotNull() & F.col("size_tier").isNotNull()
    in_level = W.partitionBy("ai_confidence").orderBy(F.when(stratified, 0).otherwise(1), *random_order)
    ranked = celled.withColumn("_first", stratified).withColumn("_rank", F.row_number().over(in_level)).where(F.col("_rank") <= n)
    kept = ranked.withColumn("_quota", F.floor(F.lit(n) / levels)).where("_first or _rank <= _quota")
    return kept.orderBy("ai_confidence", "_rank").limit(n).drop("_cell", "_rank", "_first", "_quota")


def collection_quota(
    df: DataFrame, query: str, order: Sequence[str], per_query: int, total: int
) -> DataFrame:
    """First rows of each query, at most ``per_query``, and at most ``total`` in query order."""
    capped = top_per_group(df, [query], [F.col(c) for c in order], per_query).drop("rank")
    return capped.orderBy(query, *order).limit(total)


def control_quota(df: DataFrame, query: str, order: Sequence[str], queries: int, total: int, key: str = "url") -> DataFrame:
    """Control set: an equal part of ``total`` per query, each address once, cut to ``total``."""
    taken = collection_quota(df, query, order, total // queries, total)
    return keep_first(taken, [key], [query, *order]).orderBy(query, *order).limit(total)


def not_sampled(df: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """Rows that a sample left out."""
    return df.join(sample.select(key).distinct(), key, "left_anti")
