"""The study from raw datasets to its report."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from debtscope.functions.labels import study_cohort
from debtscope.operators.dataset import filter_dataset, merge_datasets
from debtscope.operators.rollup import cohort_description
from debtscope.operators.sampling import balanced_sample
from debtscope.operators.stats import as_long, dimension_tests, score_test


def prepare_dataset(
    datasets: Sequence[DataFrame], as_of: Column, key: str = "url", row_order: str = "row_ord", total: int = 40
) -> DataFrame:
    """Merge, keep first rows, filter and balance; ``cohort`` is added."""
    return balanced_sample(filter_dataset(merge_datasets(datasets, key, row_order), as_of), key, total)


def study_report(scored: DataFrame) -> DataFrame:
    """Both research questions and the description as one long table (test, group, metric, value).

    ``scored`` holds the score columns and ``ai_confidence``; ``cohort`` is
    derived where it is absent.
    """
    if "cohort" not in scored.columns:
        scored = scored.withColumn("cohort", study_cohort(F.col("ai_confidence")))
    first = score_test(scored)
    parts = [
        as_long(first.withColumn("power_value", F.col("power.power")), "rq1", ["measure"]),
        as_long(dimension_tests(scored), "rq2", ["dimension"]),
        as_long(cohort_description(scored), "descriptive", ["cohort"]),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Report rows as JSON."""
    report.write.mode(mode).json(path)
