"""Tests and agreement against brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from debtscope.operators.agreement import kappa, overall_agreement
from debtscope.operators.ranks import exact_median
from debtscope.operators.rollup import cohort_moments, dashboard_stats, effect_of_moments
from debtscope.operators.stats import feature_importance, group_moments, mann_whitney, plain_effect, spearman, wilcoxon


def test_u_statistic_equals_pair_count(spark):
    rng = random.Random(1)
    a = [round(rng.random(), 2) for _ in range(130)]
    b = [round(rng.random() ** 1.3, 2) for _ in range(90)]
    df = spark.createDataFrame([("d", v, "ai") for v in a] + [("d", v, "human") for v in b], "dim string, v double, cohort string")
    row = mann_whitney(df, ["dim"], "v").first()
    pairs = sum(1.0 if x > y else 0.5 if x == y else 0.0 for x, y in itertools.product(a, b))
    assert row.statistic == pairs
    flipped = mann_whitney(df.withColumn("cohort", F.when(F.col("cohort") == "ai", "human").otherwise("ai")), ["dim"], "v").first()
    assert row.statistic + flipped.statistic == len(a) * len(b)
    assert abs(row.p_value - flipped.p_value) < 1e-9 and 0 < row.p_value < 1


def test_signed_ranks(spark):
    # Differences 1, 2, -3, 4, 0: zero dropped, ranks 1..4, the negative one holds rank 3.
    df = spark.createDataFrame([(2.0, 1.0), (4.0, 2.0), (1.0, 4.0), (9.0, 5.0), (3.0, 3.0)], "a double, b double")
    row = wilcoxon(df, "a", "b").first()
    assert (row.n_used, row.w_plus, row.w_minus, row.statistic) == (4, 7.0, 3.0, 3.0)


def test_exact_p_of_small_samples(spark):
    def p_of(a, b):
        df = spark.createDataFrame([("d", v, "ai") for v in a] + [("d", v, "human") for v in b], "dim string, v double, cohort string")
        return mann_whitney(df, ["dim"], "v").first().p_value

    assert abs(p_of([9.0], [1.0, 2.0, 3.0, 4.0]) - 0.4) < 1e-12
    assert abs(p_of([3.5], [1.0, 2.0, 3.0, 4.0]) - 0.8) < 1e-12
    a, b = [1.0, 5.0, 6.0, 7.5], [2.0, 3.0, 4.0, 8.0, 9.0]
    u = sum(x > y for x in a for y in b)
    extreme = max(u, 20 - u)
    orders = [sum(p) - 10 for p in itertools.combinations(range(1, 10), 4)]
    assert abs(p_of(a, b) - min(1.0, 2 * sum(x >= extreme for x in orders) / len(orders))) < 1e-12

    gaps = spark.createDataFrame([(float(i), 0.0) for i in (1, 2, 3, 4)], "a double, b double")
    assert wilcoxon(gaps, "a", "b").first().p_value == 0.125
    signs = [sum(r for r, s in zip((1, 2, 3, 4), m, strict=True) if s) for m in itertools.product((0, 1), repeat=4)]
    mixed = spark.createDataFrame([(1.0, 0.0), (2.0, 0.0), (0.0, 3.0), (4.0, 0.0)], "a double, b double")
    assert wilcoxon(mixed, "a", "b").first().p_value == 2 * sum(x <= 3 for x in signs) / 16


def test_rank_correlation(spark):
    rng = random.Random(2)
    data = [(rng.randint(0, 20), round(rng.random(), 2)) for _ in range(200)]

    def ranks(xs):
        return [sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2 for x in xs]

    x, y = ranks([d[0] for d in data]), ranks([d[1] for d in data])
    mx, my = sum(x) / 200, sum(y) / 200
    rho = sum((p - mx) * (q - my) for p, q in zip(x, y, strict=True)) / math.sqrt(
        sum((p - mx) ** 2 for p in x) * sum((q - my) ** 2 for q in y)
    )
    assert abs(spearman(spark.createDataFrame(data, "a int, b double"), "a", "b").first().rho - rho) < 1e-9


def test_exact_median(spark):
    import statistics

    rng = random.Random(4)
    data = [(rng.choice("abc"), rng.choice([1.0, 2.5, rng.random()])) for _ in range(301)] + [("one", 7.0), ("same", 3.0), ("same", 3.0)]
    got = {r.k: r.median for r in exact_median(spark.createDataFrame(data, "k string, v double"), ["k"], "v").collect()}
    for k in got:
        assert got[k] == statistics.median(v for g, v in data if g == k)


def test_effects_need_two_rows(spark):
    df = spark.createDataFrame([("x", 0.5, "ai"), ("x", 0.25, "human"), ("x", 0.75, "human")], "d string, v double, cohort string")
    assert group_moments(df, ["d"], "v").select(plain_effect()).first()[0] == 0.0
    labelled = df.select(F.col("v").alias("debt_score"), F.when(F.col("cohort") == "ai", "High").otherwise("None").alias("ai_confidence"), F.lit("Python").alias("language"))
    row = dashboard_stats(labelled).first()
    assert (row.total_repos, row.ai_repos, row.avg_human_score, row.effect_size, row.languages) == (3, 1, 0.5, 0.0, {"Python": 3})
    assert effect_of_moments(cohort_moments(labelled.where("debt_score < 0.6"))).first().total_repos == 2


def test_kappa(spark):
    rows = [("m", 1, 1)] * 20 + [("m", 1, 0)] * 5 + [("m", 0, 1)] * 10 + [("m", 0, 0)] * 15 + [("same", 2, 2)] * 4
    rows = {r.metric: r for r in kappa(spark.createDataFrame(rows, "metric string, r1 int, r2 int")).collect()}
    assert (rows["m"].kappa, rows["m"].interpretation, rows["m"].n_samples) == (0.4, "moderate agreement", 50)
    assert rows["same"].kappa is None and rows["same"].interpretation == "undefined"
    whole = overall_agreement(spark.createDataFrame([r.asDict() for r in rows.values()], "metric string, kappa double, n_samples int"))
    assert tuple(whole.first()) == (0.4, False, 0.6, 1)


def test_forest_needs_ten_rows(spark):
    df = spark.createDataFrame([(1, 2, 3, "High", "ai")] * 4, "stars int, forks int, size_kb int, ai_confidence string, cohort string")
    assert feature_importance(df).first().error


def test_many_equal_values_do_not_overflow(spark):
    df = spark.range(3_000_000).select(F.lit("d").alias("dim"), F.lit(0.5).alias("v"), F.when(F.col("id") % 2 == 0, "ai").otherwise("human").alias("cohort"))
    row = mann_whitney(df, ["dim"], "v").first()
    assert (row.n_ai, row.n_human, row.statistic, row.z) == (1_500_000, 1_500_000, 1.125e12, None)
    pairs = spark.range(3_000_000).select(F.lit(1.0).alias("a"), F.lit(0.5).alias("b"))
    assert wilcoxon(pairs, "a", "b").first().w_plus == 3_000_000 * 3_000_001 / 2


def test_small_groups_and_rows_without_a_cohort(spark):
    rows = [("one", "ai", 1.0), ("two", "ai", 1.0), ("two", "human", 2.0), ("two", None, 0.0), ("two", "other", 0.5)]
    got = {r.dim: r for r in mann_whitney(spark.createDataFrame(rows, "dim string, cohort string, v double"), ["dim"], "v").collect()}
    assert (got["one"].statistic, got["one"].p_value) == (None, None)
    assert (got["two"].statistic, got["two"].p_value) == (0.0, 1.0)


def test_method_of_the_rank_sum(spark):
    rows = [("d", "ai", float(i)) for i in range(5)] + [("d", "human", 100.0 + i) for i in range(20)]
    df = spark.createDataFrame(rows, "dim string, cohort string, v double")
    exact = 2 / 53130
    for method, p in (("auto", exact), ("exact", exact)):
        assert abs(mann_whitney(df, ["dim"], "v", method=method).first().p_value - p) < 1e-12
    assert mann_whitney(df, ["dim"], "v", method="normal").first().p_value > 5e-4
    with pytest.raises(ValueError):
        mann_whitney(df, ["dim"], "v", method="other")
