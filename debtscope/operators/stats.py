"""Two-group tests, effect sizes, correlation and feature importance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from debtscope.functions.exact import RANK_SUM_LIMIT, RANK_SUM_PAIRS, SIGNED_RANK_LIMIT, rank_sum_p, signed_rank_p
from debtscope.functions.labels import effect_words
from debtscope.functions.scores import DEFAULT_WEIGHTS, approximate_power, two_sided_p
from debtscope.operators.ranks import exact_median, ranked_values
from debtscope.schemas import DIMENSION_COLUMNS

ALPHA = 0.05
FEATURES = ("stars", "forks", "size_kb", "ai_confidence_high", "ai_confidence_medium", "ai_confidence_low")


def bonferroni(p: Column, tests: int) -> Column:
    """p-value times the number of tests, at most 1."""
    return F.when(p.isNotNull(), F.least(F.lit(1.0), p * tests))


def group_moments(df: DataFrame, keys: Sequence[str], value: str, group: str = "cohort") -> DataFrame:
    """Size, mean and both variances of the two groups in one pass."""
    aggregates = []
    for name in ("ai", "human"):
        part = F.when(F.col(group) == name, F.col(value))
        aggregates += [
            F.count(part).alias(f"n_{name}"),
            F.avg(part).alias(f"mean_{name}"),
            F.var_samp(part).alias(f"var_{name}"),
            F.stddev_pop(part).alias(f"std_{name}"),
        ]
    return df.groupBy(*keys).agg(*aggregates)


def cohens_d() -> Column:
    """Standardised difference with the pooled deviation; null when it is undefined."""
    n1, n2, v1, v2 = (F.col(c) for c in ("n_ai", "n_human", "var_ai", "var_human"))
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
    gap = F.col("mean_ai") - F.col("mean_human")
    return F.when(pooled.isNull() | F.isnan(pooled), F.lit(None).cast("double")).when(pooled < 1e-12, F.lit(0.0)).otherwise(gap / pooled)


def plain_effect() -> Column:
    """Standardised difference with the plain mean of both variances; 0 unless both groups have two rows."""
    pooled = (F.col("var_ai") + F.col("var_human")) / 2
    usable = (F.col("n_ai") > 1) & (F.col("n_human") > 1) & (pooled > 1e-15)
    return F.when(usable, (F.col("mean_ai") - F.col("mean_human")) / F.sqrt(pooled)).otherwise(F.lit(0.0))


def _exact_if(method: str, small: Column, untied: Column) -> Column:
    if method not in ("auto", "exact", "normal"):
        raise ValueError(f"unknown method {method!r}")
    return {"auto": small & untied, "exact": untied, "normal": F.lit(False)}[method]


def mann_whitney(df: DataFrame, keys: Sequence[str], value: str, group: str = "cohort", method: str = "auto") -> DataFrame:
    """U statistic of the first group, tie-corrected z with continuity correction and two-sided p.

    Only rows of the two groups are ranked. ``method`` says how p comes about:
    "normal" by the approximation, "exact" by counting orders where nothing
    ties, "auto" exactly where nothing ties, one group has at most eight rows
    and the sizes multiply to at most ten thousand. Where a group is empty
    statistics are null.
    """
    ours = df.where(F.col(group).isin("ai", "human"))
    ranked = ranked_values(ours, keys, value, {"n1": F.col(group) == "ai", "n2": F.col(group) == "human"})
    n, rank = F.col("n"), F.col("rank")
    sums = ranked.groupBy(*keys).agg(
        F.sum("n1").alias("n_ai"),
        F.sum("n2").alias("n_human"),
        F.sum(F.col("n1") * rank).alias("rank_sum"),
        F.sum(F.pow(n.cast("double"), 3) - n).alias("ties"),
    )
    n1, n2 = F.col("n_ai").cast("double"), F.col("n_human").cast("double")
    total, product = n1 + n2, n1 * n2
    both = (n1 > 0) & (n2 > 0)
    u = F.when(both, F.col("rank_sum") - n1 * (n1 + 1) / 2)
    variance = F.when(both, product / 12 * (total + 1 - F.col("ties") / (total * (total - 1))))
    distance = F.greatest(F.abs(F.col("statistic") - product / 2) - 0.5, F.lit(0.0))
    small = (F.least("n_ai", "n_human") <= RANK_SUM_LIMIT) & (product <= RANK_SUM_PAIRS)
    exact = both & _exact_if(method, small, F.col("ties") == 0)
    return (
        sums.withColumn("statistic", u)
        .withColumn("sigma", F.sqrt(variance))
        .withColumn("z", F.when(F.col("sigma") > 0, distance / F.col("sigma")))
        .withColumn(
            "p_value",
            F.when(exact, rank_sum_p(F.col("statistic"), F.col("n_ai"), F.col("n_human"))).otherwise(two_sided_p(F.col("z"))),
        )
        .select(*keys, "n_ai", "n_human", "statistic", "z", "p_value")
    )


def long_dimensions(df: DataFrame, cohort: str = "cohort") -> DataFrame:
    """One row per dimension value: ``dimension``, ``value``, ``cohort``."""
    return df.select(cohort, *DIMENSION_COLUMNS).unpivot([cohort], list(DIMENSION_COLUMNS), "dimension", "value")


def dimension_tests(df: DataFrame) -> DataFrame:
    """Mann-Whitney, means and effect size of each dimension between the cohorts."""
    values = long_dimensions(df.where("cohort is not null"))
    tests = mann_whitney(values, ["dimension"], "value")
    effects = group_moments(values, ["dimension"], "value").withColumn("effect_size", cohens_d())
    corrected = bonferroni(F.col("p_value"), len(DIMENSION_COLUMNS))
    return (
        tests.join(effects.select("dimension", "mean_ai", "mean_human", "effect_size"), "dimension")
        .withColumn("p_value_bonferroni", corrected)
        .withColumn("significant_bonferroni", F.col("p_value_bonferroni") < ALPHA)
        .withColumn("effect_size_interpretation", effect_words(F.col("effect_size")))
    )


def wilcoxon(pairs: DataFrame, first: str, second: str, method: str = "auto") -> DataFrame:
    """Signed-rank test on paired columns: zero differences dropped, ties averaged.

    ``method`` is "normal", "exact" (where nothing ties) or "auto": exact for up
    to fifty untied differences.
    """
    # Equal pairs are counted before the differences are rounded and ranked.
    counted = pairs.groupBy(F.col(first).alias("a"), F.col(second).alias("b")).agg(F.count("*").alias("rows"))
    gaps = counted.select(F.round(F.col("a") - F.col("b"), 10).alias("gap"), "rows").where("gap <> 0")
    signed = gaps.select(F.abs("gap").alias("size"), (F.col("gap") > 0).alias("up"), "rows")
    ranked = ranked_values(signed, [], "size", {"n_up": F.col("up"), "n_down": ~F.col("up")}, weight="rows")
    size = F.col("n")
    sums = ranked.agg(
        F.sum("n").cast("double").alias("n"),
        F.sum(F.col("n_up") * F.col("rank")).alias("w_plus"),
        F.sum(F.col("n_down") * F.col("rank")).alias("w_minus"),
        F.sum(F.pow(size.cast("double"), 3) - size).alias("ties"),
    )
    n = F.col("n")
    variance = (n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24
    small = (n >= 1) & _exact_if(method, n <= SIGNED_RANK_LIMIT, F.col("ties") == 0)
    return (
        sums.withColumn("statistic", F.least("w_plus", "w_minus"))
        .withColumn("z", F.when(variance > 0, (F.col("statistic") - n * (n + 1) / 4) / F.sqrt(variance)))
        .withColumn("p_value", F.when(small, signed_rank_p(F.col("statistic"), n)).otherwise(two_sided_p(F.col("z"))))
        .select(n.cast("long").alias("n_used"), "w_plus", "w_minus", "statistic", "z", "p_value")
    )


def _beside(row: DataFrame, other: DataFrame) -> DataFrame:
    """Columns of two one-row frames in one row."""
    record = other.select(F.struct("*").alias("_other")).scalar()
    return row.withColumn("_other", record).select(*row.columns, *[F.col(f"_other.{c}").alias(c) for c in other.columns])


def score_test(df: DataFrame, score: str = "debt_score", tests: int = 3) -> DataFrame:
    """Unpaired comparison of one score: sizes, means, medians, spread, test, effect and power."""
    labelled = df.where(F.col("cohort").isin("ai", "human") & F.col(score).isNotNull())
    medians = exact_median(labelled, ["cohort"], score)
    wide = medians.agg(
        *[F.max(F.when(F.col("cohort") == g, F.col("median"))).alias(f"median_{g}") for g in ("ai", "human")]
    )
    test = mann_whitney(labelled, [], score).drop("n_ai", "n_human")
    joined = _beside(_beside(group_moments(labelled, [], score), test), wide).withColumn("effect_size", cohens_d())
    joined = joined.withColumn("measure", F.lit(score))
    corrected = bonferroni(F.col("p_value"), tests)
    return (
        joined.withColumn("p_value_bonferroni", corrected)
        .withColumn("significant_bonferroni", corrected < ALPHA)
        .withColumn("significant", F.col("p_value") < ALPHA)
        .withColumn("effect_size_interpretation", effect_words(F.col("effect_size")))
        .withColumn("power", approximate_power(F.col("effect_size"), F.col("n_ai"), F.col("n_human")))
    )


def paired_score_test(pairs: DataFrame, first: str, second: str, tests: int = 3) -> DataFrame:
    """Paired comparison: signed-rank test with size, mean and spread of both columns."""
    described = pairs.where(F.col(first).isNotNull() & F.col(second).isNotNull())
    moments = described.agg(
        F.count("*").alias("n_pairs"),
        F.avg(first).alias("mean_ai"),
        F.avg(second).alias("mean_human"),
        F.stddev_pop(first).alias("std_ai"),
        F.stddev_pop(second).alias("std_human"),
    )
    return (
        _beside(moments, wilcoxon(described, first, second))
        .withColumn("p_value_bonferroni", bonferroni(F.col("p_value"), tests))
        .withColumn("significant_bonferroni", F.col("p_value_bonferroni") < ALPHA)
    )


def spearman(df: DataFrame, first: str, second: str) -> DataFrame:
    """Rank correlation of two columns with average ranks.

    Equal pairs are counted before ranks are joined, so a frequent value is one
    row however many rows hold it.
    """
    rows = df.where(F.col(first).isNotNull() & F.col(second).isNotNull())
    pairs = rows.groupBy(first, second).agg(F.count("*").alias("weight"))
    rank_of = lambda c, name: ranked_values(rows, [], c, {}).select(c, F.col("rank").alias(name))
    ranked = pairs.join(rank_of(first, "rx"), first).join(rank_of(second, "ry"), second)
    w, x, y = F.col("weight"), F.col("rx"), F.col("ry")
    centre = (rows.agg(F.count("*")).scalar() + 1) / 2
    centred = ranked.withColumn("dx", x - centre).withColumn("dy", y - centre)
    sums = centred.agg(
        F.sum("weight").alias("n"),
        F.sum(w * F.col("dx") * F.col("dy")).alias("sxy"),
        F.sum(w * F.col("dx") * F.col("dx")).alias("sxx"),
        F.sum(w * F.col("dy") * F.col("dy")).alias("syy"),
    )
    spread = F.sqrt(F.col("sxx") * F.col("syy"))
    return sums.select("n", F.when(spread > 0, F.col("sxy") / spread).alias("rho"))


def ablation(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Cohort gap of the score with each dimension left out and the other weights scaled up."""
    used = weights or DEFAULT_WEIGHTS
    debt = {
        "complexity": F.col("complexity_score"),
        "duplication": F.col("duplication_score"),
        "documentation": F.col("documentation_score"),
        "error_handling": 1 - F.col("error_handling_score"),
    }
    ai = F.col("cohort") == "ai"

    def total(without: str | None) -> Column:
        kept = [name for name in used if name != without]
        scale = sum(used[name] for name in kept)
        parts = [debt[name] * (used[name] / scale) for name in kept]
        return sum(parts[1:], parts[0])

    cases = {"none": None, **{name: name for name in used}}
    aggregates = []
    for label, without in cases.items():
        score = total(without)
        aggregates += [F.avg(F.when(ai, score)).alias(f"a_{label}"), F.avg(F.when(~ai, score)).alias(f"h_{label}")]
    wide = df.where("cohort is not null").agg(*aggregates)
    rows = F.array(
        *[
            F.struct(
                F.lit(label).alias("removed"),
                F.col(f"a_{label}").alias("mean_ai"),
                F.col(f"h_{label}").alias("mean_human"),
                (F.col(f"a_{label}") - F.col(f"h_{label}")).alias("gap"),
                ((F.col(f"a_{label}") - F.col(f"h_{label}")) - (F.col("a_none") - F.col("h_none"))).alias("gap_change"),
            )
            for label in cases
        ]
    )
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def feature_importance(df: DataFrame, trees: int = 100, folds: int = 5, seed: int = 42, least_rows: int = 10) -> DataFrame:
    """Random-forest importance of six features and cross-validated accuracy.

    ``df`` needs stars, forks, size_kb, ai_confidence and cohort. Under
    ``least_rows`` rows a single row with an error text is returned.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    spark = df.sparkSession
    shape = "feature string, importance double, rank int, cv_accuracy_mean double, cv_accuracy_std double, error string"
    ai = F.col("cohort") == "ai"
    flag = lambda level: F.when(ai & (F.col("ai_confidence") == level), 1.0).otherwise(0.0)
    table = df.where("cohort is not null").select(
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES[:3]],
        flag("High").alias(FEATURES[3]),
        flag("Medium").alias(FEATURES[4]),
        flag("Low").alias(FEATURES[5]),
        ai.cast("double").alias("label"),
    )
    if len(table.take(least_rows)) < least_rows:
        return spark.createDataFrame([(None, None, None, None, None, "Insufficient data for feature importance analysis")], shape)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table).select("features", "label")
    forest = RandomForestClassifier(numTrees=trees, seed=seed, cacheNodeIds=False)
    model = forest.fit(vectors)
    check = CrossValidator(
        estimator=forest,
        estimatorParamMaps=ParamGridBuilder().build(),
        evaluator=MulticlassClassificationEvaluator(metricName="accuracy"),
        numFolds=folds,
        seed=seed,
    ).fit(vectors)
    ranked = sorted(zip(FEATURES, model.featureImportances.toArray(), strict=True), key=lambda x: (-x[1], x[0]))
    rows = [
        (name, float(weight), i, float(check.avgMetrics[0]), float(check.stdMetrics[0]), None)
        for i, (name, weight) in enumerate(ranked, start=1)
    ]
    return spark.createDataFrame(rows, shape)


def as_long(results: DataFrame, test: str, keys: Sequence[str] = ()) -> DataFrame:
    """Result rows as (test, group, metric, value) with numbers only."""
    numeric = [f.name for f in results.schema if f.dataType.typeName() in ("long", "integer", "double") and f.name not in keys]
    group = F.concat_ws("/", *keys) if keys else F.lit("all")
    wide = results.select(group.alias("group"), *[F.col(c).cast("double").alias(c) for c in numeric])
    return wide.unpivot(["group"], numeric, "metric", "value").select(F.lit(test).alias("test"), "group", "metric", "value")
