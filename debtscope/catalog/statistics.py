"""Queries for tests, effect sizes, agreement and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from debtscope.catalog.registry import query
from debtscope.catalog.sql import COHORT1, SCORED, p_two_sided, rnd, upper_tail
from debtscope.functions.labels import effect_words, study_cohort
from debtscope.functions.scores import approximate_power
from debtscope.operators.agreement import kappa, overall_agreement, paired_ratings
from debtscope.operators.stats import (
    ablation,
    bonferroni,
    cohens_d,
    dimension_tests,
    feature_importance,
    group_moments,
    long_dimensions,
    mann_whitney,
    paired_score_test,
    plain_effect,
    score_test,
    spearman,
    wilcoxon,
)
from debtscope.plans.bindings import scored_documents
from debtscope.plans.study import study_report
from debtscope.session import table

DIMS = ("complexity_score", "duplication_score", "documentation_score", "error_handling_score")


def cohort_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scored documents with the study cohort."""
    scored = scored_documents(spark, folder)
    return scored.withColumns(
        {
            "cohort": study_cohort(F.col("ai_confidence")),
            "stars": F.col("file_size") % 1000,
            "forks": F.col("total_lines"),
            "size_kb": F.col("file_size"),
        }
    )


_LONG = f"""{SCORED},
labelled AS (SELECT *, {COHORT1} AS cohort FROM scored),
long AS (UNPIVOT (SELECT cohort, {", ".join(DIMS)} FROM labelled) ON {", ".join(DIMS)} INTO NAME dimension VALUE value),
ranked AS (
  SELECT *, rank() OVER (PARTITION BY dimension ORDER BY value) + (count(*) OVER (PARTITION BY dimension, value) - 1) / 2 AS rk,
    count(*) OVER (PARTITION BY dimension, value) AS t FROM long
),
u AS (
  SELECT dimension, count(*) FILTER (cohort = 'ai')::DOUBLE AS n1, count(*) FILTER (cohort = 'human')::DOUBLE AS n2,
    sum(rk) FILTER (cohort = 'ai') AS rs, sum(t * t - 1)::DOUBLE AS ties,
    avg(value) FILTER (cohort = 'ai') AS m1, avg(value) FILTER (cohort = 'human') AS m2,
    var_samp(value) FILTER (cohort = 'ai') AS v1, var_samp(value) FILTER (cohort = 'human') AS v2
  FROM ranked GROUP BY dimension
),
z AS (
  SELECT *, rs - n1 * (n1 + 1) / 2 AS statistic,
    n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1))) AS variance,
    sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS sd
  FROM u
),
tested AS (
  SELECT *, CASE WHEN variance > 0 THEN greatest(abs(statistic - n1 * n2 / 2) - 0.5, 0.0) / sqrt(variance) END AS z,
    CASE WHEN sd < 1e-12 THEN 0.0 ELSE (m1 - m2) / sd END AS d FROM z
)
"""
_WORDS = """CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END"""


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"""
WITH {_LONG} SELECT dimension, n1::BIGINT AS n_ai, n2::BIGINT AS n_human, round(statistic, 6) AS statistic,
  round(z, 6) AS z, round({p_two_sided("z")}, 6) AS p_value FROM tested
""")
def rank_tests(spark: SparkSession, folder: str) -> DataFrame:
    """Mann-Whitney test of each dimension."""
    values = long_dimensions(cohort_scores(spark, folder))
    return _rounded(mann_whitney(values, ["dimension"], "value"), "statistic", "z", "p_value")


@query(f"""
WITH {_LONG} SELECT dimension, round(m1, 6) AS mean_ai, round(m2, 6) AS mean_human, round(d, 6) AS effect_size,
  CASE WHEN z IS NOT NULL THEN round(least(1.0, {p_two_sided("z")} * 4), 6) END AS p_value_bonferroni, {p_two_sided("z")} * 4 < 0.05 AS significant_bonferroni,
  {_WORDS} AS effect_size_interpretation FROM tested
""")
def dimension_effects(spark: SparkSession, folder: str) -> DataFrame:
    """Corrected p, effect size and wording of each dimension."""
    tests = dimension_tests(cohort_scores(spark, folder)).select(
        "dimension", "mean_ai", "mean_human", "effect_size", "p_value_bonferroni", "significant_bonferroni", "effect_size_interpretation"
    )
    return _rounded(tests, "mean_ai", "mean_human", "effect_size", "p_value_bonferroni")


_GROUPS = f"""{SCORED},
g AS (
  SELECT source AS repo, count(*) FILTER ({COHORT1} = 'ai')::DOUBLE AS n1, count(*) FILTER ({COHORT1} = 'human')::DOUBLE AS n2,
    avg(debt_score) FILTER ({COHORT1} = 'ai') AS m1, avg(debt_score) FILTER ({COHORT1} = 'human') AS m2,
    var_samp(debt_score) FILTER ({COHORT1} = 'ai') AS v1, var_samp(debt_score) FILTER ({COHORT1} = 'human') AS v2
  FROM scored GROUP BY source
),
e AS (
  SELECT *, sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS sd, (v1 + v2) / 2 AS pv FROM g
),
d AS (
  SELECT *, CASE WHEN sd IS NULL OR isnan(sd) THEN NULL WHEN sd < 1e-12 THEN 0.0 ELSE (m1 - m2) / sd END AS d,
    CASE WHEN n1 > 1 AND n2 > 1 AND pv > 1e-15 THEN (m1 - m2) / sqrt(pv) ELSE 0.0 END AS plain, least(n1, n2) AS n FROM e
)
"""
_Z = "(d * sqrt(n / 2) - 1.96)"
_POWER = f"CASE WHEN {_Z} >= 0 THEN 1 - {upper_tail(_Z)} ELSE {upper_tail(_Z)} END"


@query(f"""
WITH {_GROUPS} SELECT repo, n1::BIGINT AS n_ai, n2::BIGINT AS n_human, round(d, 6) AS cohens_d, round(plain, 6) AS plain_effect,
  coalesce({_WORDS.replace("ELSE", "WHEN d IS NOT NULL THEN")}, 'undefined') AS words,
  round(CASE WHEN n < 10 THEN 0.0 ELSE {_POWER} END, 6) AS power,
  CASE WHEN n < 10 THEN false ELSE {_POWER} >= 0.8 END AS adequate FROM d
""")
def effect_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Both effect sizes, wording and power of the score within each source."""
    moments = group_moments(cohort_scores(spark, folder), ["repo"], "debt_score")
    sized = moments.withColumn("cohens_d", cohens_d()).withColumn("plain_effect", plain_effect())
    power = approximate_power(F.col("cohens_d"), F.col("n_ai"), F.col("n_human"))
    out = sized.withColumn("p", power).select(
        "repo", "n_ai", "n_human", "cohens_d", "plain_effect", effect_words(F.col("cohens_d")).alias("words"), "p.power", "p.adequate"
    )
    return _rounded(out, "cohens_d", "plain_effect", "power")


@query(f"""
WITH d AS (SELECT round(l_discount - l_tax, 10) AS gap FROM lineitem),
r AS (SELECT gap, rank() OVER (ORDER BY abs(gap)) + (count(*) OVER (PARTITION BY abs(gap)) - 1) / 2 AS rk,
  count(*) OVER (PARTITION BY abs(gap)) AS t FROM d WHERE gap <> 0),
s AS (SELECT count(*)::DOUBLE AS n, sum(rk) FILTER (gap > 0) AS wp, sum(rk) FILTER (gap < 0) AS wm,
  sum(t::DOUBLE * t - 1) AS ties FROM r),
z AS (SELECT *, (least(wp, wm) - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) AS z FROM s)
SELECT n::BIGINT AS n_used, wp AS w_plus, wm AS w_minus, least(wp, wm) AS statistic, round(z, 6) AS z,
  round({p_two_sided("z")}, 6) AS p_value FROM z
""")
def signed_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Signed-rank test of discount against tax."""
    return _rounded(wilcoxon(table(spark, folder, "lineitem"), "l_discount", "l_tax"), "z", "p_value")


@query("""
SELECT count(*) AS n_pairs, round(avg(l_discount), 6) AS mean_ai, round(avg(l_tax), 6) AS mean_human,
  round(stddev_pop(l_discount), 6) AS std_ai, round(stddev_pop(l_tax), 6) AS std_human FROM lineitem
""")
def paired_figures(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes, means and spreads that go with the paired test."""
    test = paired_score_test(table(spark, folder, "lineitem"), "l_discount", "l_tax")
    return _rounded(test.select("n_pairs", "mean_ai", "mean_human", "std_ai", "std_human"), "mean_ai", "mean_human", "std_ai", "std_human")


@query(f"""
WITH {SCORED},
s AS (SELECT *, {COHORT1} AS cohort, rank() OVER (ORDER BY debt_score) + (count(*) OVER (PARTITION BY debt_score) - 1) / 2 AS rk,
  count(*) OVER (PARTITION BY debt_score) AS t FROM scored),
u AS (SELECT count(*) FILTER (cohort = 'ai')::DOUBLE AS n1, count(*) FILTER (cohort = 'human')::DOUBLE AS n2,
  sum(rk) FILTER (cohort = 'ai') AS rs, sum(t::DOUBLE * t - 1) AS ties,
  median(debt_score) FILTER (cohort = 'ai') AS q1, median(debt_score) FILTER (cohort = 'human') AS q2,
  stddev_pop(debt_score) FILTER (cohort = 'ai') AS s1, stddev_pop(debt_score) FILTER (cohort = 'human') AS s2 FROM s),
z AS (SELECT *, rs - n1 * (n1 + 1) / 2 AS statistic, greatest(abs(rs - n1 * (n1 + 1) / 2 - n1 * n2 / 2) - 0.5, 0.0)
  / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM u)
SELECT n1::BIGINT AS n_ai, n2::BIGINT AS n_human, round(q1, 6) AS median_ai, round(q2, 6) AS median_human,
  round(s1, 6) AS std_ai, round(s2, 6) AS std_human, statistic, round(z, 6) AS z, round({p_two_sided("z")}, 6) AS p_value,
  round(least(1.0, {p_two_sided("z")} * 3), 6) AS p_value_bonferroni FROM z
""")
def score_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Unpaired comparison of the composite score."""
    test = score_test(cohort_scores(spark, folder)).select(
        "n_ai", "n_human", "median_ai", "median_human", "std_ai", "std_human", "statistic", "z", "p_value", "p_value_bonferroni"
    )
    return _rounded(test, "median_ai", "median_human", "std_ai", "std_human", "z", "p_value", "p_value_bonferroni")


@query(f"""
WITH {SCORED},
r AS (SELECT rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS rx,
  rank() OVER (ORDER BY debt_score) + (count(*) OVER (PARTITION BY debt_score) - 1) / 2 AS ry FROM scored)
SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r
""")
def score_size_correlation(spark: SparkSession, folder: str) -> DataFrame:
    """Rank correlation of size and score."""
    return _rounded(spearman(scored_documents(spark, folder), "file_size", "debt_score"), "rho")


_PARTS = {
    "complexity": (0.30, "complexity_score"),
    "duplication": (0.25, "duplication_score"),
    "documentation": (0.20, "documentation_score"),
    "error_handling": (0.25, "(1 - error_handling_score)"),
}


def _ablation_sql() -> str:
    cases = []
    for removed in ("none", *_PARTS):
        kept = {k: v for k, v in _PARTS.items() if k != removed}
        scale = sum(w for w, _ in kept.values())
        cases.append((removed, " + ".join(f"{w} / {scale} * {c}" for w, c in kept.values())))
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS removed, avg({e}) FILTER ({COHORT1} = 'ai') AS a, avg({e}) FILTER ({COHORT1} = 'human') AS h FROM scored"
        for name, e in cases
    )
    return f"""
WITH {SCORED}, r AS ({rows})
SELECT removed, round(a, 6) AS mean_ai, round(h, 6) AS mean_human, round(a - h, 6) AS gap,
  round((a - h) - (SELECT a - h FROM r WHERE removed = 'none'), 6) AS gap_change FROM r
"""


@query(_ablation_sql())
def ablation_study(spark: SparkSession, folder: str) -> DataFrame:
    """Cohort gap with each dimension left out."""
    return _rounded(ablation(cohort_scores(spark, folder)), "mean_ai", "mean_human", "gap", "gap_change")


@query()
def forest_importance(spark: SparkSession, folder: str) -> DataFrame:
    """Random-forest importance of six features."""
    return feature_importance(cohort_scores(spark, folder))


def source_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Labels as two raters, one metric per source."""
    docs = table(spark, folder, "documents").select("doc_id", F.col("source").alias("metric"))
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("r1"), F.col("toxic").alias("r2"))
    return labels.join(docs, "doc_id").select("metric", "r1", "r2")


_KAPPA = """
k AS (
  SELECT source AS metric, count(*)::DOUBLE AS n, avg((quality = toxic)::INTEGER) AS po,
    avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)) AS pe, avg(quality) AS a, avg(toxic) AS b
  FROM labels JOIN documents USING (doc_id) GROUP BY source
),
kk AS (SELECT *, CASE WHEN pe < 1 THEN round((po - pe) / (1 - pe), 10) END AS kappa FROM k)
"""
_KAPPA_ROUND = rnd("kappa", 4)


@query(f"""
WITH {_KAPPA}
SELECT metric, {_KAPPA_ROUND} AS kappa, CASE WHEN kappa IS NULL THEN 'undefined' WHEN kappa < 0 THEN 'poor (less than chance)'
  WHEN kappa < 0.2 THEN 'slight agreement' WHEN kappa < 0.4 THEN 'fair agreement' WHEN kappa < 0.6 THEN 'moderate agreement'
  WHEN kappa < 0.8 THEN 'substantial agreement' ELSE 'almost perfect agreement' END AS interpretation,
  n::BIGINT AS n_samples, {rnd("a", 2)} AS rater1_mean, {rnd("b", 2)} AS rater2_mean FROM kk
""")
def rater_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Kappa of both label columns within each source."""
    return kappa(source_ratings(spark, folder))


@query(f"""
WITH {_KAPPA}, r AS (SELECT {_KAPPA_ROUND} AS kappa FROM kk)
SELECT {rnd("avg(kappa)", 4)} AS average_kappa, avg(kappa) >= 0.6 AS adequate, 0.6::DOUBLE AS target, count(kappa) AS metrics_evaluated FROM r
""")
def agreement_overall(spark: SparkSession, folder: str) -> DataFrame:
    """Mean kappa over the sources."""
    return overall_agreement(kappa(source_ratings(spark, folder)))


@query("""
SELECT m.metric, count(*) AS pairs, sum(r1)::BIGINT AS sum1, sum(r2)::BIGINT AS sum2 FROM (
  SELECT 'ai_identification_score' AS metric, quality AS r1, toxic AS r2 FROM labels WHERE doc_id % 2 = 0
  UNION ALL SELECT 'overall_debt_severity', toxic, quality FROM labels WHERE doc_id % 2 = 0
  UNION ALL SELECT 'debt_severity_scores.complexity', doc_id % 4, doc_id % 3 FROM labels) m GROUP BY 1
""")
def rater_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Ratings of two annotation tables matched by repository, missing ones dropped."""
    labels = table(spark, folder, "labels")

    def rater(first: F.Column, second: F.Column, third: F.Column) -> DataFrame:
        none = F.lit(None).cast("int")
        debt = F.struct(third.cast("int").alias("complexity"), none.alias("duplication"), none.alias("documentation"), none.alias("error_handling"))
        record = F.struct(first.alias("ai_identification_score"), second.alias("overall_debt_severity"), debt.alias("debt_severity_scores"))
        return labels.select(F.col("doc_id").alias("repo_id"), record.alias("verification"))

    even = F.col("doc_id") % 2 == 0
    a = rater(F.when(even, F.col("quality")), F.when(even, F.col("toxic")), F.col("doc_id") % 4)
    b = rater(F.col("toxic"), F.col("quality"), F.col("doc_id") % 3)
    return paired_ratings(a, b).groupBy("metric").agg(
        F.count("*").alias("pairs"), F.sum("r1").alias("sum1"), F.sum("r2").alias("sum2")
    )


@query(f"""
WITH {_LONG} SELECT 'rq2' AS test, dimension AS "group", 'mean_ai' AS metric, round(m1, 6) AS value FROM tested
UNION ALL SELECT 'rq2', dimension, 'n_ai', n1 FROM tested
UNION ALL SELECT 'rq2', dimension, 'effect_size', round(d, 6) FROM tested
UNION ALL SELECT 'rq1', 'debt_score', 'n_human', count(*) FROM labelled WHERE cohort = 'human'
UNION ALL SELECT 'descriptive', cohort, 'total_repos', count(*) FROM labelled GROUP BY cohort
""")
def study_report_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Part of the long-form study report."""
    report = study_report(cohort_scores(spark, folder))
    wanted = (
        F.when(F.col("test") == "rq2", F.col("metric").isin("mean_ai", "n_ai", "effect_size"))
        .when(F.col("test") == "rq1", F.col("metric") == "n_human")
        .otherwise(F.col("metric") == "total_repos")
    )
    return _rounded(report.where(wanted), "value")


@query(f"""
WITH {SCORED}, l AS (SELECT debt_score FROM scored) SELECT round(least(1.0, debt_score * 3), 6) AS corrected, count(*) AS n FROM l GROUP BY 1
""")
def corrected_values(spark: SparkSession, folder: str) -> DataFrame:
    """Multiple-test correction applied to a column of values in 0..1."""
    corrected = F.round(bonferroni(F.col("debt_score"), 3), 6)
    return scored_documents(spark, folder).groupBy(corrected.alias("corrected")).agg(F.count("*").alias("n"))
