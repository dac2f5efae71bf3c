"""Streams driven to the end by availableNow."""

import datetime

from pyspark.sql import functions as F

from debtscope.streaming.live_stats import ANALYSES, analyses, live_figures, start_append, start_moments
from debtscope.streaming.rescoring import SAVES, compact_scores, current_scores, saved_files, start_rescoring

DAY = datetime.datetime(2024, 1, 1)


def land(spark, rows, shape, folder):
    spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(folder)


def test_saved_files_are_scored_again(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    land(spark, [("a.py", "python", "x\n" * 100, DAY), ("b.py", "python", "y\n", DAY)], SAVES, source)
    start_rescoring(saved_files(spark, source), target, state).awaitTermination(90)
    later = DAY + datetime.timedelta(hours=1)
    land(spark, [("a.py", "python", "x\n" * 400, later), ("b.py", "python", "y\n", later)], SAVES, source)
    start_rescoring(saved_files(spark, source), target, state).awaitTermination(90)
    rows = {r.path: r for r in current_scores(spark, target).collect()}
    assert rows["a.py"].total_lines == 400 and rows["b.py"].total_lines == 1
    assert rows["b.py"].saved_at == later


def test_a_save_that_restores_earlier_content_counts(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for i, content in enumerate(["a\n", "a\nb\nc\nd\n", "a\n"]):
        land(spark, [("a.py", "python", content, DAY + datetime.timedelta(minutes=i))], SAVES, source)
        start_rescoring(saved_files(spark, source), target, state).awaitTermination(90)
        if i == 1:
            compact_scores(spark, target)
            assert current_scores(spark, target).first().total_lines == 4
    assert [r.total_lines for r in current_scores(spark, target).collect()] == [1]
    compact_scores(spark, target)
    # A late repeat of the second save changes nothing.
    land(spark, [("a.py", "python", "a\nb\nc\nd\n", DAY + datetime.timedelta(minutes=1))], SAVES, source)
    start_rescoring(saved_files(spark, source), target, state).awaitTermination(90)
    assert [r.total_lines for r in current_scores(spark, target).collect()] == [1]


def test_figures_follow_appended_analyses(spark, tmp_path):
    source, data, moments = (str(tmp_path / n) for n in ("in", "data", "moments"))
    states = [str(tmp_path / n) for n in ("s1", "s2")]
    land(spark, [("u1", "High", "go", 0.5, DAY), ("u2", "None", "go", 0.25, DAY)], ANALYSES, source)

    def run():
        start_append(analyses(spark, source), data, states[0]).awaitTermination(90)
        start_moments(analyses(spark, source), moments, states[1]).awaitTermination(90)

    run()
    land(spark, [("u3", None, "go", 0.7, DAY), ("u4", "None", "go", 0.35, DAY)], ANALYSES, source)
    run()
    stored = spark.read.parquet(data)
    assert stored.count() == 4 and stored.where(F.col("source") == "quick_analysis").count() == 4
    row = live_figures(spark, moments).first()
    assert (row.ai_repos, row.human_repos) == (2, 2)
    assert abs(row.avg_ai_score - 0.6) < 1e-12 and row.effect_size > 0
