"""Files, dataset preparation, sampling, provenance and pages."""

import datetime
import glob
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from debtscope.functions.paths import repository_address
from debtscope.operators.dataset import backfill, filter_counts, filter_dataset, keep_first
from debtscope.operators.paging import page
from debtscope.operators.provenance import commit_rollup, control_repositories, flatten_search_hits, run_summary
from debtscope.operators.sampling import balanced_sample, collection_quota, draw, not_sampled, verification_sample
from debtscope.plans.study import prepare_dataset, study_report
from debtscope.sources.code import blob_texts, source_tree
from debtscope.sources.datasets import (
    append_query_results,
    read_annotations,
    read_many,
    read_repositories,
    score_summary,
    write_history,
    write_repositories,
    write_scores,
)


def test_csv_round_trip(spark, tmp_path):
    source = tmp_path / "in.csv"
    source.write_text(
        "name,url,stars,is_private,ai_confidence,ai_signals,total_score,created_at,odd\n"
        'a,u1,3,False,None,"[""x y""]",0.5,2024-03-24T17:36:28Z,"two\nlines, ""quoted"""\n'
        "b,u2,bad,True,High,not json,,not a date,\n",
        encoding="utf-8",
    )
    df = read_repositories(spark, str(source))
    a, b = df.orderBy("name").collect()
    assert (a.ai_confidence, a.ai_signals, a.debt_score, a.is_private) == ("None", ["x y"], 0.5, False)
    assert a.odd == 'two\nlines, "quoted"'
    assert (b.stars, b.ai_signals, b.debt_score, b.created_at, b.is_private) == (None, [], None, None, True)
    out = str(tmp_path / "out")
    write_repositories(df, out)
    again = read_repositories(spark, out)
    assert again.columns == sorted(df.columns)
    assert sorted(again.select(*df.columns).collect(), key=str) == sorted(df.collect(), key=str)
    assert read_many(spark, [str(source), out]).count() == 4


def test_history_and_score_exports(spark, tmp_path):
    df = spark.createDataFrame([("n", 0.25, "x"), ("m", 0.5, "y")], "name string, debt_score double, other string")
    write_history(df, str(tmp_path / "h"))
    header = open(glob.glob(f"{tmp_path}/h/part-*.csv")[0]).readline().strip()
    assert header == "name,debt_score"
    write_scores(df, str(tmp_path / "s"))
    summary = json.loads(open(glob.glob(f"{tmp_path}/s/summary/part-*.json")[0]).readline())
    assert (summary["total_files"], summary["average_score"]) == (2, 0.375)
    assert score_summary(df.where("false")).first().average_score == 0.0


def _md5(text):
    return hashlib.md5(text.encode()).hexdigest()[:8]


def test_query_results_are_appended_by_slug(spark, tmp_path):
    df = spark.createDataFrame([("a b:c", 1), ("other", 2)], "q string, n int")
    append_query_results(df, "q", str(tmp_path / "m"))
    append_query_results(df.where("n = 2"), "q", str(tmp_path / "m"))
    got = spark.read.parquet(str(tmp_path / "m"))
    assert {(r.query_slug, r["count"]) for r in got.groupBy("query_slug").count().collect()} == {("a_b_c-" + _md5("a b:c"), 1), ("other-" + _md5("other"), 2)}


def test_annotations_scan(spark, tmp_path):
    review = {"ai_identification_score": 2, "debt_severity_scores": {"complexity": 1}, "overall_debt_severity": None}
    (tmp_path / "r.json").write_text(json.dumps({"metadata": {}, "repositories": [{"repo_id": 4, "name": "n", "verification": review}]}, indent=2))
    row = read_annotations(spark, str(tmp_path / "r.json")).first()
    assert (row.repo_id, row.verification.debt_severity_scores.complexity, row.verification.overall_debt_severity) == (4, 1, None)


def test_source_tree(spark, tmp_path):
    for name, data in {
        "src/a.py": b"x = 1\n", "src/b.PY": b"y", "node_modules/c.js": b"z", "src/blank.ts": b" \n", "src/bad.go": b"\xffok", "n.txt": b"n",
    }.items():
        target = tmp_path / "build" / "tree" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    rows = {r.path.rsplit("/", 1)[1]: r for r in source_tree(spark, str(tmp_path / "build" / "tree")).collect()}
    assert set(rows) == {"a.py", "b.PY", "bad.go"}
    assert {r.repo for r in rows.values()} == {"src"} and rows["b.PY"].language == "python"
    assert rows["bad.go"].content == "�ok" and rows["a.py"].language == "python"


def test_blobs_drop_bad_bytes(spark):
    import base64

    rows = [(1, base64.b64encode(b"a\xffb").decode()), (2, base64.b64encode(b" \n").decode())]
    got = blob_texts(spark.createDataFrame(rows, "i int, content string")).collect()
    assert [(r.i, r.content) for r in got] == [(1, "ab")]


def test_keep_first_uses_the_given_order(spark):
    df = spark.createDataFrame([("u", 2, "b"), ("u", 1, "a"), ("v", 5, "c")], "url string, o int, x string")
    assert sorted(r.x for r in keep_first(df, ["url"], ["o"]).collect()) == ["a", "c"]


def test_filter_skips_absent_columns_and_counts_steps(spark):
    as_of = F.lit("2026-01-01").cast("timestamp")
    rows = [
        ("5000", "Python", "2020-01-01", "False", "3"), ("4999", "Python", "2020-01-01", "False", "3"), ("x", "Go", "2020-01-01", "False", "3"),
        ("6000", "Go", "2020-01-01", "False", "3"), ("6000", "Python", "2025-06-01", "False", "3"), ("6000", "Python", "bad", "False", "3"),
        ("6000", "Python", "2020-01-01", "True", "3"), ("6000", "Python", "2020-01-01", "False", None),
    ]
    df = spark.createDataFrame(rows, "size_kb string, language string, created_at string, is_private string, stars string")
    assert filter_dataset(df, as_of).count() == 1
    assert tuple(filter_counts(df, as_of).first()) == (8, 6, 5, 3, 2, 1)
    assert filter_dataset(df.select("size_kb"), as_of).count() == 6


def test_backfill(spark):
    df = spark.createDataFrame([("Human", "0.5"), ("AI", None)], "type string, debt_score string")
    rows = backfill(df).orderBy("type").collect()
    assert [(r.ai_confidence, r.debt_score, r.source) for r in rows] == [("High", 0.0, "static"), ("None", 0.5, "static")]


@pytest.fixture(scope="module")
def repositories(spark):
    levels = ["High", "Medium", "Low", "None"]
    rows = [(i, f"u{i}", levels[i % 4] if i % 10 else "Low", ["Python", "Go", "TypeScript"][i % 3], 100 * i) for i in range(400)]
    return spark.createDataFrame(rows, "repo_id int, url string, ai_confidence string, language string, size_kb int")


def test_balanced_sample_quotas(repositories):
    sample = balanced_sample(repositories).collect()
    assert sum(r.cohort == "ai" for r in sample) == 20 and sum(r.cohort == "human" for r in sample) == 20
    assert all(r.ai_confidence == "High" for r in sample if r.cohort == "ai")
    spread = [sum(r.language == x for r in sample if r.cohort == "human") for x in ("Python", "Go", "TypeScript")]
    assert min(spread) >= 6
    assert sample == balanced_sample(repositories.repartition(7)).collect()


def test_short_cohorts_are_taken_whole(repositories):
    few = repositories.where("ai_confidence in ('Low', 'None') or repo_id < 9")
    assert balanced_sample(few).where("cohort = 'ai'").count() == few.where("ai_confidence in ('High', 'Medium')").count()


def test_verification_sample_covers_levels(repositories):
    sample = verification_sample(repositories, n=40).collect()
    assert len({r.ai_confidence for r in sample}) == 4 and len(sample) <= 40
    assert len({r.repo_id for r in sample}) == len(sample)


def test_samples_leave_the_rest(repositories):
    sample = repositories.orderBy(draw("repo_id")).limit(30)
    assert not_sampled(repositories, sample, "repo_id").count() == 370


def test_quota_is_filled_in_query_order(repositories):
    got = collection_quota(repositories, "language", ["repo_id"], 50, 120).groupBy("language").count().collect()
    assert {r.language: r["count"] for r in got} == {"Go": 50, "Python": 50, "TypeScript": 20}


def test_pages_join_to_the_whole(repositories):
    seen = [r.repo_id for n in range(1, 9) for r in page(repositories, "language", ["repo_id"], n, 50).collect()]
    assert len(seen) == 400 and len(set(seen)) == 400


def commits(spark):
    def at(day):
        return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day)

    rows = [("a", f"s{i}", "[ai] generated by llm" if i in (3, 5) else "fix", at(i)) for i in range(120)]
    rows += [("b", f"t{i}", "generated by ai" if i == 0 else "fix", at(i)) for i in range(60)] + [("c", "v", "fix", at(0))]
    return spark.createDataFrame(rows, "repo string, sha string, message string, committed_at timestamp")


def test_commit_rollup_reads_latest_hundred(spark):
    rows = {r.repo: r for r in commit_rollup(commits(spark), [F.col("committed_at").desc()], limit=100, kept=10).collect()}
    assert (rows["a"].total_commits_analyzed, rows["a"].ai_commits_found, rows["a"].ai_confidence) == (100, 0, "None")
    assert (rows["b"].ai_commits_found, rows["b"].ai_commit_ratio, rows["b"].ai_confidence_level) == (1, 0.0167, "Low")
    assert rows["b"].ai_commits[0].sha == "t0" and rows["b"].ai_confidence == "Low"


def test_control_group_reads_latest_fifty(spark):
    repos = spark.createDataFrame([("a",), ("b",), ("c",), ("unknown",)], "repo string")
    got = control_repositories(repos, commits(spark), [F.col("committed_at").desc()], limit=50)
    assert sorted(r.repo for r in got.collect()) == ["a", "b", "c"]


def test_search_hits_are_flattened_with_defaults(spark, tmp_path):
    shape = (
        "sha string, commit struct<message:string,committer:struct<date:string>>, repository struct<full_name:string,html_url:string,"
        "description:string,language:string,stargazers_count:long,forks_count:long,created_at:string,updated_at:string,size:long,"
        "private:boolean,default_branch:string>"
    )
    (tmp_path / "h.json").write_text(json.dumps({"sha": "1", "commit": {"message": "[AI] x"}, "repository": {"full_name": "o/r"}}))
    row = flatten_search_hits(spark.read.schema(shape).json(str(tmp_path / "h.json"))).first()
    assert (row.name, row.stars, row.default_branch, row.is_private, row.ai_confidence) == ("o/r", 0, "main", False, "Medium")


def test_run_rate(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [("q1", "completed", 30, t, t + datetime.timedelta(minutes=20)), ("q2", "failed", 0, t, t + datetime.timedelta(minutes=30))]
    df = spark.createDataFrame(rows, "query string, status string, rows int, started_at timestamp, completed_at timestamp")
    row = run_summary(df).first()
    assert (row.repositories, row.queries_failed, row.rows_per_hour) == (30, 1, 60.0)


def test_study_from_datasets_to_report(spark):
    rows = [
        (f"u{i % 90}", i, 6000 + i, "Python", "2020-01-01", 5, 1, ["High", "None"][i % 2], *[((i * k) % 11) / 11 for k in (1, 2, 3, 4, 5)])
        for i in range(120)
    ]
    scores = "debt_score double, complexity_score double, duplication_score double, documentation_score double, error_handling_score double"
    df = spark.createDataFrame(
        rows, f"url string, row_ord int, size_kb int, language string, created_at string, stars int, forks int, ai_confidence string, {scores}"
    )
    ready = prepare_dataset([df.where("row_ord < 60"), df.where("row_ord >= 60")], F.lit("2026-01-01").cast("timestamp"))
    assert ready.groupBy("cohort").count().collect()[0]["count"] == 20
    report = {(r.test, r.group, r.metric): r.value for r in study_report(ready).collect()}
    assert report[("rq1", "debt_score", "n_ai")] == 20.0
    assert ("rq2", "complexity_score", "p_value") in report and report[("descriptive", "human", "total_repos")] == 20.0


def test_review_document_holds_blank_entries(repositories):
    from debtscope.operators.annotations import review_document

    sample = repositories.limit(3).withColumns({"name": F.lit("n"), "ai_commit_ratio": F.lit(None).cast("double")})
    row = review_document(sample, "2024-01-01T00:00:00").first()
    assert row.metadata.total_repositories == 3 and row.rubric["3"] == "Severe"
    entry = row.repositories[0]
    assert entry.ai_commit_ratio == 0.0 and entry.verification.ai_identification_evidence == []
    assert entry.verification.overall_debt_severity is None


def test_numbers_that_do_not_fit_are_null_and_the_score_is_named(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text("name,stars,first_score,second_score\na,nan,0.5,0.25\nb,1e30,x,0.5\nc,12.0,1,1\nd,9007199254740993,1,1\n")
    plain = {r.name: r for r in read_repositories(spark, str(path)).collect()}
    assert [plain[n].stars for n in "abcd"] == [None, None, 12, 9007199254740993] and plain["a"].first_score == "0.5"
    named = {r.name: r for r in read_repositories(spark, str(path), score="first_score").collect()}
    assert (named["a"].debt_score, named["b"].debt_score, named["a"].second_score) == (0.5, None, "0.25")


def test_git_suffix_of_addresses(spark):
    urls = ["https://github.com/u/user.github.io", "https://github.com/u/r.git", "https://github.com/u/a.gitb.git/", "https://github.com/u/r.git/tree/main/p"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select(repository_address(F.col("url")).alias("a")).select("a.*").collect()
    assert [r.repo for r in rows] == ["user.github.io", "r", "a.gitb", "r"]


def test_all_commits_count_unless_a_limit_is_named(spark):
    rows = [("r", f"s{i}", "generated by chatgpt" if i == 0 else "x", datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i)) for i in range(120)]
    df = spark.createDataFrame(rows, "repo string, sha string, message string, committed_at timestamp")
    newest = [F.col("committed_at").desc()]
    assert commit_rollup(df, newest).first().total_commits_analyzed == 120
    assert commit_rollup(df, newest, limit=100).first().ai_commits_found == 0
    repos = spark.createDataFrame([("r",)], "repo string")
    assert control_repositories(repos, df, newest).count() == 0 and control_repositories(repos, df, newest, limit=50).count() == 1
