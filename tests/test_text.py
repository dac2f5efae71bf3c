"""Lines, blanks, labels and paths against plain Python."""

import hashlib
import random
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from debtscope.functions import labels, markers, paths, text
from debtscope.functions.rows import clamp, round_to
from debtscope.functions.scores import checked_weights, complexity_score, content_size_score, metadata_score, normal_cdf

ODD = ["", "\n", "a", "a\n", "a\n\n", "a\r\nb", "a\rb\n", "\x0ba\x0cb", "a\x1cb\x1dc\x1ed", "a\x85b\u2028c\u2029", " \u3000x\xa0 "]


def test_lines_and_strip_follow_python(spark):
    rng = random.Random(7)
    samples = ODD + ["".join(rng.choice("ab \t\n\r\x0b\x85\u2028\xa0") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    rows = df.select("t", text.split_lines(F.col("t")).alias("l"), text.strip(F.col("t")).alias("s")).collect()
    for row in rows:
        assert row.l == row.t.splitlines(), repr(row.t)
        assert row.s == row.t.strip(), repr(row.t)


def test_comments_take_hash_before_slashes(spark):
    df = spark.createDataFrame([("x = 1  # one // two ",), ("a // b # c",), ("a // b",), ("none",)], "t string")
    found = [r[0] for r in df.select(text.line_comment(F.col("t"))).collect()]
    assert found == ["# one // two", "# c", "// b", None]


def test_byte_span_counts_bytes(spark):
    df = spark.createDataFrame([("éab",)], "t string")
    assert df.select(text.byte_span(F.col("t"), F.lit(2), F.lit(4))).first()[0] == "ab"


def test_extension_follows_pathlib(spark):
    names = ["a.py", ".py", "a.b.TS", "a.", ".a.py", "..py", "noext", "d.x/file", "d/a.tar.gz", "p/q.CC"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    for row in df.select("p", labels.file_extension(F.col("p")).alias("e"), labels.language_of(F.col("p")).alias("l")).collect():
        suffix = PurePosixPath(row.p).suffix.lower()
        assert row.e == suffix
        assert row.l == labels.PARSER_LANGUAGES.get(suffix)


@pytest.mark.parametrize(
    ("scheme", "value", "word"),
    [
        ("file", 0.3, "medium"), ("file", 0.2999, "low"), ("file", 0.6, "high"), ("file", 1.0, "high"),
        ("content", 0.4, "MEDIUM"), ("repository", 0.7, "HIGH"), ("metadata", 0.6, "MEDIUM"), ("metadata", 0.3, "LOW"),
        ("dataset", 0.6, "HIGH"), ("dataset", 0.3, "MEDIUM"), ("function", 15.0, "medium"), ("function", 15.5, "high"),
        ("function", 7.0, "low"), ("directory", 0.6, "medium"), ("directory", 0.61, "high"),
    ],
)
def test_severity_bounds(spark, scheme, value, word):
    assert spark.range(1).select(labels.severity(F.lit(value), scheme)).first()[0] == word


def test_unknown_severity_scheme_is_refused():
    with pytest.raises(ValueError):
        labels.severity(None, "other")


def test_size_tier_is_right_closed(spark):
    df = spark.createDataFrame([(0,), (1,), (15000,), (15001,), (35000,), (50000,), (50001,)], "s int")
    assert [r[0] for r in df.select(labels.size_tier(F.col("s"))).collect()] == [
        None, "Small", "Small", "Medium", "Medium", "Large", None,
    ]


def test_undefined_effect_and_kappa_words(spark):
    row = spark.range(1).select(
        labels.effect_words(F.lit(float("nan"))), labels.effect_words(F.lit(-0.5)), labels.kappa_words(F.lit(None).cast("double"))
    )
    assert tuple(row.first()) == ("undefined", "medium", "undefined")


MESSAGES = [
    ("update tests - co-authored-by: github copilot", 1, "High"),
    ("fix issue - generated by chatgpt", 1, "Medium"),
    ("implement parser - ai-assisted", 1, "Medium"),
    ("[AI] ai-generated code", 2, "High"),
    ("auto-generated by ai", 2, "High"),
    ("refactor build", 0, "Low"),
]


def test_markers_on_messages(spark):
    df = spark.createDataFrame(MESSAGES, "m string, n int, c string")
    count = markers.marker_count(F.col("m"))
    for row in df.select(
        "*", count.alias("k"), markers.commit_confidence(F.col("m"), count).alias("conf"), markers.marker_signals(F.col("m")).alias("s")
    ).collect():
        assert (row.k, row.conf, len(row.s)) == (row.n, row.c, row.n)


def test_repository_confidence_bounds(spark):
    df = spark.createDataFrame([(0.2,), (0.05,), (0.01,), (0.0,)], "r double")
    out = [tuple(r) for r in df.select(markers.ratio_confidence(F.col("r")), markers.likely_assisted(F.col("r"))).collect()]
    assert out == [("High", True), ("Medium", False), ("Low", False), ("None", False)]


def test_repository_address(spark):
    urls = [
        "https://github.com/a/b", "https://github.com/a/b.git", "https://github.com/a/b/", "https://github.com/a/b/tree/dev/src",
        "https://example.org/a/b",
    ]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    out = [r[0] for r in df.select(paths.repository_address(F.col("u"))).collect()]
    assert [(r.owner, r.repo, r.branch, r.path) if r else None for r in out] == [
        ("a", "b", "main", ""), ("a", "b", "main", ""), ("a", "b", "main", ""), ("a", "b", "dev", "src"), None,
    ]


def test_skip_rules(spark):
    df = spark.createDataFrame([("src/a.py",), ("dist/a.py",), (".x/a.py",), ("a/.env.py",), ("env/a.py",)], "p string")
    out = [tuple(r) for r in df.select(paths.in_skipped_tree(F.col("p")), paths.in_skipped_blob_folder(F.col("p"))).collect()]
    assert out == [(False, False), (True, True), (False, True), (False, False), (False, True)]


def test_slug(spark):
    query = 'copilot "language:python" ' + "x" * 60
    got = spark.createDataFrame([(query,)], "q string").select(paths.query_slug(F.col("q"))).first()[0]
    # Equal starts are told apart by a hash of the whole query.
    assert got == query.replace('"', "").replace(":", "_").replace(" ", "_")[:50] + "-" + hashlib.md5(query.encode()).hexdigest()[:8]


def test_rounding_and_clamp(spark):
    values = [4.125, 2.675, 0.00005, 33.333333, -1.0, 2.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(round_to(F.col("v"), 2)).collect()][:2] == [4.12, 2.68]
    assert df.select(round_to(F.col("v"), 4)).collect()[2][0] == 0.0001
    assert [r[0] for r in df.select(clamp(F.col("v"))).collect()][-2:] == [0.0, 1.0]


def test_weights():
    assert checked_weights('{"complexity": 0.3}')["duplication"] == 0.25
    assert checked_weights("not json") == checked_weights()
    with pytest.raises(ValueError, match="sum to 1.0"):
        checked_weights({"complexity": 0.5, "duplication": 0.5, "documentation": 0.5, "error_handling": 0.5})


def test_formulas(spark):
    lit = lambda *xs: [F.lit(x) for x in xs]
    row = spark.range(1).select(
        complexity_score(*lit(4, 15.0, 35.0, 21.0)),
        complexity_score(*lit(0, 0.0, 0.0, 0.0)),
        content_size_score(*lit(900, 10))["debt_score"],
        metadata_score(*lit(20000, 2000))["debt_score"],
        metadata_score(F.lit(None).cast("long"), F.lit(None).cast("long"))["debt_score"],
        normal_cdf(F.lit(1.96)),
    ).first()
    assert row[0] == 1.0 and row[1] == 0.0
    assert abs(row[2] - 0.45) < 1e-12 and abs(row[3] - 0.45) < 1e-12 and row[4] == 0.35
    assert abs(row[5] - 0.9750021) < 1e-6
