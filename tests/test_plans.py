"""What the outline, the node table and the complexities shuffle and evaluate."""

import contextlib
import datetime
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from debtscope.operators.complexity import function_complexity
from debtscope.operators.outline import outline
from debtscope.plans.bindings import order_nodes
from debtscope.schemas import SYNTAX_NODES

TEXTS = {"python": "def f(a):\n    return open(a)\n", "java": "class A { int f(int a) { if (a > 1) { return g(a); } } }\n"}


def parts_of(df, operator):
    """Parts of the plan that tell about one kind of operator."""
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return re.findall(rf"^\(\d+\) {operator}\b.*\n(?:.+\n)*", text.getvalue(), re.M)


@pytest.mark.parametrize("language", TEXTS)
def test_outline_spreads_texts(spark, language):
    files = spark.range(64).coalesce(1).select(
        F.col("id").alias("file_id"), F.lit(language).alias("language"), F.lit(TEXTS[language]).alias("content")
    )
    spread = outline(files).where("parent_id is not null").select(F.spark_partition_id().alias("p")).distinct()
    assert spread.count() == 4


@pytest.mark.parametrize("language", TEXTS)
def test_outline_reads_a_text_once(spark, language, tmp_path):
    spark.createDataFrame([(1, language, TEXTS[language])], "file_id long, language string, content string").write.parquet(str(tmp_path / "f"))
    nodes = outline(spark.read.parquet(str(tmp_path / "f")))
    assert not [part for part in parts_of(nodes, "Filter") if "regexp_extract_all" in part]


def random_nodes(spark):
    """Nested functions, loops and assertions of one file."""
    rng, rows, clock = random.Random(3), [], [0]

    def grow(parent, depth):
        kind = rng.choice(["function_definition", "if_statement", "for_statement", "assert_statement", "boolean_operator"] if depth < 6 else ["assert_statement"])
        clock[0] += 1
        at, spot = clock[0], len(rows)
        rows.append(None)
        if kind not in ("assert_statement", "boolean_operator"):
            for _ in range(rng.randint(0, 5)):
                grow(at, depth + 1)
        rows[spot] = ("f", "python", at, parent, 0, at, clock[0], kind, at, at, None)

    for _ in range(40):
        grow(0, 0)
    names = ["file_id", "language", "node_id", "parent_id", "sibling_ord", "pre", "post", "type", "start_line", "end_line", "text"]
    return spark.createDataFrame([dict(zip(names, r)) for r in rows], SYNTAX_NODES)


@pytest.mark.parametrize("block", [1, 8, 64])
def test_complexity_does_not_depend_on_blocks(spark, block):
    nodes = random_nodes(spark)
    found = lambda n: sorted(map(tuple, function_complexity(nodes, n).collect()))
    assert found(block) == found(1 << 20) != []


def test_events_are_shuffled_once(spark):
    nodes = random_nodes(spark).repartition(3)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = function_complexity(nodes)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # The second one only feeds sums of steps, added up before their shuffle.
    assert plan.count("Generate explode") <= 2


def write_orders(spark, folder, lines):
    day = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(1, 0)], "c_custkey long, c_nationkey long").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(5, 1, "P", 1.0, "2-HIGH")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(
        [(5, n, k, 1, 1.0, 1.0, 0.0, 0.0, "R", "F", day) for n, k in lines],
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
    ).write.parquet(f"{folder}/lineitem.parquet")


def test_lines_are_shuffled_once_and_keep_their_order(spark, tmp_path):
    numbers = [(None, 7), *[(n, k) for n in (1, 2, 1023, 1024, 1025, 5000) for k in (3, 900)]]
    random.Random(1).shuffle(numbers)
    write_orders(spark, tmp_path, numbers)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nodes = order_nodes(spark, str(tmp_path))
        assert len([part for part in parts_of(nodes, "Exchange") if "l_tax" in part]) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    body = nodes.where("type = 'assert_statement'").orderBy("node_id").collect()
    assert [r.node_id for r in body] == list(range(4 + 5, 4 + 5 + len(numbers)))


def test_partitions_follow_the_bytes_of_text(spark, monkeypatch):
    monkeypatch.setattr("debtscope.operators.outline.TEXT_PER_TASK", 100)
    files = spark.range(64).select(F.col("id").alias("file_id"), F.lit("python").alias("language"), F.lit(TEXTS["python"]).alias("content"))
    spread = outline(files).where("parent_id is not null").select(F.spark_partition_id().alias("p")).distinct()
    assert spread.count() > 10
