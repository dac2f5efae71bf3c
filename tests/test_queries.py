"""Every bound query against its check SQL, and the plans of the hot ones."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))
sys.path.insert(0, ROOT)

duckdb = pytest.importorskip("duckdb")

from check_queries import TABLES, table_of  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

FOLDER = os.environ.get("QUERY_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    sql = oracle_sql().get(name)
    if sql is None:
        return
    result = duck.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert table_of(df.columns, rows) == table_of(columns, result.fetchall())


def test_entry(spark):
    df = entry(spark)
    assert df.columns[0] == "repo" and df.count() > 0


PLAIN_PLANS = (
    "repository_debt", "duplication_by_file", "function_complexities", "function_handlings", "file_documentations",
    "commit_rollups", "repository_scores", "score_comparison", "study_report_rows",
)


#: Their last step is one row of sums.
ONE_ROW_RESULTS = ("score_comparison", "study_report_rows")


@pytest.mark.parametrize("name", PLAIN_PLANS)
def test_hot_plans_stay_in_the_engine(spark, name):
    plan = queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for slow in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert slow not in plan
    if name not in ONE_ROW_RESULTS:
        assert "SinglePartition" not in plan


def test_duplication_reads_two_columns_and_shuffles_nothing(spark):
    plan = queries()["duplication_by_file"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
