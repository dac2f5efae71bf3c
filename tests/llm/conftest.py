import pytest

from debtscope.session import work_path


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    assert work_path(spark, "x")


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (doc_id, text) and what else is named."""

    def build(rows, schema="doc_id long, text string", parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts) if rows else spark.createDataFrame([], schema)

    return build
