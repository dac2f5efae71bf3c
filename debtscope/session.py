"""Session helpers."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "debtscope", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on and UTC timestamps.

    The master, memory and shuffle sizes are left to the cluster unless given.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables: the one the cluster names.

    Where none is set, a folder in the session's warehouse, which all executors
    share as well.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_LANDED: dict[tuple[str, str, str], str] = {}


def landed(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, written once per session to the shared folder and read back.

    For tables that several branches of a plan read: they scan only the columns
    and rows they need instead of deriving everything again, and a lost
    executor costs a re-read.
    """
    key = (spark.sparkContext.applicationId, os.path.abspath(folder), name)
    if key not in _LANDED:
        path = work_path(spark, f"landed-{name}")
        build().write.parquet(path)
        _LANDED[key] = path
    return spark.read.parquet(_LANDED[key])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
