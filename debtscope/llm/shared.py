"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import debtscope
from debtscope.session import work_path

#: The six white-space characters that separate words.
WHITE = " \t\n\x0b\f\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to a fresh folder of the shared place and read it back.

    Later branches scan the table, and a lost executor costs a re-read.
    """
    path = work_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str | Column) -> Column:
    """A text with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text that is not null, in order."""
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITE_RUN))


def word_count(text: Column) -> Column:
    """Number of words of a text that is not null."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def with_columns(df: DataFrame, added: Iterable[tuple[str, Column]], drop: Iterable[str] = ()) -> DataFrame:
    """Columns of ``df`` and the added ones; an input column of an added name is replaced."""
    added = list(added)
    new = {name for name, _ in added} | set(drop)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in new], *[value.alias(name) for name, value in added])


def beside(docs: DataFrame, drop: Iterable[str] = (), **parts: Column) -> DataFrame:
    """Each row as one struct ``row``, without the columns in ``drop``, and what an operator needs beside it.

    Helper columns then clash with no input column.
    """
    dropped = set(drop)
    names = [F.col(f"`{c}`") for c in docs.columns if c not in dropped]
    return docs.select(F.struct(*names or [F.lit(0).alias("none")]).alias("row"), *[value.alias(name) for name, value in parts.items()])


def of_row(docs: DataFrame, drop: Iterable[str] = ()) -> list[Column]:
    """The columns of ``docs`` out of a struct that ``beside`` made, without those in ``drop``."""
    dropped = set(drop)
    return [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in dropped]


def same(left: Column, right: Column) -> Column:
    """Equality under which null equals null."""
    return left.eqNullSafe(right)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, as Spark sends a Python file."""
    root = Path(debtscope.__file__).parent
    if spark.sparkContext.applicationId in _SHIPPED or not root.is_dir():
        return
    handle, name = tempfile.mkstemp(prefix="debtscope-", suffix=".zip")
    with os.fdopen(handle, "wb") as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(name)
    _SHIPPED.add(spark.sparkContext.applicationId)


def in_arrow(df: DataFrame, scan: Callable, schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow`` with this package at hand on every executor."""
    ship_package(df.sparkSession)
    return df.mapInArrow(scan, schema)
