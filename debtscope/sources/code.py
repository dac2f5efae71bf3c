"""Source texts from folders and from blob tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from debtscope.functions.labels import PARSER_LANGUAGES, language_of
from debtscope.functions.paths import below, in_skipped_tree
from debtscope.functions.text import is_blank


def decoded(raw: Column, drop_bad: bool) -> Column:
    """UTF-8 text of bytes; malformed parts are dropped or replaced by U+FFFD."""
    text = F.make_valid_utf8(raw.cast("string"))
    return F.translate(text, "�", "") if drop_bad else text


def blob_texts(blobs: DataFrame, content: str = "content") -> DataFrame:
    """Base64 content to text: malformed bytes ignored, blank texts dropped."""
    text = decoded(F.unbase64(F.col(content)), drop_bad=True)
    return blobs.withColumn(content, text).where(~is_blank(F.col(content)))


def source_tree(spark: SparkSession, folder: str) -> DataFrame:
    """All supported files below a folder, skipped folders and blank files left out.

    Paths are filtered on the file listing, before any content is read; only
    their part below ``folder`` counts. Suffixes may have either case. ``repo``
    is the first folder below ``folder``, null for a file right in it.
    """
    either = lambda s: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s)
    suffixes = ",".join(either(s.lstrip(".")) for s in PARSER_LANGUAGES)
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*.{{{suffixes}}}")
        .load(folder)
    )
    path, inner = F.col("path"), below(F.col("path"), folder)
    kept = listed.where(~in_skipped_tree(inner)).withColumn("language", language_of(path))
    texts = kept.select(
        F.md5("path").alias("file_id"),
        F.when(inner.contains("/"), F.substring_index(inner, "/", 1)).alias("repo"),
        "path",
        "language",
        decoded(F.col("content"), drop_bad=False).alias("content"),
        F.col("length").alias("size_bytes"),
    )
    return texts.where(~is_blank(F.col("content")))
