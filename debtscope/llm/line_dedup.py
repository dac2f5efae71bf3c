"""Lines that many documents share, taken out everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from debtscope.llm.shared import WHITE, ascii_lower, beside, same, text_of

#: Each shared key is copied to so many salts, so that its places spread over as many tasks.
SALTS = 8


def line_key(line: Column) -> Column:
    """A line without white space at its ends and with A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def _hashed(key: Column) -> tuple[Column, Column]:
    """128 bits of a key: two hashes of other seeds, as the number before the key seeds the second."""
    return F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")


def drop_shared_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1
) -> DataFrame:
    """Drop every line whose key is found in at least ``min_docs`` documents.

    Lines are exploded and hashed (128 bits); a key counts once per document,
    keys are counted with partial sums before the shuffle, and places of
    shared keys come back as a list of positions per document. Only that last
    join moves texts.

    Returns all columns of ``docs`` with the text rewritten, and ``n_lines``
    (before dropping) and ``n_dropped``; input columns of these two names are
    replaced. Every row is a document of its own, equal rows too. A null or
    empty text is one empty line. Keys shorter than ``min_chars`` code points
    stay. A text that loses all lines is empty.
    """
    text = text_of(text_col)
    ident = [F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("t")]

    keys = docs.select(F.explode(F.array_distinct(F.transform(F.split(text, "\n"), line_key))).alias("key"))
    shared = (
        keys.where(F.length("key") >= min_chars)
        .groupBy(*_hashed(F.col("key")))
        .count()
        .where(F.col("count") >= min_docs)
        .select("h1", "h2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )

    places = (
        docs.select(*ident, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
        .withColumn("key", line_key(F.col("line")))
        .where(F.length("key") >= min_chars)
        .select("id", "t", "pos", *_hashed(F.col("key")), F.pmod(F.col("t") + F.col("pos"), F.lit(SALTS)).cast("int").alias("salt"))
    )
    dropped = (
        places.join(shared, ["h1", "h2", "salt"], "left_semi")
        .groupBy(F.col("id").alias("did"), F.col("t").alias("dt"))
        .agg(F.collect_set("pos").alias("found"))
    )

    named = beside(docs, ["n_lines", "n_dropped"], id=ident[0], t=ident[1])
    joined = named.join(dropped, same(F.col("id"), F.col("did")) & (F.col("t") == F.col("dt")), "left")
    # Texts move once, as they are; lines are cut again behind the join.
    lined = joined.withColumn("lines", F.split(text_of(F.col(f"row.`{text_col}`")), "\n")).withColumn("gone", F.coalesce("found", F.array().cast("array<int>")))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")), lambda p: F.col("lines")[p])
    rest = [F.array_join(kept, "\n").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return lined.select(*rest, F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"))
