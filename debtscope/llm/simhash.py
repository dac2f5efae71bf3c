"""Near copies by SimHash fingerprints that meet at the anchors of a covering code."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from debtscope.llm.components import components
from debtscope.llm.shared import beside, in_arrow, of_row, same, stored

_LOW = (1 << 31) - 1
#: Parity checks of the Hamming code of length 31: place p (from 1) takes part in check k if bit k of p is set.
_CHECKS = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]
_CHUNK = 1 << 15


def shingle_hashes(text: bytes, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Hash of every word shingle of a UTF-8 text; a text of fewer words is one shingle, none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(words)] if len(words) < shingle else list(map(b" ".join, zip(*[words[i:] for i in range(shingle)])))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(shingles))


def bit_sums(hashes: np.ndarray) -> int:
    """64-bit SimHash of hashes; 0 of none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[at : at + _CHUNK]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = (counts * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text; 0 without words."""
    return bit_sums(shingle_hashes(text, shingle, seed))


def with_fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3, seed: int = 42, out: str = "fingerprint") -> DataFrame:
    """Columns of ``docs`` but the text, and the fingerprint as a long.

    Null and empty texts have fingerprint 0. Whole texts are read, one at a
    time inside Arrow batches.
    """
    carried = [f for f in docs.schema if f.name not in (text_col, out)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).cast(pa.binary())
            values = pa.array((fingerprint(x.as_py() or b"", shingle, seed) for x in texts), pa.int64(), size=len(texts))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in carried], values], [*[f.name for f in carried], out])

    return in_arrow(docs, scan, T.StructType([*carried, T.StructField(out, T.LongType())]))


def _syndrome(half: Column) -> Column:
    value = F.lit(0)
    for k, mask in enumerate(_CHECKS):
        value = value + F.bit_count(half.bitwiseAND(F.lit(mask))) % 2 * (1 << k)
    return value.cast("int")


def _place(p: Column) -> Column:
    return F.when(p > 0, F.call_function("shiftleft", F.lit(1).cast("long"), (p - 1).cast("int"))).otherwise(F.lit(0).cast("long"))


def _halves(prints: DataFrame) -> DataFrame:
    """Each fingerprint twice: a side, the 32 bits of that side and their syndrome."""
    low = F.col("fp").bitwiseAND(F.lit((1 << 32) - 1))
    high = F.call_function("shiftrightunsigned", F.col("fp"), F.lit(32))
    sides = F.array(F.struct(F.lit(0).alias("side"), low.alias("half")), F.struct(F.lit(1).alias("side"), high.alias("half")))
    cut = prints.select("fp", F.explode(sides).alias("_x")).select("fp", "_x.side", "_x.half")
    return cut.withColumn("_s", _syndrome(F.col("half")))


def links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs of distinct fingerprints that differ in at most ``max_bits`` bits (at most 3).

    Of two such fingerprints one half differs in at most one bit. Anchors of a
    half are the words of the perfect Hamming code of length 31 with the 32nd
    bit free: its covering radius is 1. A fingerprint's home is the nearest
    anchor, at distance 1 or less; the partner is within 2 of it. So each
    fingerprint is copied to every anchor within 2 (covering radius plus
    threshold, at most 17 a half) and compared there with those at home, the
    smaller one being the one at home. Pairs are compared in the join and only
    links leave it. Both sides are shuffled: Spark sizes them as if an explode
    added no rows, and would broadcast 34 copies of every fingerprint.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("halves cover at most three differing bits")
    cut = _halves(prints)
    home = F.col("half").bitwiseXOR(_place(F.col("_s")))
    homes = cut.select(F.col("fp").alias("a"), "side", home.alias("anchor"))
    top = F.lit(1 << 31)
    pairs = F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(31)), lambda i: (F.col("_s") > 0) & (i < i.bitwiseXOR(F.col("_s")))),
        lambda i: _place(i).bitwiseXOR(_place(i.bitwiseXOR(F.col("_s")))),
    )
    flips = F.concat(F.array(_place(F.col("_s")), _place(F.col("_s")).bitwiseXOR(top)), pairs)
    copies = cut.select(F.col("fp").alias("b"), "side", "half", F.explode(flips).alias("_flip")).select(
        "b", "side", F.col("half").bitwiseXOR(F.col("_flip")).alias("anchor")
    )
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    met = homes.join(copies.hint("merge"), (homes["side"] == copies["side"]) & (homes["anchor"] == copies["anchor"]) & near)
    return met.select("a", "b").distinct()


def _grouped(named: DataFrame, shingle: int, max_bits: int, seed: int) -> DataFrame:
    """``named`` (``doc_id``, ``_text`` and more) without the text, with ``fingerprint``, ``root`` (the group) and ``component_id``."""
    prints = stored(with_fingerprints(named, "_text", shingle, seed), "prints")
    classes = stored(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("rep")), "print-classes")
    found = stored(links(classes.select("fp"), max_bits), "print-links")
    roots = components(found)
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    firsts = rooted.groupBy(F.col("root").alias("_r")).agg(F.min("rep").alias("component_id"))
    labels = rooted.join(firsts, F.col("root") == F.col("_r")).select("fp", "root", "component_id")
    return prints.join(labels, prints["fingerprint"] == labels["fp"]).drop("fp")


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2, seed: int = 42
) -> DataFrame:
    """``doc_id, fingerprint (long), component_id`` of every document.

    ``component_id`` is the smallest id that can be reached over links. Equal
    fingerprints become one class with its smallest id before anything is
    compared; classes, links and components are stored tables, so no group of
    copies meets in one task. Every row has its own result, repeated rows equal
    ones; null ids have the component of their class, which is null where a
    group has no id at all. An empty table gives no rows, and other columns
    are not read.
    """
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("_text"))
    return _grouped(named, shingle, max_bits, seed).select("doc_id", "fingerprint", "component_id")


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2, seed: int = 42
) -> DataFrame:
    """``docs`` with one document of each group of near copies: that of the smallest id.

    A null id comes last, and of rows with equal ids in a group the text with
    the smallest digest stays; of rows with equal ids and texts one stays. No
    group takes from another, whatever ids they share. Null texts count as
    empty ones. Columns are those of ``docs``.
    """
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    digest = F.md5(F.coalesce(text.cast("binary"), F.lit(b"")))
    found = _grouped(docs.select(ident.alias("doc_id"), digest.alias("digest"), text.alias("_text")), shingle, max_bits, seed)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("first"))
    chosen = stored(first.select(F.col("first.doc_id").alias("chosen"), F.col("first.digest").alias("as")), "near-firsts")
    rows = beside(docs, id=ident, digest=digest)
    kept = rows.join(chosen, same(F.col("id"), F.col("chosen")) & (F.col("digest") == F.col("as")), "left_semi")
    marks = found.select("doc_id", "digest").join(chosen, same(F.col("doc_id"), F.col("chosen")) & (F.col("digest") == F.col("as")), "left_semi")
    if marks.count() > chosen.count():
        whole = F.xxhash64(*[F.col(f"row.`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
        kept = kept.groupBy("id", "digest").agg(F.min_by("row", whole).alias("row"))
    return kept.select(*of_row(docs))
