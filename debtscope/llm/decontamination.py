"""Benchmark passages found in training texts and taken out."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from debtscope.llm.shared import ascii_lower, beside, in_arrow, of_row, stored, text_of

#: A-Z become a-z, digits, a-z and all bytes from 128 stay, everything else separates words.
_KEPT = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_SPAN = re.compile(rb"[^ ]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text whose words are held and hashed together in a task.
_TEXT = 4 << 20


def normalised_words(text: bytes) -> list[bytes]:
    """Lower-cased words of a UTF-8 text."""
    return text.translate(_KEPT).split()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words."""
    n = max(len(hashes) - width + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = out * _STEP + hashes[j : n + j]
    return out


class WindowSet:
    """Hashes of the windows of some items, with what is needed to verify a hit."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.items = [(name, w) for name, text in items if (w := normalised_words(text))]
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for k, (_, words) in enumerate(self.items):
            long = min(width, len(words))
            h = _windows(_hashes(words), long)
            found.setdefault(long, []).append((h, np.full(len(h), k), np.arange(len(h))))
        self.by_width = {}
        for long, parts in found.items():
            h, k, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[(h >> np.uint64(44)).astype(np.int64)] = True
            self.by_width[long] = (h[order], k[order], at[order], seen)

    def hits(self, words: list[bytes], ends: np.ndarray) -> Iterator[tuple[int, int, str]]:
        """First and next-to-last word and the item of each verified window.

        ``ends`` holds for each word the end of its document; windows that
        would cross it are left out.
        """
        hashes = _hashes(words)
        for long, (known, items, ats, seen) in self.by_width.items():
            rolled = _windows(hashes, long)
            at = np.flatnonzero(seen[(rolled >> np.uint64(44)).astype(np.int64)])
            at = at[at + long <= ends[at]]
            low, high = (np.searchsorted(known, rolled[at], side) for side in ("left", "right"))
            for i, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
                for k in range(a, b):
                    name, own = self.items[items[k]]
                    if own[ats[k] : ats[k] + long] == words[i : i + long]:
                        yield i, i + long, name


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from the first to the last word of each range."""
    spans = [m.span() for m in _SPAN.finditer(text.translate(_KEPT))]
    out, at = [], 0
    for a, b in ranges:
        out.append(text[at : spans[a][0]])
        at = spans[b - 1][1]
    return b"".join([*out, text[at:]])


_ARROW_RANGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _segments(text: bytes, overlap: int) -> Iterator[tuple[int, list[bytes]]]:
    """Words of a text a part at a time, each with the number of its first word; a part repeats the last ``overlap`` words."""
    plain, at, seen, tail = text.translate(_KEPT), 0, 0, []
    while at < len(plain):
        end = at + _TEXT
        while end < len(plain) and plain[end] != 32:
            end += 1
        words = plain[at:end].split()
        yield seen - len(tail), tail + words
        seen, at, tail = seen + len(words), end, (tail + words)[-overlap:] if overlap else []


class _Found:
    """Hits of the documents of a batch, looked for some bytes of text at a time."""

    def __init__(self, windows: WindowSet):
        self.windows, self.overlap = windows, max(windows.by_width, default=1) - 1
        self.counts: list[int] = []
        self.ranges: dict[int, list[tuple[int, int]]] = {}
        self.names: dict[int, set[str]] = {}
        self.pending: list[tuple[int, int, list[bytes]]] = []
        self.held = 0

    def add(self, text: bytes) -> None:
        count = 0
        for first, words in _segments(text, self.overlap):
            count = first + len(words)
            self.pending.append((len(self.counts), first, words))
            self.held += sum(map(len, words)) + 8 * len(words)
            if self.held >= _TEXT:
                self.flush()
        self.counts.append(count)

    def flush(self) -> None:
        sizes = np.array([len(w) for _, _, w in self.pending], np.int64)
        ends = np.cumsum(sizes)
        for i, j, name in self.windows.hits(list(chain.from_iterable(w for _, _, w in self.pending)), np.repeat(ends, sizes)):
            part = int(np.searchsorted(ends, i, "right"))
            doc, first, _ = self.pending[part]
            base = int(ends[part] - sizes[part]) - first
            self.ranges.setdefault(doc, []).append((i - base, j - base))
            self.names.setdefault(doc, set()).add(name)
        self.pending, self.held = [], 0


_HITS = "n_words bigint, ranges array<struct<start:int,end:int>>, found array<string>"


def _pass(docs: DataFrame, known, last: bool, clean: bool) -> DataFrame:
    """One scan of all texts for the windows of one broadcast set.

    ``docs`` has ``row``, ``text`` and, after the first pass, what was found so
    far. The last pass leaves the text out and, where asked, cuts the ranges
    out of the texts that have any.
    """
    fields = T._parse_datatype_string("row int, text string, " + _HITS + ", clean string").fields
    carried = [docs.schema["row"], *([] if last else [fields[1]])]
    added = [*fields[2:5], *([fields[5]] if clean and last else [])]
    again = "ranges" in docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = known.value
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            found = _Found(windows)
            for x in texts:
                found.add(x.as_py() or b"")
            found.flush()
            ranges = [_merged(found.ranges.get(k, [])) for k in range(len(texts))]
            names = [found.names.get(k, set()) for k in range(len(texts))]
            if again:
                before, said = batch.column("ranges").to_pylist(), batch.column("found").to_pylist()
                ranges = [_merged([*((r["start"], r["end"]) for r in old), *new]) for old, new in zip(before, ranges, strict=True)]
                names = [new.union(old) for old, new in zip(said, names, strict=True)]
            columns = [
                *[batch.column(f.name) for f in carried],
                pa.array(found.counts, pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in r] for r in ranges], _ARROW_RANGES),
                pa.array([sorted(x) for x in names], pa.list_(pa.string())),
            ]
            if clean and last:
                columns.append(pa.array([_cut(t.as_py(), r) if r else None for t, r in zip(texts, ranges, strict=True)], pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in [*carried, *added]])

    return in_arrow(docs, scan, T.StructType([*carried, *added]))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    width: int = 10,
    set_windows: int = 500_000,
    clean: bool = False,
) -> DataFrame:
    """Find benchmark windows of ``width`` words in every text.

    ``benchmark`` has ``item_id`` and ``text``; an item of fewer words is one
    window, one of no words none. Windows are hashed, the hash set is broadcast
    and every hit is verified word by word. The set holds at most
    ``set_windows`` windows (or one item); a larger benchmark is cut into
    several sets and the texts are scanned once for each.

    Adds ``n_words``, ``n_hit`` (words inside a hit), ``spans`` (ranges of
    words), ``items`` (names of the items found, sorted) and ``contaminated``;
    with ``clean`` also ``clean_text``, the text without the spans where there
    are any, else null. The text itself is left out. Input columns of these
    names are replaced. Null texts have no words; a null item name counts as
    empty. Rows and their repeats are kept. A task holds the words of about
    ``_TEXT`` bytes of text, also of a single long one.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), text_of("text").alias("text"))
    sized = items.withColumn("_n", F.greatest(F.regexp_count(ascii_lower(F.col("text")), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")), F.lit(1)))
    along = W.orderBy("name", "text").rowsBetween(W.unboundedPreceding, -1)
    cut = sized.withColumn("_set", F.floor(F.coalesce(F.sum("_n").over(along), F.lit(0)) / set_windows))
    sets = (sized.agg(F.floor(F.sum("_n") / set_windows)).first()[0] or 0) + 1
    replaced = [text_col, "n_words", "n_hit", "spans", "items", "contaminated", "clean_text"]
    out = beside(docs, replaced, text=F.col(f"`{text_col}`"))
    for k in range(sets):
        chosen = [(r["name"], r["text"].encode()) for r in cut.where(F.col("_set") == k).select("name", "text").collect()]
        out = _pass(out, spark.sparkContext.broadcast(WindowSet(chosen, width)), k == sets - 1, clean)
    return out.select(
        *of_row(docs, replaced),
        "n_words",
        F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"]).alias("n_hit"),
        F.col("ranges").alias("spans"),
        F.array_sort("found").alias("items"),
        (F.size("ranges") > 0).alias("contaminated"),
        *([F.col("clean").alias("clean_text")] if clean else []),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents, or with the spans cut out of them.

    ``mode`` is "documents" or "spans". Columns are those of ``docs``. Only
    texts and their digests are scanned; digests of contaminated texts come
    back and are joined, so clean documents are never rewritten. Equal texts
    share their verdict; null texts are clean, and an empty benchmark or table
    takes nothing out.
    """
    digest = F.md5(F.col(f"`{text_col}`").cast("binary"))
    texts = docs.select(digest.alias("digest"), F.col(f"`{text_col}`").alias("text"))
    hits = find_leaks(texts, benchmark, clean=mode == "spans", **options).where("contaminated")
    found = stored(hits.select(F.col("digest").alias("hit"), *(["clean_text"] if mode == "spans" else [])).dropDuplicates(["hit"]), "leaks")
    rows = beside(docs, digest=digest)
    if mode == "documents":
        return rows.join(found, F.col("digest") == F.col("hit"), "left_anti").select(*of_row(docs))
    kept = rows.join(found, F.col("digest") == F.col("hit"), "left")
    whole = F.when(F.col("hit").isNotNull(), F.col("clean_text")).otherwise(F.col(f"row.`{text_col}`")).alias(text_col)
    return kept.select(*[whole if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
