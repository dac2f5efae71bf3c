"""Long byte strings that a corpus holds more than once, taken out everywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from debtscope.llm.shared import beside, in_arrow, of_row, same, stored, text_of
from debtscope.llm.suffix_sort import repeated_starts

#: Length of a repeat, and of the piece of it that leads equal strings to one bucket.
WIDTH, GRAM = 200, 32
#: A bucket of more contexts than HOT is dealt out again by slices of SLICE starts, and a bucket of more slices by windows.
HOT, SLICE = 4_000, 8
#: Bits of the filter of repeated keys: so many a key, never more than the bound (128 MB).
KEY_BITS, MOST_BITS = 32, 1 << 30
#: Bytes of text hashed together, bytes of contexts sorted together, and contexts that a task remembers.
_BUFFER, _SORTED, _MEMORY = 1 << 20, 2 << 20, 500_000
_STEP = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 24) - 1)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes (a power of two) from each place."""
    h, n = data.astype(np.uint64) + np.uint64(1), 1
    while n < size:
        m = max(len(h) - n, 0)
        h = h[:m] * np.uint64(pow(_STEP, n, 1 << 64)) + h[n : n + m]
        n *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def window_anchors(data: np.ndarray, ends: np.ndarray, sizes: np.ndarray, width: int = WIDTH, gram: int = GRAM):
    """Each window of ``width`` bytes inside a document leads to the smallest gram hash in it.

    Returns for runs of windows with the same place of it: first window, last
    window, place and hash. Equal windows choose the same place, so they share
    a hash, whatever stands around them.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < width:
        return empty, empty, empty, empty.astype(np.uint64)
    h = gram_hashes(data, gram)
    key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    w = width - gram + 1
    blocks = -(-len(key) // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - width + 1
    least = np.minimum(back[:n], ahead[w - 1 : w - 1 + n])
    inside = np.repeat(ends, sizes)[:n] >= np.arange(n) + width
    new = np.concatenate([[True], least[1:] != least[:-1]])
    first = np.flatnonzero(inside & (new | ~np.concatenate([[False], inside[:-1]])))
    last = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]]))
    place = (least[first] & _PLACE).astype(np.int64)
    return first, last, place, h[place]


def _buffers(texts: Iterator[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined to about ``_BUFFER`` bytes: data, number of each text, its offset in the text and its size.

    A very long text comes in pieces that overlap by a window less one byte.
    """
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def joined():
        return b"".join(x[2] for x in held), *(np.array([x[k] if k < 2 else len(x[2]) for x in held], np.int64) for k in range(3))

    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - WIDTH + 1, 1), _BUFFER):
            piece = text[at : at + _BUFFER + WIDTH - 1]
            held.append((i, at, piece))
            size += len(piece)
            if size >= _BUFFER:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _binary(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    return (x.as_py() or b"" for x in batch.column(name).cast(pa.binary()))


def _repeated_keys(keys: DataFrame):
    """A broadcast filter that holds every key counted at least twice."""
    return key_filter(keys.groupBy("h").agg(F.sum("n").alias("n")).where("n >= 2").select("h"))


def key_filter(keys: DataFrame):
    """A broadcast filter that holds the distinct keys ``h``.

    It only spares work: keys that pass by chance are told apart later. Its
    size follows the number of keys up to a fixed bound.
    """
    spark = keys.sparkSession
    often = stored(keys, "repeated-keys")
    bits = 1 << 16
    wanted = min(often.count() * KEY_BITS, MOST_BITS)
    while bits < wanted:
        bits *= 2
    low = F.col("h").bitwiseAND(F.lit(bits - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    words = often.groupBy(F.call_function("shiftright", low, F.lit(6)).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return spark.sparkContext.broadcast(table.view(np.uint64))


def passes(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    low = h & np.uint64(len(table) * 64 - 1)
    return (table[(low >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)


def _key_rows(h: np.ndarray) -> pa.RecordBatch:
    keys, n = np.unique(h, return_counts=True)
    return pa.RecordBatch.from_arrays([_signed(keys), pa.array(n, pa.int64())], ["h", "n"])


def _anchor_keys(docs: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, _, _, sizes in _buffers(_binary(batch, "text")):
                yield _key_rows(window_anchors(np.frombuffer(data, np.uint8), np.cumsum(sizes), sizes)[3])

    return in_arrow(docs.select("text"), scan, "h bigint, n bigint")


class _Once:
    """Contexts met in a task: bytes go out the first time, a mark that it came again the second."""

    def __init__(self):
        self.met: dict[bytes, bool] = {}

    def wants(self, digest: bytes) -> bool | None:
        before = self.met.get(digest)
        if before:
            return None
        if len(self.met) > _MEMORY:
            self.met.clear()
        self.met[digest] = before is not None
        return before is None


_NAMES = ["h", "c1", "c2", "gap", "size", "context"]
_CONTEXT = "h bigint, c1 bigint, c2 bigint, gap int, size int, context binary"


def _context_rows(rows: list[tuple], digests: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return [
        pa.array([r[0] for r in rows], pa.int64()),
        pa.array(both[:, 0]),
        pa.array(both[:, 1]),
        pa.array([r[1] for r in rows], pa.int32()),
        pa.array([r[2] for r in rows], pa.int32()),
        pa.array([r[3] for r in rows], pa.binary()),
    ]


def _contexts(docs: DataFrame, known) -> DataFrame:
    """Windows whose key is repeated, as contexts, with the document and place of each.

    A row without bytes is one whose context this task has sent before.
    ``fresh`` tells rows that stand for the context itself: its first and
    second time in a task.
    """
    carried = [f for f in docs.schema if f.name != "text"]
    schema = T.StructType([*T.StructType.fromDDL(_CONTEXT), T.StructField("fresh", T.BooleanType()), *carried, T.StructField("at", T.LongType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = _Once()
        for batch in batches:
            for data, which, offsets, sizes in _buffers(_binary(batch, "text")):
                ends = np.cumsum(sizes)
                first, last, place, h = window_anchors(np.frombuffer(data, np.uint8), ends, sizes)
                good = passes(known.value, h)
                first, last, place, h = first[good], last[good], place[good], h[good]
                unit = np.searchsorted(ends, first, "right")
                rows, digests, fresh = [], [], []
                for a, b, p, k in zip(first.tolist(), last.tolist(), place.tolist(), h.view(np.int64).tolist(), strict=True):
                    context = data[a : b + WIDTH]
                    digest = xxhash.xxh3_128_digest(context)
                    wants = once.wants(digest)
                    rows.append((k, p - a, len(context), context if wants else None))
                    digests.append(digest)
                    fresh.append(wants is not None)
                if rows:
                    owner = batch.select([f.name for f in carried]).take(pa.array(which[unit]))
                    columns = [*_context_rows(rows, digests), pa.array(fresh), *[owner.column(f.name) for f in carried], pa.array(first - (ends - sizes)[unit] + offsets[unit])]
                    yield pa.RecordBatch.from_arrays(columns, schema.names)

    return in_arrow(docs, scan, schema)


def _slices(context: bytes, gap: int) -> Iterator[tuple[int, int, int, int]]:
    """Starts of a context by their distance to its anchor, in cells of ``SLICE``.

    Yields first start, last start, the key of the bytes that all windows of
    the cell have in common, and the distance from the first start to the anchor.
    """
    for cell in range(max(gap - (len(context) - WIDTH), 0) // SLICE, gap // SLICE + 1):
        a = max(0, gap - (cell + 1) * SLICE + 1)
        b = min(len(context) - WIDTH, gap - cell * SLICE)
        if a <= b:
            shared = context[gap - cell * SLICE : gap - (cell + 1) * SLICE + 1 + WIDTH]
            yield a, b, xxhash.xxh3_64_intdigest(shared, cell), gap - a


def _slice_keys(contexts: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [k for x, gap in zip(batch.column("context").to_pylist(), batch.column("gap").to_pylist(), strict=True) for _, _, k, _ in _slices(x, gap)]
            yield _key_rows(np.array(found, np.uint64))

    return in_arrow(contexts.select("context", "gap"), scan, "h bigint, n bigint")


def _sliced(contexts: DataFrame, known) -> DataFrame:
    """Slices with a repeated key, as contexts of their own, each with its parent and its place there."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = _Once()
        for batch in batches:
            rows, digests, fresh, parents, at = [], [], [], [], []
            for i, (x, gap) in enumerate(zip(batch.column("context").to_pylist(), batch.column("gap").to_pylist(), strict=True)):
                cells = list(_slices(x, gap))
                good = passes(known.value, np.array([c[2] for c in cells], np.uint64))
                for (a, b, key, left), yes in zip(cells, good.tolist(), strict=True):
                    if yes:
                        piece = x[a : b + WIDTH]
                        digest = xxhash.xxh3_128_digest(piece)
                        wants = once.wants(digest)
                        rows.append((int(np.uint64(key).view(np.int64)), left, len(piece), piece if wants else None))
                        digests.append(digest)
                        fresh.append(wants is not None)
                        parents.append(i)
                        at.append(a)
            if rows:
                owner = batch.select(["c1", "c2"]).take(pa.array(parents, pa.int64()))
                columns = [*_context_rows(rows, digests), pa.array(fresh), owner.column("c1"), owner.column("c2"), pa.array(at, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*_NAMES, "fresh", "p1", "p2", "at"])

    return in_arrow(contexts.select("c1", "c2", "gap", "context"), scan, _CONTEXT + ", fresh boolean, p1 bigint, p2 bigint, at bigint")


def _sorted_repeats(contexts: DataFrame) -> DataFrame:
    """``c1, c2, a, b``: ranges of bytes of each context that repeats cover.

    Contexts of a key come together; whole buckets are suffix-sorted about
    ``_SORTED`` bytes at a time. Equal contexts are one text with a multiplicity.
    """
    names = ["c1", "c2", "a", "b"]

    def ranges(held: dict[tuple[int, int], list]) -> pa.RecordBatch:
        keys = list(held)
        which, first, last = repeated_starts([held[k][0] for k in keys], WIDTH)
        many = np.flatnonzero([held[k][1] > 1 for k in keys])
        some = ~np.isin(which, many)
        sizes = np.array([len(held[k][0]) for k in keys], np.int64)
        of = np.concatenate([which[some], many])
        a = np.concatenate([first[some], np.zeros(len(many), np.int64)])
        b = np.concatenate([last[some] + WIDTH, sizes[many]])
        pairs = np.array(keys, np.int64).reshape(-1, 2)[of]
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(a), pa.array(b)], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        size, bucket = 0, None
        for batch in batches:
            for h, c1, c2, context in zip(*(batch.column(n).to_pylist() for n in ("h", "c1", "c2", "context")), strict=True):
                if h != bucket and size >= _SORTED:
                    yield ranges(held)
                    held, size = {}, 0
                bucket = h
                mine = held.setdefault((c1, c2), [b"", 0])
                mine[1] += 1
                if context is not None and not mine[0]:
                    mine[0] = context
                    size += len(context)
        if held:
            yield ranges(held)

    dealt = contexts.select("h", "c1", "c2", "context").repartition("h").sortWithinPartitions("h")
    return in_arrow(dealt, scan, "c1 bigint, c2 bigint, a bigint, b bigint")


def _window_keys(contexts: DataFrame) -> DataFrame:
    """Each window of each context: the halves of its digest, and the context and place it has."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("context").to_pylist()
            many = np.array([len(x) - WIDTH + 1 for x in texts], np.int64)
            digests = b"".join(xxhash.xxh3_128_digest(x[a : a + WIDTH]) for x, n in zip(texts, many.tolist(), strict=True) for a in range(n))
            both = np.frombuffer(digests, np.int64).reshape(-1, 2)
            owner = batch.select(["c1", "c2"]).take(pa.array(np.repeat(np.arange(len(texts)), many)))
            at = np.arange(len(both)) - np.repeat(np.cumsum(many) - many, many)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), owner.column("c1"), owner.column("c2"), pa.array(at, pa.int64())], ["w1", "w2", "c1", "c2", "a"])

    return in_arrow(contexts.select("c1", "c2", "context"), scan, "w1 bigint, w2 bigint, c1 bigint, c2 bigint, a bigint")


def _counted_repeats(pieces: DataFrame) -> DataFrame:
    """``c1, c2, a, b`` of ``_sorted_repeats`` for crowded slices: windows are counted by digest in partial sums.

    No bucket of texts is made. Slices met more than once are covered whole.
    """
    windows = _zipped(_window_keys(pieces.where("context is not null")), "crowded-windows")
    often = windows.groupBy("w1", "w2").count().where("count >= 2").select("w1", "w2")
    again = pieces.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.max("size").cast("long").alias("b")).where("n > 1")
    once = windows.join(often, ["w1", "w2"]).select("c1", "c2", "a", (F.col("a") + WIDTH).alias("b")).distinct()
    return once.union(again.select("c1", "c2", F.lit(0).cast("long"), "b"))


def repeat_ranges(docs: DataFrame) -> DataFrame:
    """Byte ranges of ``docs`` (``text`` and key columns) that repeats cover: the keys, ``start`` and ``end``."""
    keys = [c for c in docs.columns if c != "text"]
    table = _zipped(_contexts(docs, _repeated_keys(_anchor_keys(docs))), "repeat-contexts")
    fresh = table.where("fresh")
    hot = stored(fresh.groupBy("h").count().where(F.col("count") > HOT).select("h"), "hot-keys")
    found = _sorted_repeats(fresh.join(hot, "h", "left_anti"))
    if hot.count():
        crowded = fresh.join(hot, "h", "left_semi")
        bytes_of = crowded.where("context is not null")
        pieces = _zipped(_sliced(bytes_of, _repeated_keys(_slice_keys(bytes_of))), "repeat-slices")
        cut = pieces.where("fresh")
        full = stored(cut.groupBy("h").count().where(F.col("count") > HOT).select("h"), "hot-slices")
        inner = _sorted_repeats(cut.join(full, "h", "left_anti"))
        if full.count():
            inner = inner.union(_counted_repeats(cut.join(full, "h", "left_semi")))
        placed = pieces.select("c1", "c2", "p1", "p2", "at").join(inner, ["c1", "c2"])
        again = crowded.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.max("size").alias("size")).where("n > 1")
        found = found.union(placed.select("p1", "p2", F.col("at") + F.col("a"), F.col("at") + F.col("b"))).union(
            again.select("c1", "c2", F.lit(0).cast("long"), F.col("size").cast("long"))
        )
    met = table.select("c1", "c2", "at", *keys).join(found, ["c1", "c2"])
    return met.select(*keys, (F.col("at") + F.col("a")).alias("start"), (F.col("at") + F.col("b")).alias("end"))


def _zipped(df: DataFrame, name: str) -> DataFrame:
    """A stored table whose overlapping contexts compress well."""
    return stored(df, name, compression="zstd")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte that a 200-byte string covers which starts anywhere else too.

    1. Each 200-byte window leads to the smallest hashed 32-byte gram in it;
       grams are counted over the corpus, and windows whose gram is met once
       cannot repeat.
    2. Runs of other windows become contexts; a task sends equal contexts once.
    3. Contexts meet by gram and are suffix-sorted in two stages; neighbours
       with 200 common bytes repeat. Crowded grams are dealt out again by
       slices of their windows, and windows of crowded slices are counted by
       digest, so no bucket of texts grows with a common passage.
    4. Ranges come back to their documents and are cut out.

    Returns the columns of ``docs`` but the text, and ``n_bytes``,
    ``n_removed``, ``n_spans`` and ``kept`` (binary: cuts may fall inside a
    character); input columns of these names are replaced. Null texts are
    empty. Equal rows are separate documents and so repeat each other. The
    result is exact up to 128-bit digests of contexts, and of windows in
    crowded slices.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("_t"), text.alias("text"))
    ranges = repeat_ranges(rows).groupBy(F.col("_id").alias("rid"), F.col("_t").alias("rt")).agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    replaced = [text_col, "n_bytes", "n_removed", "n_spans", "kept"]
    plain = beside(docs, replaced, id=F.col(f"`{id_col}`"), t=F.xxhash64(text), text=text)
    joined = plain.join(ranges, same(F.col("id"), F.col("rid")) & (F.col("t") == F.col("rt")), "left").select("row", "text", "ranges")
    carried = [joined.schema["row"]]
    added = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept", T.BinaryType())]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_cut(x, sorted((r["start"], r["end"]) for r in rs or ())) for x, rs in zip(_binary(batch, "text"), batch.column("ranges").to_pylist(), strict=True)]
            columns = [pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], [f.name for f in [*carried, *added]])

    return in_arrow(joined, scan, T.StructType([*carried, *added])).select(*of_row(docs, replaced), *[f.name for f in added])


def _cut(text: bytes, ranges: list[tuple[int, int]]) -> tuple[int, int, int, bytes]:
    kept, at, spans, removed = [], 0, 0, 0
    for a, b in ranges:
        if a > at or not spans:
            kept.append(text[at:a])
            spans += 1
            removed += b - a
        elif b > at:
            removed += b - at
        at = max(at, b)
    return len(text), removed, spans, b"".join([*kept, text[at:]])
