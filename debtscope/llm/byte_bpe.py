"""Byte-level BPE: overlapping chunks of texts, stitched where their pre-token boundaries meet, and back to bytes."""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from debtscope.llm.shared import in_arrow, stored, text_of

#: Code points that a chunk has of its own, and that it shares with the next.
CHUNK, OVERLAP = 1 << 16, 1 << 10
#: Ids sent together, runs of text that a worker remembers before it forgets all, and the longest of them.
_IDS, _MEMORY, _LONG = 1 << 20, 300_000, 64
#: Code points behind the start of a pre-token that may decide where it ends, and what always ends one:
#: a letter or digit before anything else, and whatever stands before white space.
_AHEAD = 3
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SURE = r"\p{L}(?=\P{L})|\p{N}(?=\P{N})|\P{White_Space}(?=\p{White_Space})"


class _Known(dict):
    """Ids, as the bytes of 32-bit numbers, of runs of text that end where white space starts; each distinct run is encoded once."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, run: str) -> bytes:
        ids = self.encode(run)
        if len(run) <= _LONG:
            if len(self) >= _MEMORY:
                self.clear()
            self[run] = ids
        return ids


class ByteBpe:
    """Encoder and decoder of one rank file and one pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
        # White space is what Unicode calls so, as in the pattern's own dialect.
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.sure = regex.compile(_SURE)
        self.runs = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
        self.merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})._encode_single_piece
        self.known = _Known(lambda run: array("i", chain.from_iterable(map(self.merge, self.pattern.findall(run)))).tobytes())
        tokens = {rank: token for token, rank in table.items()}
        self.bytes = [tokens.get(i) for i in range(max(tokens, default=-1) + 1)]

    def encode(self, text: str, begin: int = 0, end: int | None = None) -> bytes:
        """Ids of the pre-tokens that start from ``begin``, a boundary, to before ``end``, as the bytes of 32-bit numbers.

        No pre-token reaches from anything else into white space, so runs of
        white space and what follows it are pre-tokenised each on its own.
        """
        if end is None:
            return b"".join(map(self.known.__getitem__, self.runs.findall(text, begin)))
        pieces = []
        for m in self.pattern.finditer(text, begin):
            if m.start() >= end:
                break
            pieces.append(m.group())
        return b"".join(map(self.known.__getitem__, pieces))

    def decode(self, ids: Sequence[int]) -> bytes:
        """Bytes of ids; one outside of the vocabulary is an error."""
        if ids and not (0 <= min(ids) and max(ids) < len(self.bytes)):
            raise ValueError("an id outside of the vocabulary")
        return b"".join(map(self.bytes.__getitem__, ids))

    def seams(self, text: str, own: int, first: bool, last: bool) -> tuple[list[int], list[int]]:
        """Boundaries of a chunk that may be shared with the one before and with the one after.

        Those for the chunk before are taken as they come, from the chunk's
        start. Those for the chunk after lie behind its start at ``own``, behind
        a place that ends a pre-token whatever stands before the chunk, and
        before anything that text beyond the chunk could change.
        """
        bounds, at = [], 0
        for m in self.pattern.finditer(text):
            bounds.append(m.start())
            at = m.end()
            if not last and (at >= len(text) or m.start() + _AHEAD > len(text)):
                break
        else:
            bounds.append(at)
        sure = 0 if first else m.end() if (m := self.sure.search(text)) else len(text) + 1
        return ([] if first else [b for b in bounds if b <= len(text) - own or last]), [b for b in bounds if b >= max(own, sure)]


@lru_cache(maxsize=2)
def _codec(ranks: bytes, pattern: str) -> ByteBpe:
    return ByteBpe(ranks, pattern)


def _lists(parts: Iterator[bytes]) -> Iterator[tuple[int, pa.Array]]:
    """Number of parts and their ids as an array of lists, some million ids at a time."""
    ids, ends = [], [0]
    for part in parts:
        ids.append(part)
        ends.append(ends[-1] + len(part) // 4)
        if ends[-1] >= _IDS:
            yield len(ids), _list(ids, ends)
            ids, ends = [], [0]
    yield len(ids), _list(ids, ends)


def _list(ids: list[bytes], ends: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))


_ID_LISTS = T.ArrayType(T.IntegerType())


def _encoded(pieces: DataFrame, known) -> DataFrame:
    """Columns of ``pieces`` but ``text``, ``begin`` and ``end``, and the ids of each piece."""
    carried = [f for f in pieces.schema if f.name not in ("text", "begin", "end")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*known.value)
        for batch in batches:
            texts, begins, ends = (batch.column(c) for c in ("text", "begin", "end"))
            parts = (codec.encode(t.as_py(), b, e) for t, b, e in zip(texts, begins.to_pylist(), ends.to_pylist(), strict=True))
            at = 0
            for n, ids in _lists(parts):
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name).slice(at, n) for f in carried], ids], [*[f.name for f in carried], "ids"])
                at += n

    return in_arrow(pieces, scan, T.StructType([*carried, T.StructField("ids", _ID_LISTS)]))


def encode_texts(
    docs: DataFrame, ranks: bytes, pattern: str, text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``docs`` without the text, with ``ids``, the ids of each whole text.

    ``ranks`` is the content of a rank file, ``pattern`` what splits texts
    before the merges: words, numbers, marks or white space, as in public
    byte-level vocabularies, none of which reaches from a letter or digit into
    anything else or into white space, and which look ahead by two code points
    at most.

    Texts longer than ``chunk + overlap`` code points are cut into chunks that
    share ``overlap`` with the next one and are pre-tokenised in parallel. Two
    neighbours are stitched at the first boundary that both have; from there on
    both agree. Chunks that share none, as inside of a very long word, become
    one piece. Pieces are encoded each on its own and their ids put together.
    Only chunks and ids of long texts are shuffled.

    A null or empty text has no ids. Every row counts, repeats too; an empty
    table gives no rows. An input column ``ids`` is replaced.
    """
    if not 0 < overlap <= chunk:
        raise ValueError("a chunk must be longer than what it shares")
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast((ranks, pattern))
    names = [c for c in docs.columns if c not in (text_col, "ids")]
    row = F.struct(*[F.col(f"`{c}`") for c in names] or [F.lit(0).alias("none")])
    given = docs.select(row.alias("row"), text_of(text_col).alias("text"))
    whole, cut = F.lit(0).alias("begin"), F.lit(None).cast("int").alias("end")
    long = F.length("text") > chunk + overlap
    short = _encoded(given.where(~long).select("row", "text", whole, cut), known)

    held = stored(given.where(long).withColumn("n", F.monotonically_increasing_id()), "bpe-long")
    number = F.sequence(F.lit(0), F.ceil((F.length("text") - overlap) / chunk).cast("int") - 1)
    parts = F.transform(number, lambda i: F.substring(F.col("text"), i * chunk + 1, F.lit(chunk + overlap)))
    chunks = stored(
        held.select("n", F.size(parts).alias("of"), F.posexplode(parts).alias("i", "text")).repartition("n", "i"), "bpe-chunks"
    )
    pieces = _stitched(chunks, _seams(chunks, known, chunk), chunk)
    ids = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("run", "ids"))), lambda x: x["ids"]))
    joined = _encoded(pieces, known).groupBy("n").agg(ids.alias("ids"))
    return short.unionByName(held.select("n", "row").join(joined, "n").select("row", "ids")).select(*[F.col(f"row.`{c}`") for c in names], "ids")


def _seams(chunks: DataFrame, known, own: int) -> DataFrame:
    """``n, i, head, tail``: places in the whole text of boundaries near both ends of each chunk."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*known.value)
        for batch in batches:
            heads, tails = [], []
            for i, of, text in zip(batch.column("i").to_pylist(), batch.column("of").to_pylist(), batch.column("text")):
                head, tail = codec.seams(text.as_py(), own, i == 0, i == of - 1)
                heads.append([i * own + b for b in head])
                tails.append([i * own + b for b in tail])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("n"), batch.column("i"), pa.array(heads, kind), pa.array(tails, kind)], ["n", "i", "head", "tail"])

    return in_arrow(chunks.select("n", "i", "of", "text"), scan, "n long, i int, head array<int>, tail array<int>")


def _stitched(chunks: DataFrame, seams: DataFrame, own: int) -> DataFrame:
    """``n, run, text, begin, end``: chunks cut at their seams; chunks without a seam between them become one piece."""
    along = W.partitionBy("n").orderBy("i")
    shared = F.array_min(F.array_intersect("head", F.lag("tail").over(along)))
    met = seams.select("n", "i", F.when(F.col("i") == 0, 0).otherwise(shared).alias("at"))
    runs = met.withColumn("run", F.count("at").over(along.rowsBetween(W.unboundedPreceding, 0)))
    spans = (
        runs.groupBy("n", "run")
        .agg(F.min("i").alias("first"), F.max("i").alias("last"), F.max("at").alias("at"))
        .withColumn("stop", F.lead("at").over(W.partitionBy("n").orderBy("run")))
    )
    placed = runs.select("n", "i", "run").join(spans, ["n", "run"])
    texts = chunks.select("n", "i", "text").join(placed, ["n", "i"])
    mine = F.when(F.col("i") == F.col("last"), F.col("text")).otherwise(F.substring("text", 1, own))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("i"), mine.alias("text")))), lambda x: x["text"]), "")
    base = F.col("first") * own
    return texts.groupBy("n", "run", "first", "at", "stop").agg(whole.alias("text")).select(
        "n", "run", "text", (F.col("at") - base).cast("int").alias("begin"), (F.col("stop") - base).cast("int").alias("end")
    )


def decode_ids(docs: DataFrame, ranks: bytes, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``decoded``, the raw bytes of its ids put together; bytes need not be a valid text.

    Null ids and null lists have no bytes; an id outside of the vocabulary is an
    error. An input column ``decoded`` is replaced.
    """
    known = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    plain = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "decoded"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*known.value)
        for batch in batches:
            step = max(1, batch.num_rows * _IDS // max(len(batch.column(ids_col).flatten()), 1))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lists = part.column(ids_col)
                ids, ends = lists.flatten().to_pylist() if lists.flatten().null_count else lists.flatten().to_numpy().tolist(), [0]
                ends += pc.fill_null(pc.list_value_length(lists), 0).to_numpy().cumsum().tolist()
                parts = (ids[a:z] for a, z in pairwise(ends))
                texts = [codec.decode([i for i in x if i is not None] if lists.flatten().null_count else x) for x in parts]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], [*part.schema.names, "decoded"])

    return in_arrow(plain, scan, T.StructType([*plain.schema, T.StructField("decoded", T.BinaryType())]))
