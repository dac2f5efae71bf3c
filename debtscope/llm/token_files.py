"""Token ids of a corpus as compressed binary segments."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from debtscope.llm import rans
from debtscope.llm.shared import in_arrow, text_of

SEGMENT_IDS = 1 << 21
#: Text bytes tokenized together, and words that a worker remembers before it forgets all.
_TEXT, _MEMORY = 8 << 20, 1_000_000
#: A lower-case Latin word and closing marks: normalising leaves it alone, and the marks are a piece of their own.
_PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([.,!?:;|#%$&*]*)")


class WordIds:
    """Ids of texts by way of their distinct words.

    The tokenizer's pieces never reach across a blank or a line break, so a
    text's ids are those of its blank-separated words in order; each distinct
    word goes to the tokenizer once. Plain words go straight to its model in
    the form its byte-level step gives them, any other word through all steps.
    A tokenizer for which that does not hold gets whole texts.
    """

    def __init__(self, config: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_str(config)
        step = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {c: step.pre_tokenize_str(chr(c))[0][0] for c in [*range(0xDF, 0xF7), *range(0xF8, 0x100)]}
        self.by_word = self._drops_blanks()
        self._forget()
        self.marks: dict[str, array] = {}

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.cores: dict[str, array] = {}
        self.ids = array("I")
        self.ends = array("q", [0])

    def _drops_blanks(self) -> bool:
        """Whether blanks only part words and case plays no part, as the way by words needs."""

        def ids(text: str) -> list[int]:
            return self.full.encode(text, add_special_tokens=False).ids

        probes = ("Ab c", "ab\nc", " ab  c\n", "ab,\n.c", "été çà, x1 .")
        return all(ids(p) == [i for w in p.lower().split() for i in ids(w)] for p in probes)

    def _of(self, word: str) -> Sequence[int]:
        m = _PLAIN.fullmatch(word.lower())
        if not m:
            return self.full.encode(word, add_special_tokens=False).ids
        core, mark = m.groups()
        ids = self.cores.get(core)
        if ids is None:
            tokens = self.full.model.tokenize(core if core.isascii() else core.translate(self.bytes))
            ids = self.cores[core] = array("I", [t.id for t in tokens])
        if not mark:
            return ids
        if mark not in self.marks:
            self.marks[mark] = array("I", self.full.encode(mark, add_special_tokens=False).ids)
        return ids + self.marks[mark]

    def _codes(self, words: list[str]) -> np.ndarray:
        if len(self.known) + len(words) > _MEMORY:
            self._forget()
        known, ids, ends = self.known, self.ids, self.ends
        for w in words:
            if w not in known:
                known[w] = len(ends) - 1
                ids.extend(self._of(w))
                ends.append(len(ids))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, ``end_id`` after each text, and the number of ids of each text."""
        if not self.by_word:
            found = [[*e.ids, end_id] for e in self.full.encode_batch(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(found), np.uint32), np.array([len(x) for x in found], np.int64)
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        words = self._codes(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        ends, known = np.array(self.ends, np.int64), np.array(self.ids, np.uint32)
        counts = (ends[1:] - ends[:-1])[words] if len(words) else words
        bounds = split.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        total = np.concatenate([[0], np.cumsum(counts)])
        sizes = np.diff(total[bounds]) + 1
        where = np.cumsum(sizes)
        out = np.empty(int(where[-1]) if len(where) else 0, np.uint32)
        ending = np.zeros(len(out), bool)
        ending[where - 1] = True
        out[ending] = end_id
        source = np.arange(int(total[-1])) + np.repeat(ends[words] - total[:-1], counts)
        out[~ending] = known[source]
        return out, sizes


_LOADED: dict[int, WordIds] = {}


def _word_ids(config: str) -> WordIds:
    """One per worker process, kept between tasks."""
    key = zlib.crc32(config.encode())
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordIds(config)
    return _LOADED[key]


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of about ``_TEXT`` bytes, one text at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        done = int(sizes[start - 1]) if start else 0
        end = max(int(np.searchsorted(sizes, done + _TEXT, "right")), start + 1)
        yield texts.slice(start, end - start)
        start = end


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = SEGMENT_IDS
) -> None:
    """Encode all texts and write the segments in ascending order of ids.

    ``tokenizer`` is the content of a tokenizer file. Documents are dealt out
    by ranges of their id and put in order; a task tokenizes its range piece by
    piece and closes a segment after about ``segment_ids`` ids, never inside a
    document. A segment is a row: ``part`` and ``segment`` (its place),
    ``doc_ids``, ``doc_sizes``, ``n_ids`` and ``payload``, the bytes that
    ``rans.encode`` makes. Spark's writer commits the files, so a lost executor
    leaves none behind.

    Null texts are empty: only the end id. Null ids come first; rows with equal
    ids stay apart, ordered by text. An empty table writes no segment.
    """
    config = docs.sparkSession.sparkContext.broadcast(tokenizer)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    names = ["part", "segment", "doc_ids", "doc_sizes", "n_ids", "payload"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, number = _word_ids(config.value), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        names_of: list[pa.Array] = []
        sizes: list[np.ndarray] = []

        def closed() -> pa.RecordBatch:
            joined, lengths = np.concatenate(ids), np.concatenate(sizes)
            columns = [
                pa.array([part], pa.int32()),
                pa.array([number], pa.int32()),
                pa.array([pa.chunked_array(names_of).to_pylist()], pa.list_(pa.int64())),
                pa.array([lengths], pa.list_(pa.int32())),
                pa.array([len(joined)], pa.int64()),
                pa.array([rans.encode(joined)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            keys, at = batch.column("doc_id"), 0
            for piece in _pieces(batch.column("text")):
                found, lengths = coder.encode(piece, end_id)
                ids.append(found)
                sizes.append(lengths)
                names_of.append(keys.slice(at, len(piece)))
                at += len(piece)
                if sum(map(len, ids)) >= segment_ids:
                    yield closed()
                    number += 1
                    ids, names_of, sizes = [], [], []
        if ids:
            yield closed()

    schema = "part int, segment int, doc_ids array<bigint>, doc_sizes array<int>, n_ids bigint, payload binary"
    in_arrow(dealt, scan, schema).write.option("compression", "uncompressed").parquet(path)


def _starts(spark: SparkSession, path: str) -> DataFrame:
    """Ids before each segment: parts are summed first, then the segments inside each."""
    sizes = spark.read.parquet(path).select("part", "segment", "n_ids")
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_n")).select(F.col("part").alias("_p"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = W.partitionBy("part").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    return sizes.join(parts, F.col("part") == F.col("_p")).select(
        "part", "segment", (F.col("_before") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("base")
    )


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents read back from the files: ``doc_id, start, n_tokens, ids_crc32`` and, if wanted, ``ids``.

    Segments decode in parallel, each block from its own checkpoint, and a
    block whose checksum differs fails the read.
    """
    schema = "part int, segment int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = rans.decode(row.column("payload")[0].as_py()).astype("<u4")
                keys, sizes = row.column("doc_ids").flatten(), row.column("doc_sizes").flatten().to_numpy().astype(np.int64)
                ends = np.cumsum(sizes)
                starts = ends - sizes
                n = len(sizes)
                columns = [
                    pa.array(np.full(n, row.column("part")[0].as_py()), pa.int32()),
                    pa.array(np.full(n, row.column("segment")[0].as_py()), pa.int32()),
                    keys,
                    pa.array(starts),
                    pa.array(sizes),
                    pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, ["part", "segment", "doc_id", "inside", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    found = in_arrow(spark.read.parquet(path).select("part", "segment", "doc_ids", "doc_sizes", "payload"), scan, schema)
    placed = found.join(_starts(spark, path), ["part", "segment"])
    columns = ["n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    return placed.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), *columns)
