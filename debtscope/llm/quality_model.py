"""Quality scores from random-indexing word vectors and a small calibrated network."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from debtscope.llm.shared import in_arrow, with_columns

#: Word forms share so many rows; the last SHAPES rows are for forms that are no plain words, the very last for repeats.
ROWS, SHAPES, WIDTH = 1 << 13, 1 << 10, 64
#: Places that a row's index vector sets, half to 1 and half to -1.
_MARKS = 4
_SLICES = 32
#: Partial sums of so many tasks at most meet in a first round.
_SALTS = 256
_WORDS = 1_000_000
_MEMORY = 400_000
_SHAPE = (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[a-zß-öø-ÿ]+"), "a"), (re.compile(r"[0-9]+"), "0"), (re.compile(r"([^Aa0])\1+"), r"\1\1")


def _row_of(word: str) -> int:
    """Row of a word form: plain words by their letters, all others by their shape."""
    if word.isalpha() and (word.islower() or word.istitle()):
        return zlib.crc32(word.lower().encode()) % (ROWS - SHAPES)
    for pattern, mark in _SHAPE:
        word = pattern.sub(mark, word)
    return ROWS - SHAPES + zlib.crc32(word.encode()) % (SHAPES - 1)


_KNOWN: dict[str, int] = {}


def form_rows(words: list[str]) -> np.ndarray:
    """Rows of a text's words; a word equal to the one before it is a repeat."""
    if len(_KNOWN) > _MEMORY:
        _KNOWN.clear()
    out = np.empty(len(words), np.int64)
    for i, w in enumerate(words):
        r = _KNOWN.get(w)
        if r is None:
            r = _KNOWN[w] = _row_of(w)
        out[i] = r
    again = np.flatnonzero(out[1:] == out[:-1]) + 1
    plain = again[out[again] < ROWS - SHAPES]
    out[plain] = ROWS - 1
    return out


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each row's sparse index vector, from a fixed seed."""
    rng = np.random.default_rng(20)
    places = np.array([rng.choice(WIDTH, _MARKS, replace=False) for _ in range(ROWS)])
    signs = np.tile([1, -1], _MARKS // 2)
    return places, signs


def _parts(batch: pa.RecordBatch, text_col: str) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Texts of a batch, their rows in a line and their sizes, about ``_WORDS`` words at a time."""
    which: list[int] = []
    rows: list[np.ndarray] = []
    held = 0
    for i, text in enumerate(batch.column(text_col)):
        found = form_rows((text.as_py() or "").split())
        which.append(i)
        rows.append(found)
        held += len(found)
        if held >= _WORDS:
            yield which, np.concatenate(rows), np.array([len(r) for r in rows])
            which, rows, held = [], [], 0
    if which:
        yield which, np.concatenate(rows), np.array([len(r) for r in rows])


def word_contexts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Sum of the index vectors of the neighbours of every word form, over all documents.

    Tasks add up whole numbers and send compressed slices, which are summed in
    two rounds of bounded groups; the driver gets ROWS x WIDTH numbers.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        sums, seen = np.zeros(ROWS * WIDTH, np.int64), 0
        for batch in batches:
            for _, rows, sizes in _parts(batch, "text"):
                inside = np.ones(max(len(rows) - 1, 0), bool)
                ends = np.cumsum(sizes)
                inside[ends[(ends > 0) & (ends < len(rows))] - 1] = False
                left, right = rows[:-1][inside], rows[1:][inside]
                for a, b in ((left, right), (right, left)):
                    for k, sign in enumerate(signs):
                        sums += sign * np.bincount(a * WIDTH + places[b, k], minlength=len(sums))
                seen += len(rows)
        if seen:
            yield _packed(sums.reshape(_SLICES, -1), range(_SLICES), [zlib.crc32(sums.tobytes()) % _SALTS] * _SLICES)

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in table.column("sums").to_pylist())
        return pa.Table.from_batches([_packed(total[None, :], [table.column("slice")[0].as_py()], [0])])

    schema = "slice int, salt int, sums binary"
    first = in_arrow(docs.select(F.col(f"`{text_col}`").alias("text")), scan, schema)
    whole = first.groupBy("slice", "salt").applyInArrow(added, schema).groupBy("slice").applyInArrow(added, schema)
    out = np.zeros((_SLICES, ROWS * WIDTH // _SLICES))
    for r in whole.collect():
        out[r["slice"]] = np.frombuffer(zlib.decompress(r["sums"]), np.int64)
    return out.reshape(ROWS, WIDTH)


def _packed(sums: np.ndarray, slices, salts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(slices, pa.int32()), pa.array(salts, pa.int32()), pa.array([zlib.compress(np.ascontiguousarray(s).tobytes(), 1) for s in sums], pa.binary())],
        ["slice", "salt", "sums"],
    )


def word_vectors(contexts: np.ndarray) -> np.ndarray:
    """Unit context vector plus unit index vector of each row."""
    places, signs = index_vectors()
    own = np.zeros((ROWS, WIDTH))
    np.put_along_axis(own, places, np.broadcast_to(signs / np.sqrt(_MARKS), places.shape).copy(), axis=1)
    size = np.linalg.norm(contexts, axis=1, keepdims=True)
    return (own + contexts / np.maximum(size, 1)).astype(np.float32)


def pooled(vectors: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Mean vector of each text; zeros for a text without words."""
    out = np.zeros((len(sizes), WIDTH), np.float32)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        out[full] = np.add.reduceat(vectors[rows], starts, axis=0) / sizes[full, None]
    return out


class QualityNet:
    """Two layers on pooled vectors; probabilities are calibrated by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 24, steps: int = 1500, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.constant = None if 0 < y.sum() < len(y) else (float(y.mean()) if len(y) else 0.5)
        if self.constant is not None:
            return
        aside = rng.random(len(y)) < 0.2
        if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
            aside[:] = False
        fit = ~aside
        self.mean, self.size = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
        a, t = (x[fit] - self.mean) / self.size, y[fit]
        self.p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        first, second = ([np.zeros_like(p) for p in self.p] for _ in range(2))
        for k in range(1, steps + 1):
            pick = rng.integers(0, len(t), min(512, len(t)))
            b, u = a[pick], t[pick]
            h = np.tanh(b @ self.p[0] + self.p[1])
            err = (1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3], -30, 30))) - u) / len(u)
            back = np.outer(err, self.p[2]) * (1 - h * h)
            grads = [b.T @ back + 1e-4 * self.p[0], back.sum(axis=0), h.T @ err + 1e-4 * self.p[2], err.sum(keepdims=True)]
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                self.p[i] = self.p[i] - 0.005 * (first[i] / (1 - 0.9**k)) / (np.sqrt(second[i] / (1 - 0.999**k)) + 1e-8)
        self.temperature = 1.0
        held = aside if aside.any() else fit
        logits = self.logits(x[held])
        grid = np.exp(np.linspace(np.log(0.3), np.log(8), 200))
        losses = [np.mean(np.logaddexp(0, logits / g) - y[held] * logits / g) for g in grid]
        self.temperature = float(grid[int(np.argmin(losses))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.size @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _with_vectors(docs: DataFrame, vectors, text_col: str, net: QualityNet | None) -> DataFrame:
    """Columns but the text, and the pooled vector, or the score where a net is given."""
    sc = docs.sparkSession.sparkContext
    known = sc.broadcast((vectors, net))
    plain = with_columns(docs, [], drop=["_vector" if net is None else "score"])
    carried = [f for f in plain.schema if f.name != text_col]
    added = T.StructField("_vector", T.ArrayType(T.FloatType())) if net is None else T.StructField("score", T.DoubleType())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, scorer = known.value
        for batch in batches:
            found = np.zeros((batch.num_rows, WIDTH), np.float32)
            for which, rows, sizes in _parts(batch, text_col):
                found[which] = pooled(table, rows, sizes)
            last = pa.array(list(found), pa.list_(pa.float32())) if scorer is None else pa.array(scorer.scores(found.astype(np.float64)))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in carried], last], [f.name for f in [*carried, added]])

    return in_arrow(plain, scan, T.StructType([*carried, added]))


def learn_quality(
    docs: DataFrame, labels: DataFrame, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000
) -> QualityNet:
    """Fit the network on at most ``sample`` labelled rows, chosen by a hash of their id.

    ``labels`` has the id and ``quality`` (0 or 1). The bound makes the sample
    safe to broadcast and its vectors safe to gather.
    """
    chosen = (
        labels.where("quality is not null")
        .groupBy(F.col(f"`{id_col}`").alias("_id"))
        .agg(F.max("quality").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample)
    )
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), "_id")
    found = _with_vectors(rows, vectors, "text", None).toArrow().sort_by("_id")
    x = np.array(found.column("_vector").to_pylist(), np.float64).reshape(-1, WIDTH)
    return QualityNet(x, found.column("_label").to_numpy().astype(np.float64))


def score_quality(docs: DataFrame, vectors: np.ndarray, net: QualityNet, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ``score``: the chance of label 1. Whole texts are read; empty ones have the zero vector."""
    return _with_vectors(docs, vectors, text_col, net)
