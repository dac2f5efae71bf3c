"""Hard negatives by threshold joins over blocks of rows, each with an inverted index of its leading dimensions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from debtscope.llm.shared import in_arrow, stored

#: Dimensions accumulated together, anchors looked at together.
_SLAB, _CHUNK = 8, 128
#: Scaled components are held within this, so that 100 times a score of 1,024 dimensions fits 64 bits.
LIMIT = 1 << 23
_FAR = 1 << 62
_FOUND = "n long, w int, score long, id long"


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Lists of whole numbers as rows, shorter ones padded with zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def _padded(matrix: np.ndarray, width: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1]))) if matrix.shape[1] < width else matrix


def _suffix_norms(matrix: np.ndarray, borders: list[int]) -> np.ndarray:
    """Norm of what each row has from each border on, never too small."""
    squares = matrix.astype(np.float64) ** 2
    after = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.pad(after, ((0, 0), (0, 1)))[:, borders]) * (1 + 1e-9)


class Block:
    """A block of rows that anchors are held against."""

    def __init__(self, ids: pa.Array, labels: list[str], vectors: np.ndarray):
        self.named = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        self.codes = {x: i for i, x in enumerate(dict.fromkeys(labels))}
        self.labels = np.array([self.codes[x] for x in labels], np.int64)
        energy = (vectors.astype(np.float64) ** 2).sum(axis=0)
        self.order = np.argsort(-energy, kind="stable")
        self.vectors = vectors

    def search(
        self, n: np.ndarray, ids: pa.Array, labels: list[str], vectors: np.ndarray, lo: np.ndarray, hi: np.ndarray, like: bool, most: int
    ) -> list[np.ndarray]:
        """The first ``most`` rows in each anchor's windows of scores: anchor, window, score, place of the row.

        Dimensions go in slabs, those with most weight in the block first. A
        row is listed in a slab's postings unless its norm from there on, times
        the anchors', stays below every threshold. Partial scores are summed
        over the postings; rows leave once no anchor can still take them by
        their remaining norms, and pairs that may reach the anchor's threshold
        get the dimensions that the index left out.
        """
        width = max(vectors.shape[1], self.vectors.shape[1])
        order = np.concatenate([self.order, np.arange(len(self.order), width)])
        x, y = _padded(vectors, width)[:, order], _padded(self.vectors, width)[:, order]
        small = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * width < 2**53
        x, y = (x.astype(np.float64), y.astype(np.float64)) if small else (x, y)
        borders = [*range(0, width, _SLAB), width] if width else [0]
        slabs = list(pairwise(borders))
        own, theirs = _suffix_norms(x, borders), _suffix_norms(y, borders)
        reach = lo.min(axis=1).astype(np.float64)

        # The number of leading slabs that list a row; rows with more slabs come first.
        listed = (own.max(axis=0) * theirs >= reach.min()).argmin(axis=1)
        listed[(own.max(axis=0) * theirs >= reach.min()).all(axis=1)] = len(slabs)
        rows = np.argsort(-listed, kind="stable")
        score = np.zeros((len(x), len(rows)), x.dtype)
        for s, (a, b) in enumerate(slabs):
            if 0 < s < len(slabs):
                rest = own[:, [s]] * theirs[rows, s]
                alive = ((score + rest >= reach[:, None]).any(axis=0)) | (listed[rows] < s)
                if alive.mean() < 0.75:
                    rows, score = rows[alive], score[:, alive]
            here = int((listed[rows] > s).sum())
            score[:, :here] += x[:, a:b] @ y[rows[:here], a:b].T
        at = listed[rows]
        code = np.array([self.codes.get(v, -1) for v in labels], np.int64)
        near = (code[:, None] == self.labels[rows]) == like
        for i in np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False)):
            near[i] &= ~(self.named[rows] & (self.ids[rows] == ids[i].as_py()))
        # One more unit covers the rounding of the bound.
        q, r = np.nonzero(near & (score + own[:, at] * theirs[rows, at] + 1 >= reach[:, None]))
        exact = score[q, r].astype(np.int64)
        for k in np.unique(at[r]):
            if k < len(slabs):
                mine = np.flatnonzero(at[r] == k)
                for part in np.array_split(mine, len(mine) // 65536 + 1):
                    exact[part] += np.einsum("ij,ij->i", x[q[part], borders[k] :], y[rows[r[part]], borders[k] :]).astype(np.int64)
        place = rows[r]
        order = np.lexsort((self.ids[place], ~self.named[place], -exact, q))
        q, exact, place = q[order], exact[order], place[order]
        out = []
        for w in range(lo.shape[1]):
            fits = (exact >= lo[q, w]) & (exact <= hi[q, w])
            a, b, c = q[fits], exact[fits], place[fits]
            nth = np.arange(len(a)) - np.searchsorted(a, a)
            out.append(np.stack([n[a], np.full(len(a), w), b, c])[:, nth < most])
        return out


def _search(rows: DataFrame, wanted: DataFrame, blocks: int, like: bool, most: int) -> DataFrame:
    """``n, w, score, id``: of each block the first rows in each window of each anchor.

    ``rows`` has ``b``, the number of its block; anchors are copied to every
    block. A task sees a block's rows, then its anchors, and holds one block
    and one batch of anchors at a time.
    """
    windows = "array<struct<w:int,lo:bigint,hi:bigint>>"
    left = rows.select("b", F.lit(0).alias("kind"), "n", "id", "label", "vec", F.lit(None).cast(windows).alias("windows"))
    right = wanted.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"), F.lit(1).alias("kind"), "n", "id", "label", "vec", "windows")
    met = left.unionByName(right).repartition(min(blocks, 10_000), "b").sortWithinPartitions("b", "kind")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        block, number = None, None
        for batch in filter(len, batches):
            key = batch.column("b").to_numpy() * 2 + batch.column("kind").to_numpy()
            for a, z in pairwise([0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]):
                part, b = batch.slice(a, z - a), int(key[a]) // 2
                if b != number:
                    held, block, number = [], None, b
                if key[a] % 2 == 0:
                    held.append(part)
                    continue
                if block is None and held:
                    whole = pa.Table.from_batches(held)
                    block = Block(whole.column("id").combine_chunks(), whole.column("label").to_pylist(), _matrix(whole.column("vec")))
                    held = []
                if block is None:
                    continue
                for at in range(0, part.num_rows, _CHUNK):
                    yield from _found(block, part.slice(at, _CHUNK))

    def _found(block: Block, asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        given = asked.column("windows").to_pylist()
        most_windows = max(map(len, given))
        lo, hi = (np.array([[w[k] for w in ws] + [fill] * (most_windows - len(ws)) for ws in given], np.int64) for k, fill in (("lo", _FAR), ("hi", -_FAR)))
        name = np.array([[w["w"] for w in ws] + [-1] * (most_windows - len(ws)) for ws in given], np.int32)
        place = np.arange(asked.num_rows)
        parts = block.search(place, asked.column("id"), asked.column("label").to_pylist(), _matrix(asked.column("vec")), lo, hi, like, most)
        i, w, score, at = np.concatenate(parts, axis=1)
        if len(i):
            ids = pa.array(block.ids[at], pa.int64(), mask=~block.named[at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(asked.column("n").to_numpy()[i]), pa.array(name[i, w]), pa.array(score), ids], ["n", "w", "score", "id"]
            )

    return in_arrow(met, scan, _FOUND)


def _first(found: DataFrame, most: int) -> DataFrame:
    along = W.partitionBy("n", "w").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(along)).where(F.col("rank") <= most)


def _filled(rows: DataFrame, anchors: DataFrame, asked: DataFrame, blocks: int, like: bool, most: int, start: Column) -> DataFrame:
    """``n, w, rank, score, id``: the first ``most`` rows in each window ``lo`` to ``hi`` of ``asked``.

    One block is searched first. What it holds sets the thresholds of each
    window: ``start``, the best and the last row found there, ``lo``. All
    blocks are searched above the first threshold; windows that do not fill go
    on with the next lower one.
    """

    def search(where: DataFrame, todo: DataFrame, over: int) -> DataFrame:
        windows = todo.groupBy("n").agg(F.sort_array(F.collect_list(F.struct("w", "lo", "hi"))).alias("windows"))
        return stored(_first(_search(where, anchors.join(windows, "n"), over, like, most), most), "negatives-found")

    sample = search(rows.where(F.col("b") == 0), asked, 1)
    if blocks == 1:
        return sample
    probe = sample.groupBy("n", "w").agg(F.max("score").alias("best"), F.min("score").alias("last"), F.count("*").alias("c"))
    base = F.col("lo")
    levels = F.array(F.greatest(base, start.cast("long"), F.col("best")), F.greatest(base, F.col("best")), F.when(F.col("c") >= most, F.col("last")).otherwise(base), base)
    ahead = asked.join(probe, ["n", "w"], "left")
    todo = stored(ahead.select("n", "w", "lo", "hi", F.when(F.col("c").isNull(), F.array(base, base, base, base)).otherwise(levels).alias("levels")), "negatives-asked")
    done = []
    for k in range(4):
        found = search(rows, todo.withColumn("lo", F.col("levels")[k]), blocks)
        counts = found.groupBy("n", "w").agg(F.count("*").alias("c"))
        seen = todo.join(counts, ["n", "w"], "left").withColumn("full", (F.coalesce("c", F.lit(0)) >= most) | (F.col("levels")[k] <= F.col("lo")))
        done.append(found.join(seen.where("full"), ["n", "w"], "left_semi"))
        todo = stored(seen.where("not full").select("n", "w", "lo", "hi", "levels"), "negatives-asked")
        if k == 3 or todo.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def mine_hard_negatives(
    rows: DataFrame,
    anchor: Column | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    low_percent: int = 80,
    high_percent: int = 100,
    block_rows: int = 8192,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become whole numbers, floor(scale * x), held within ``LIMIT``;
    scores are their exact inner products, a shorter vector counting as
    padded with zeros. Anchors are the rows that ``anchor`` holds for (by
    default all). Their positives are the ``positives`` best other rows of
    their label; for each positive the ``negatives`` best rows of other labels
    follow whose score is from ``low_percent`` to ``high_percent`` of its own.
    Higher scores come first, ties by smaller id, rows without an id last.

    Rows with a null label, vector or component or one that is not finite take
    no part. Rows that share an id are partners of others each on its own and
    never of each other; an anchor that occurs twice has its results twice. A
    null id is no anchor's own id. An empty table gives no rows; extra columns
    are not read.

    Rows are dealt to blocks of about ``block_rows`` by number, whatever they
    hold, so copies of a vector spread. What leaves a block is bounded by the
    anchors, and thresholds keep most of it back.
    """
    vector, label = F.col(f"`{vector_col}`"), F.col(f"`{label_col}`")
    real = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    units = F.transform(vector, lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int"))
    given = rows.where(label.isNotNull() & vector.isNotNull() & real).select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        label.cast("string").alias("label"),
        units.alias("vec"),
        (F.lit(True) if anchor is None else F.coalesce(anchor, F.lit(False))).alias("leads"),
        F.monotonically_increasing_id().alias("n"),
    )
    held = stored(given, "negatives-rows")
    blocks = max(1, -(-held.count() // block_rows))
    numbered = held.withColumn("b", F.pmod(F.xxhash64("n"), F.lit(blocks)))
    anchors = stored(held.where("leads").select("n", "id", "label", "vec"), "negatives-anchors")

    # Best scores fall off like an exponential tail: blocks times more rows lift them by its logarithm.
    lift = F.lit(float(max(0.0, np.log(blocks / 10) / np.log(max(positives, 2)))))
    every = anchors.select("n", F.lit(0).alias("w"), F.lit(-_FAR).alias("lo"), F.lit(_FAR).alias("hi"))
    above = F.when(F.col("c") >= positives, F.col("best") + (F.col("best") - F.col("last")) * lift)
    likes = stored(_filled(numbered, anchors, every, blocks, True, positives, above).select("n", F.col("rank").alias("w"), "score", "id"), "positives")

    low = F.expr(f"-((-score * {low_percent} - pmod(-score * {low_percent}, 100L)) div 100)")
    high = F.expr(f"(score * {high_percent} - pmod(score * {high_percent}, 100L)) div 100")
    bands = likes.select("n", "w", low.alias("lo"), high.alias("hi")).where("lo <= hi")
    # Scores lie evenly right below a window's upper end.
    close = F.col("hi") - (F.col("hi") - F.col("best")) * F.lit(min(1.0, 10 / blocks))
    others = _filled(numbered, anchors, bands, blocks, False, negatives, close).select(
        "n", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    named = likes.select("n", "w", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    whose = anchors.select("n", F.col("id").alias("anchor_id"))
    return (
        others.join(named, ["n", "w"])
        .join(whose, "n")
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    )
