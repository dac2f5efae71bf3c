import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from debtscope.llm.hard_negatives import LIMIT, Block, mine_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, n int, b string, levels string"


def brute(rows, scale=256, most=5):
    """Rows (id, vector, label) against all others, by sorting."""
    ok = [(i, [max(-LIMIT, min(LIMIT, math.floor(float(np.float32(x)) * scale))) for x in v], k) for i, v, k in rows if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, k in ok:
        if i is None or i % 100:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, j, m) for j, w, m in ok if j != i), key=lambda t: t[:3])
        for p in [s for s in scored if s[4] == k][:most]:
            fits = [s for s in scored if s[4] != k and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]][:most]
            out += [(i, p[3], r, s[3], -p[0], -s[0]) for r, s in enumerate(fits, 1)]
    return sorted(out, key=str)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "b", "l") for r in rows], SCHEMA).repartition(3)
    got = mine_hard_negatives(df, F.col("vec_id") % 100 == 0, **options)
    return sorted(map(tuple, got.collect()), key=str)


def cloud(n, dims, labels, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(labels, dims))
    rows = []
    for i in range(n):
        k = int(rng.integers(labels))
        v = middle[k] * 0.5 + rng.normal(size=dims)
        rows.append((i * 10, (v / np.linalg.norm(v)).astype(np.float32).tolist(), k))
    return rows


@pytest.mark.parametrize("block_rows", [7, 40, 1000])
def test_against_all_pairs(spark, block_rows):
    rows = cloud(160, 20, 4, 1)
    assert mined(spark, rows, block_rows=block_rows) == brute(rows)


def test_many_copies_of_a_vector(spark):
    rows = cloud(60, 9, 3, 2)
    rows += [(5000 + i, rows[0][1], i % 3) for i in range(90)]
    assert mined(spark, rows, block_rows=16) == brute(rows)


def test_nulls_ties_and_odd_vectors(spark):
    one = [0.5, 0.5]
    rows = [
        (0, one, 1), (100, one, 1), (100, one, 1), (101, one, 2), (102, one, 2), (None, one, 2), (None, one, 1), (103, one, None),
        (104, None, 1), (105, [0.5, None], 2), (106, [0.5, float("nan")], 2), (107, [float("inf"), 0.1], 2), (108, [0.5], 2),
        (109, [0.5, 0.5, 3.0], 2), (110, [], 2), (200, [], 3), (300, [-0.5, -0.5], 4), (301, [0.4, 0.4], 4), (302, [3e38, -3e38], 2), (400, [3e38, 1.0], 2),
    ]
    assert mined(spark, rows, block_rows=4) == brute(rows)
    assert mined(spark, []) == []


def test_labels_of_few_rows(spark):
    rows = [(i * 50, [math.cos(i), math.sin(i)], i // 2) for i in range(12)]
    assert mined(spark, rows, block_rows=3) == brute(rows)


def test_index_leaves_out_what_norms_cover():
    """Thresholds near the best score leave trailing dimensions and whole rows out, results stay."""
    rng = np.random.default_rng(3)
    y = np.floor(rng.normal(size=(500, 64)) * 100 * (0.8 ** np.arange(64))).astype(np.int64)
    x = np.floor(rng.normal(size=(9, 64)) * 100 * (0.8 ** np.arange(64))).astype(np.int64)
    score = x @ y.T
    lo = np.sort(score, axis=1)[:, [-3]]
    block = Block(pa.array(range(500)), ["a"] * 500, y)
    [found] = block.search(np.arange(9), pa.array(range(1000, 1009)), ["b"] * 9, x, lo, np.full((9, 1), 1 << 62), False, 3)
    assert sorted(zip(found[0], found[3])) == sorted((i, j) for i in range(9) for j in np.argsort(-score[i], kind="stable")[:3])
