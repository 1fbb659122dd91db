import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm.hard_negatives import Block, Pivots, choose_pivots, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, anchor, positives=5, negatives=5, percent=80):
    """rows: (id, vector, label), by plain loops."""
    usable = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (ai, av, ay) in enumerate(usable):
        if not anchor(ai):
            continue
        scored = [(sum(x * y for x, y in zip(av, v)), i, y) for b, (i, v, y) in enumerate(usable) if b != a]
        order = sorted(scored, key=lambda r: (-r[0], r[1]))
        for ps, pi, _ in [r for r in order if r[2] == ay][:positives]:
            fit = [r for r in order if r[2] != ay and percent * ps <= 100 * r[0] <= 100 * ps][:negatives]
            out += [(ai, pi, k + 1, ni, ps, ns) for k, (ns, ni, _) in enumerate(fit)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


def vectors(seed, n, dim, labels, clusters=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    if clusters:
        x = x * np.float32(0.1) + rng.normal(size=(clusters, dim)).astype(np.float32)[rng.integers(0, clusters, n)]
    return [(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, rng.integers(0, labels, n)))]


@pytest.mark.parametrize(("n", "dim", "labels", "clusters"), [(400, 8, 3, 0), (300, 2, 10, 5), (250, 16, 1, 0), (300, 1, 2, 0)])
def test_equals_all_pairs(spark, n, dim, labels, clusters):
    rows = vectors(n + dim, n, dim, labels, clusters)
    assert rows_of(hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0)) == brute(rows, lambda i: i % 20 == 0)


def test_ties_and_repeated_rows(spark):
    rows = [(i % 40, [float(i % 3), float(i % 2)], i % 2) for i in range(160)]
    assert rows_of(hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 7 == 0)) == brute(rows, lambda i: i % 7 == 0)


def test_a_hot_vector(spark):
    rows = vectors(5, 200, 6, 4) + [(1000 + i, [1.0] * 6, i % 4) for i in range(800)]
    assert rows_of(hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0)) == brute(rows, lambda i: i % 100 == 0)


def test_nulls_odd_vectors_and_clashing_names(spark):
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 1.5], 1), (2, [1.0, 1.4], 2), (None, [1.0, 1.0], 2), (3, None, 2), (4, [1.0, None], 2), (5, [float("nan"), 1.0], 2), (6, [float("inf"), 1.0], 2), (7, [1.0, 1.0], None), (8, [1.5], 2), (9, [], 2), (10, [0.0, 1.4, 9.0], 2), (11, [-1.0, -1.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("id", "row", "anchor", "vector", "norm", "block", "group", "kind", "lows", "pivots", "score", "rank", "window", "place"):
        df = df.withColumn(c, F.lit("clash"))
    found = rows_of(hard_negatives(df, F.col("vec_id") == 0))
    assert found == brute(rows, lambda i: i == 0)
    assert {r[3] for r in found} <= {2, 8, 9, 10}
    huge = [(0, [1e30, 1.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 0.9], 2), (3, [3e6, 3e6], 1), (4, [3e6, 2.9e6], 2)]
    got = rows_of(hard_negatives(spark.createDataFrame(huge, SCHEMA), F.col("vec_id") == 3))
    assert got == brute(huge[1:], lambda i: i == 3), "squared norms of 2^62 take no part, others are exact beyond 2^53"
    empty = spark.createDataFrame([], SCHEMA)
    assert hard_negatives(empty, F.col("vec_id") == 0).count() == 0
    assert hard_negatives(spark.createDataFrame(rows, SCHEMA), F.lit(False)).count() == 0


def test_anchors_in_several_blocks(spark, monkeypatch):
    import logloom.llm.hard_negatives as module

    monkeypatch.setattr(module, "ANCHOR_BYTES", 16 * 8 * 4)
    monkeypatch.setattr(module, "LEAST_GROUP", 50)
    rows = vectors(9, 300, 4, 3)
    assert rows_of(hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 5 == 0)) == brute(rows, lambda i: i % 5 == 0)


def test_brackets_hold_and_prune_clusters():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16)) * 100
    x = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 16)) * 4)
    largest = float((x**2).sum(1).max())
    pivots = choose_pivots(x[:500], largest, 16)
    stored, asked = pivots.distances(x, query=False), pivots.distances(x[:50], query=True)
    true = (x[:50] ** 2).sum(1)[:, None] + largest - 2 * x[:50] @ x.T
    lower = np.abs(asked[:, :, None] - stored[:, None, :]).max(axis=0)
    upper = (asked[:, :, None] + stored[:, None, :]).min(axis=0)
    assert isinstance(pivots, Pivots) and (lower**2 <= true + 1e-3).all() and (upper**2 >= true - 1e-3).all()
    labels = np.zeros(4000, np.int64)
    batch = pa.RecordBatch.from_pydict({"row": np.arange(50), "id": np.arange(50), "label": labels[:50], "vector": [v.astype(int).tolist() for v in x[:50]], "lows": [[-(1 << 63)]] * 50, "highs": [[(1 << 63) - 1]] * 50})
    block, computed = Block(batch, 16, pivots, True, 5), 0
    for at in range(0, 4000, 500):
        rows = np.arange(at, at + 500)
        computed += block.meet(rows, rows, labels[rows], x[rows].astype(np.int64), stored[:, rows])
    assert computed < 0.35 * 50 * 4000, "most rows of other clusters are left out"
