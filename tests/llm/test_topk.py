import math
import sys

import numpy as np

from flowspark.llm import topk

MOST = sys.float_info.max


def brute(rows, k):
    """Rows are nodes: a row is never its own candidate, rows with the same id are; scores stay within 64 bits."""
    fine = [(i, [math.floor(max(-MOST, min(MOST, 64 * x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v in fine), default=0)
    fine = [(i, v + [0] * (width - len(v))) for i, v in fine]
    out = []
    for at, (q, v) in enumerate(fine):
        if q % 20 == 0:
            scores = sorted((-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i)
                            for other, (i, w) in enumerate(fine) if other != at)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def check(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    found = topk.top_k(df, "vec_id", "embedding", "id % 20 = 0", k)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()) == brute(rows, k)


def test_random_and_clustered(spark):
    draw = np.random.default_rng(3)
    centers = draw.normal(size=(5, 6))
    rows = [(i, (centers[i % 5] + 0.1 * draw.normal(size=6)).tolist()) for i in range(900)]
    check(spark, rows)


def test_ties_and_equal_vectors(spark):
    rows = [(i, [1.0, 0.5] if i % 3 else [0.25, -1.0]) for i in range(400)]
    check(spark, rows, 7)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, None), (40, []), (60, [1.0, None]), (80, [nan, 1.0]), (1, [inf, 0.0]), (2, [-1.0, 0.01]),
            (3, [0.5]), (None, [1.0, 1.0]), (4, [0.0, 0.0]), (5, [-0.0, 1e-9]), (100, [3.0, 3.0])]
    check(spark, rows)


def test_repeated_ids_are_rows_of_their_own(spark):
    draw = np.random.default_rng(5)
    check(spark, [(int(i), (2 * v).tolist()) for i, v in zip(draw.integers(0, 45, 300), draw.normal(size=(300, 3)))])
    check(spark, [(0, [1.0]), (0, [2.0]), (1, [1.0]), (2, [1.0])])


def test_many_equal_vectors(spark):
    draw = np.random.default_rng(7)
    rows = [(i, [0.5, 0.5] if i % 3 else (3 * draw.normal(size=2)).tolist()) for i in range(3000)]
    check(spark, rows, 70)


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.top_k(df, "vec_id", "embedding", "id % 20 = 0").count() == 0


def test_large_components(spark):
    draw = np.random.default_rng(9)
    check(spark, [(0, [300000.0, 0.0]), (1, [300000.0, 1.0]), (2, [-1e9, 2.0]), (3, [1e9, -3.0]), (20, [2.0**50, 1.0])])
    rows = [(i, (10.0 ** draw.integers(-2, 14, 4) * draw.normal(size=4)).tolist()) for i in range(300)]
    check(spark, rows)
    check(spark, [*rows, (400, [1e307, -1e300, 0.0, 1.0]), (401, [-1e307, 1e305, 2.0, 0.0])])


def test_blocks_and_shards_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_BYTES", 4096)
    monkeypatch.setattr(topk, "BLOCK_BYTES", 64)
    draw = np.random.default_rng(11)
    check(spark, [(i, draw.normal(size=5).tolist()) for i in range(1000)])


def test_tree_prunes_and_is_exact():
    draw = np.random.default_rng(1)
    centers = 50 * draw.normal(size=(40, 8))
    vectors = np.floor(centers[draw.integers(0, 40, 4000)] + draw.normal(size=(4000, 8)))
    parts = [slice(0, 2000), slice(2000, 4000)]
    trees = [topk.BallTree.from_bytes(topk.BallTree(np.arange(4000)[p], np.arange(4000)[p], vectors[p]).to_bytes()) for p in parts]
    block = topk.Block(np.arange(50), np.arange(50), vectors[:50], 10)
    opened = []
    original = topk._product
    topk._product = lambda a, b: opened.append(len(a) * len(b)) or original(a, b)
    try:
        for tree in trees:
            block.visit(tree)
            opened.append(0)
    finally:
        topk._product = original
    assert sum(opened) < 0.5 * 50 * 4000
    found = block.result().to_pandas()
    for q, rows in found.groupby("query_id"):
        line = vectors[q] @ vectors.T
        order = [i for i in np.lexsort((np.arange(4000), -line)) if i != q][:10]
        assert rows.vec_id.tolist() == order and rows.score.tolist() == line[order].tolist()
