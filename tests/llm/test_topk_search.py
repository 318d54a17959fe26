import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwise.llm import topk_search as t

SCHEMA = "vec_id long, embedding array<{}>, label int, node long, v string, tie string, id string"


def table(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 0, 1, "x", "y", "z") for i, v in rows], SCHEMA.format(kind))


def brute(rows, k=10):
    grid = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            grid.append((i, [math.floor(1024 * x) for x in v]))
    out = []
    for at, (i, q) in enumerate(grid):
        if i is None or i % 10:
            continue
        scores = [(-sum(x * y for x, y in zip(q, v, strict=True)), j is None, j or 0, j)
                  for place, (j, v) in enumerate(grid) if place != at and len(v) == len(q)]
        out += [(i, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=repr)


def answers(df, **options):
    return sorted((tuple(r) for r in t.top_inner_products(df, F.col("vec_id") % 10 == 0, **options).collect()), key=repr)


@pytest.mark.parametrize("shard_rows, least", [(16_384, 1), (50, 8), (3, 40)])
def test_against_brute_force(spark, shard_rows, least):
    """Clusters, a vector that a third of all rows share, ties, and small whole numbers."""
    rng = np.random.default_rng(shard_rows)
    hot = rng.normal(size=6).tolist()
    rows = [(i, hot) for i in range(0, 300, 3)]
    rows += [(i, (rng.normal(size=6) * 3).tolist()) for i in range(1, 200, 3)]
    rows += [(i, rng.integers(-1, 2, size=6).astype(float).tolist()) for i in range(2, 300, 3)]
    assert answers(table(spark, rows), shard_rows=shard_rows, least_shards=least) == brute(rows)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_awkward_vectors(spark, kind):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (10, [nan, 1.0]), (20, [inf, 0.0]), (30, [None, 1.0]), (40, []), (50, []), (60, [0.0, 0.0]),
            (70, [1.0, -2.5]), (70, [1.0, -2.5]), (70, [1.0, 2.0]), (None, [1.0, -2.5]), (80, [3.0, 1.0, 1.0]),
            (-10, [1.0, 0.5]), (1, [0.25, 0.0])]
    for k in (1, 3, 10):
        assert answers(table(spark, rows, kind), k=k) == brute(rows, k)
    assert answers(table(spark, [], kind)) == []


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-(1 << 20), 1 << 20, size=3)]) for i in range(60)]
    assert answers(table(spark, rows)) == brute(rows)
    rows = [(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [1.0, 1.0])]
    assert [r[2] for r in sorted(answers(table(spark, rows)))] == [1, 2]


def test_tree_bounds_and_pruning():
    """Every point lies in its balls, and a search far from the other points looks into few leaves."""
    rng = np.random.default_rng(7)
    points = np.concatenate([rng.integers(-9, 9, (500, 8)), rng.integers(-9, 9, (500, 8)) + 4000])
    tree = t.ball_tree(points)
    first_leaf = (1 << tree.depth) - 1
    for i, rows in enumerate(tree.leaves):
        node = first_leaf + i
        while True:
            away = np.sqrt(((points[rows] - tree.centre[node]) ** 2).sum(axis=1))
            assert (away <= tree.radius[node] + 1e-6).all()
            if not node:
                break
            node = (node - 1) // 2
    looked = []
    plain = t.products

    def counted(a, b):
        looked.append(len(b))
        return plain(a, b)

    t.products = counted
    try:
        t.search(tree, points, np.arange(1000), np.ones((1, 8), np.int64), np.full(1, -t.LONG - 1), 5)
    finally:
        t.products = plain
    assert sum(looked) < 600


def test_equal_points_make_no_deep_tree():
    tree = t.ball_tree(np.zeros((1000, 3), np.int64))
    assert tree.depth == 4 and sum(len(x) for x in tree.leaves) == 1000
