import math

import numpy as np
import pytest

from feedloom.llm import topk

SCHEMA = "vec_id long, embedding array<double>, label int"


def _plain(rows, k):
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(1024 * x) for x in v)]
    out = []
    for i, q in {(i, tuple(q)) for i, q in usable if i % 100 == 0}:
        scored = sorted((-max(min(sum(a * b for a, b in zip(q, v)), 2**63 - 1), 1 - 2**63), j) for j, v in usable if j != i and len(v) == len(q))
        out += [(i, n, j, -s) for n, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def _found(spark, rows, k, parts=5):
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).selectExpr("*", "1 AS _id", "2 AS score", "3 AS query_id").repartition(parts)
    got = topk.top_products(df, df.where("vec_id % 100 = 0"), k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("kind", ["spread", "groups", "copies", "lengths"])
def test_equals_comparing_all(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(5)
    n, d = 1500, 8
    points = rng.normal(size=(n, d))
    if kind == "groups":
        points = rng.normal(size=(6, d))[rng.integers(0, 6, n)] + rng.normal(size=(n, d)) * 0.01
    if kind == "copies":
        points[: n // 3] = points[0]
    if kind == "lengths":
        points *= rng.exponential(size=(n, 1)) ** 3
    rows = [(int(i) - 300, list(map(float, p))) for i, p in enumerate(points)]
    assert _found(spark, rows, 10) == _plain(rows, 10)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [-1.0, 0.5]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (None, [9.0, 9.0]), (3, [None, 1.0]), (4, [float("nan"), 1.0]),
        (5, [float("inf"), 1.0]), (6, []), (100, []), (200, [1.0, 1.0, 1.0]), (300, None), (7, [1e18, -1e18]), (8, [1e308, 1.0]), (400, [1e12, 3.0]), (-100, [0.0001, -0.0001]),
    ]
    assert _found(spark, rows, 3) == _plain(rows, 3)
    assert _found(spark, [(1, [1.0])], 3) == []
    assert _found(spark, [(100, [1.0])], 3) == []
    empty = spark.createDataFrame([], SCHEMA)
    assert topk.top_products(empty, empty).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    points = np.floor((rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 0.01) * 1024)
    tree = topk.cover_tree(points)
    assert sorted(tree.order) == list(range(4000)) and (tree.points == points[tree.order]).all()
    for i in range(len(tree.lo)):
        own = tree.points[tree.lo[i] : tree.hi[i]]
        assert np.sqrt(((own - tree.center[i]) ** 2).sum(axis=1)).max() <= tree.radius[i] * (1 + 1e-9)
        children = range(tree.first[i], tree.last[i])
        if children:
            assert [tree.lo[c] for c in children] + [tree.hi[i]] == [tree.lo[i]] + [tree.hi[c] for c in children]
            apart = [np.linalg.norm(tree.center[a] - tree.center[b]) for a in children for b in children if a < b]
            assert min(apart) >= max(tree.radius[c] for c in children) * (1 - 1e-9)
    a, b = rng.integers(0, len(tree.lo), (2, 300))
    for i, j, u in zip(a, b, topk._bounds(tree, a, tree, b)):
        assert (tree.points[tree.lo[i] : tree.hi[i]] @ tree.points[tree.lo[j] : tree.hi[j]].T).max() <= u
    search = topk.Search(np.arange(0, 4000, 10), points[::10], np.full(400, topk.NONE), 10)
    assert search.meet(np.arange(4000), points) < 0.5 * 400 * 4000
