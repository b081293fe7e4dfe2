"""Neighbours and dense clusters against plain Python, components against union-find."""

import random

import numpy as np
import pytest

from gritstone.operators import neighbours as N
from gritstone.operators.components import components


def plain_k(rows, k):
    x = np.array([v for _, v in rows])
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    kth = np.sort(d, axis=1)[:, k - 1] if len(rows) >= k else [None] * len(rows)
    return d, {i: v for (i, _), v in zip(rows, kth, strict=True)}


def plain_clusters(rows, eps, least):
    d, _ = plain_k(rows, 1)
    near = d <= eps
    core = near.sum(axis=1) >= least
    label = [i if c else None for (i, _), c in zip(rows, core, strict=True)]
    changed = True
    while changed:
        new = [min((label[j] for j in np.flatnonzero(near[i] & core)), default=None) if core[i] else None for i in range(len(rows))]
        changed, label = new != label, new
    final = [label[i] if core[i] else min((label[j] for j in np.flatnonzero(near[i] & core)), default=None) for i in range(len(rows))]
    return {rows[i][0]: (bool(core[i]), final[i]) for i in range(len(rows))}


def some_rows(seed, n, width=3):
    rng = random.Random(seed)
    middle = [[rng.uniform(-5, 5) for _ in range(width)] for _ in range(6)]
    rows = [[m + rng.gauss(0, 0.3) for m in middle[rng.randrange(6)]] for _ in range(n)] + [[rng.uniform(-9, 9) for _ in range(width)] for _ in range(n // 8)]
    rows += [[1.0] * width] * (n // 3) + [[1.0, *[0.0] * (width - 1)]] * 3
    return [(i * 3, v) for i, v in enumerate(rows)]


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("BLOCK", 24), ("PER_PIVOT", 30), ("MOST_PIVOTS", 12)):
        monkeypatch.setattr(N, name, value)


def test_k_distances(spark, small_blocks):
    rows = some_rows(1, 300)
    df = spark.createDataFrame([*rows, (-1, None), (-2, [None, 1.0, 1.0]), (-3, [float("nan"), 1.0, 1.0])], "id long, x array<double>")
    for k in (1, 5, 40):
        got = {r.id: r.k_distance for r in N.k_distances(df, "id", "x", k).collect()}
        assert got == pytest.approx(plain_k(rows, k)[1])
    few = spark.createDataFrame(rows[:3], "id long, x array<double>")
    assert [r.k_distance for r in N.k_distances(few, "id", "x", 4).collect()] == [None] * 3
    assert N.k_distances(spark.createDataFrame([], "id long, x array<double>"), "id", "x", 4).count() == 0


def test_density_clusters(spark, small_blocks):
    rows = some_rows(2, 240)
    df = spark.createDataFrame(rows, "id long, x array<double>")
    for eps, least in ((0.4, 5), (1.5, 3), (0.01, 2)):
        got = {r.id: (r.core, r.cluster) for r in N.density_clusters(df, "id", "x", eps, least).collect()}
        assert got == plain_clusters(rows, eps, least)


def test_few_pairs_of_blocks_meet(spark, small_blocks):
    """Far fewer pairs of points are compared than there are."""
    rng = random.Random(3)
    rows = [(i, [rng.uniform(0, 100), rng.uniform(0, 100)]) for i in range(2000)]
    space = N.Space(spark.createDataFrame(rows, "id long, x array<double>"), "id", "x")
    blocks = space.blocks(space.points.withColumnRenamed("n", "n").selectExpr("*", "point as label"))
    visits = space.visits(blocks, lambda x, weights, far: np.full(len(x), 2.0))
    assert sum(len(r.q_ids) for r in visits.collect()) < 2000 * 12 * 0.35


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + rng.randrange(1, 500)) for _ in range(400)] + [(rng.randrange(3000, 4000), rng.randrange(3000, 4000)) for _ in range(400)] + [(5, 5), (9000, 9000), (None, 4)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}
