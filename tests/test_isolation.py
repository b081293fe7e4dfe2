"""Isolation forests: planted outliers, defined results for odd input, the same forest however rows are dealt."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritstone.operators import isolation

XS = ["a", "b"]


def frame(spark, n=600, seed=3):
    r = np.random.default_rng(seed)
    rows = [(i, "dozer" if i % 3 else "truck", *map(float, r.normal(size=2))) for i in range(n)]
    rows += [(n + i, "dozer", 9.0 + i, -8.0) for i in range(3)]
    return spark.createDataFrame(rows, "id long, kind string, a double, b double")


def fitted(df, trees=40, sample=64):
    rows = isolation.picked(df, "kind", "id", XS, trees, sample)
    return rows, isolation.grow(rows, trees, sample)


def test_planted_outliers_come_first_and_are_flagged(spark):
    df = frame(spark)
    rows, forest = fitted(df)
    got = isolation.score(df, forest, "kind", XS)
    top = [r.id for r in got.where("kind = 'dozer'").orderBy(F.desc("score")).limit(3).collect()]
    assert set(top) == {600, 601, 602}
    limit = {r.grp: r.score_limit for r in isolation.limits(rows, forest, 0.03).collect()}
    n, over = got.where("kind = 'dozer'").count(), got.where(F.col("score") > limit["dozer"]).where("kind = 'dozer'").count()
    assert set(limit) == {"dozer", "truck"} and 0.02 * n < over < 0.04 * n


def test_nodes_are_trees_of_bounded_samples(spark):
    _, forest = fitted(frame(spark))
    nodes = forest.toPandas()
    for _, t in nodes.groupby(["grp", "tree"]):
        by = dict(zip(t.node, t["size"], strict=True))
        assert by[1] <= 64 and t.node.max() < 2**7
        for node, size, f in zip(t.node, t["size"], t.feature, strict=True):
            assert (math.isnan(f) and 2 * node not in by) or by.get(2 * node, 0) + by.get(2 * node + 1, 0) == size


def test_partitions_do_not_change_the_forest(spark):
    df = frame(spark)
    a, b = (sorted(map(tuple, fitted(x)[1].collect()), key=str) for x in (df.coalesce(1), df.repartition(7, "a")))
    assert a == b


def test_scores_equal_paths_walked_one_by_one(spark):
    df = frame(spark, 200)
    _, forest = fitted(df, 10, 32)
    nodes = {(r.grp, r.tree, r.node): r for r in forest.collect()}
    got = {r.id: r.score for r in isolation.score(df, forest, "kind", XS).collect()}
    for r in df.collect():
        total = whole = 0.0
        for tree in range(10):
            node, depth = nodes[r.kind, tree, 1], 0
            whole += isolation.path_length(node.size)
            while node.feature is not None:
                depth, node = depth + 1, nodes[r.kind, tree, 2 * node.node + (r[2 + node.feature] >= node.threshold)]
            total += depth + isolation.path_length(node.size)
        assert got[r.id] == pytest.approx(2 ** -(total / whole))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, "x", 1.0, None), (2, "x", nan, inf), (3, None, 1.0, 1.0), (4, "same", 2.0, 2.0), (5, "same", 2.0, 2.0), (6, "one", 0.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, kind string, a double, b double").withColumns({"score_limit": F.lit("mine"), "a.b": F.create_map(F.lit("k"), F.lit(1))})
    _, forest = fitted(df)
    other = df.unionByName(df.where("id = 6").withColumn("kind", F.lit("unseen")))
    out = isolation.score(other, forest, "kind", XS)
    got = [(r.id, r.kind, r.score) for r in out.collect()]
    assert out.columns == [*df.columns, "score"] and len(got) == 7
    by = {(i, k): s for i, k, s in got}
    assert by[3, None] is None and by[6, "unseen"] is None and by[6, "one"] == 0.5
    assert by[4, "same"] == by[5, "same"] == 0.5 and by[1, "x"] == by[2, "x"]
    empty = df.limit(0)
    assert isolation.score(empty, fitted(empty)[1], "kind", XS).count() == 0


def test_a_cut_on_the_lowest_value_leaves_an_empty_child(spark, monkeypatch):
    monkeypatch.setattr(isolation, "draw", lambda *parts: 0)
    x = np.array([[1.0], [np.nextafter(1.0, 2.0)]])
    nodes = {n: (size, f) for n, size, f, _ in isolation._nodes("g:0", x, 2)}
    assert nodes[1] == (2, 0) and nodes[2] == (0, None) and nodes[3][0] == 2
