import random

import numpy as np

from gritstone.llm import exact_topk as t


def plain(rows, k):
    import math

    ok = [(i, [256 * int(x) if abs(x) > 1e300 else math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {i: v for i, v in ok if i % 50 == 0}.items():
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
        out += [(q, r, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def found(df, k=5):
    return sorted(tuple(r) for r in t.top_k(df, df.where("vec_id % 50 = 0"), k).collect())


def test_equals_all_pairs_with_ties_and_hot_vector(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(400)] + [(i, [0.5] * 8) for i in range(400, 700)]
    rows += [(900, None), (950, [float("nan")] * 8), (1000, [None] + [1.0] * 7), (1050, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumnRenamed("embedding", "embedding")
    monkeypatch.setattr(t, "CANDIDATE_BLOCK", 128)
    monkeypatch.setattr(t, "QUERY_BLOCK", 4)
    assert found(df) == plain(rows, 5)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, -3.0]), (2, [0.1, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [r[:3] for r in found(df)] == [r[:3] for r in plain([(i, [float(x) for x in v]) for i, v in rows], 5)]
    assert found(spark.createDataFrame([], "vec_id long, embedding array<float>")) == []


def test_large_components_are_exact(spark):
    """Nothing finite is left out: products beyond doubles and beyond longs are ranked as integers."""
    rng = random.Random(8)
    size = lambda i: [1.0, 1e6, 1e9, 1e16, 1e200, 1e307][i % 6] if i % 7 == 0 or i < 12 else 1.0
    rows = [(i, [rng.uniform(-1, 1) * size(i) for _ in range(5)]) for i in range(160)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df) == plain(rows, 5)
    rows = [(i, [float(2**40 + i), 1.0]) for i in range(60)]
    assert found(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == plain(rows, 5)


def test_lengths_repeated_ids_and_other_columns(spark):
    """Lengths meet in what both have; a query leaves out all rows of its own id and counts others once a row."""
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(rng.choice([0, 3, 8, 9, 40]))]) for i in range(120)]
    assert found(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == plain(rows, 5)
    rows = [(50, [1.0, 1.0]), (50, [2.0, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [0.5, 0.0])]
    df = spark.createDataFrame([(*r, 3, 4, "x") for r in rows], "vec_id long, embedding array<double>, score int, block int, ids string")
    assert found(df) == [(50, 1, 7, 65536), (50, 2, 7, 65536), (50, 3, 8, 32768)]


def test_the_cutoff_spares_work():
    """Whole scores are resolved for few of all entries."""
    rng = np.random.default_rng(2)
    q, c = (np.floor(256 * rng.normal(size=(n, 64))) for n in (40, 4000))
    q_ids, ids = np.arange(40) + 10_000, np.arange(4000)
    row, column, score, first = t._entries(q_ids, q, ids, c, 5, None)
    best = t._best(row, score, ids[column], 5)
    cutoff = np.array([score[best][row[best] == i].min() for i in range(40)])
    row, column, score, second = t._entries(q_ids, q, ids, c, 5, cutoff)
    got = t._best(row, score, ids[column], 5)
    whole = q @ c.T
    for i in range(40):
        assert sorted(column[got][row[got] == i]) == sorted(np.lexsort((ids, -whole[i]))[:5])
    assert first <= 40 * 5 * t.PARTS and second < 0.15 * whole.size


def test_copies_of_query_blocks_are_not_broadcast(spark):
    """They are queries x candidate blocks, which no estimate of a table's size shows."""
    rows = [(i, [float(i % 7), float(i % 11)]) for i in range(300)]
    (candidates, numbers), (blocks, _) = (t._blocks(t.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), n, "blocks") for n in (16, 8))
    plan = t._met(blocks, candidates, numbers)._jdf.queryExecution().executedPlan().toString()
    assert numbers > 1 and "SortMergeJoin" in plan and "Broadcast" not in plan
