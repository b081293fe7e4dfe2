"""Boosted trees: known quantiles, exact contributions, the same fit however rows are dealt, odd rows."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritstone.operators import boosting as B

XS = ["a", "b", "c"]


def frame(spark, n=900, seed=5):
    r = np.random.default_rng(seed)
    a, b, c = r.integers(0, 10, n), r.normal(size=n), r.integers(0, 2, n)
    y = 2.0 * a + np.where(c == 1, 5.0, 0.0) + r.uniform(0, 4, n)
    rows = [(i, float(u), float(v), int(w), float(t)) for i, (u, v, w, t) in enumerate(zip(a, b, c, y, strict=True))]
    return spark.createDataFrame(rows, "id long, a double, b double, c int, y double")


AT = [[float(i) for i in range(1, 10)], [-1.0, 0.0, 1.0], [1.0]]


@pytest.fixture(scope="module")
def fitted(spark):
    df = frame(spark)
    nodes = B.fit(df, "y", XS, AT, [10, 50, 90], trees=12, depth=2, shrink=2)
    return df, spark.createDataFrame(nodes.collect(), B.NODES)


def test_quantiles_follow_the_target(fitted):
    df, nodes = fitted
    got = B.predict(df, nodes, XS, [10, 50, 90]).select("y", "predicted").collect()
    for i, q in enumerate((0.1, 0.5, 0.9)):
        assert abs(np.mean([r.y <= r.predicted[i] for r in got]) - q) < 0.06
    spread = np.mean([abs(r.y - r.predicted[1]) for r in got])
    assert spread < 0.4 * np.mean(np.abs([r.y - np.median([s.y for s in got]) for r in got]))


def test_first_leaf_is_the_exact_quantile(fitted):
    df, nodes = fitted
    ys = sorted(math.floor(r.y * 1000) for r in df.collect())
    base = {r.model: r.value for r in nodes.where("tree = 0").collect()}
    assert base == {str(p): ys[math.ceil(p * len(ys) / 100) - 1] for p in (10, 50, 90)}


def test_partitions_do_not_change_the_fit(spark, fitted):
    df, _ = fitted
    a, b = (sorted(map(str, B.fit(d, "y", XS, AT, [30], 2, 2).collect())) for d in (df.coalesce(1), df.repartition(5, "b")))
    assert a == b


def test_contributions_equal_all_orders_of_features(fitted):
    df, nodes = fitted
    rows = df.limit(25)
    got = B.contributions(B.predict(rows, nodes, XS, [50]), nodes, XS, 50).collect()
    by: dict = {}
    for r in nodes.where("model = '50'").collect():
        by.setdefault(r.tree, {})[r.node] = r

    def worth(x, known, tree, node=1):
        n = tree[node]
        if n.feature is None:
            return n.value / 1000
        left, right = tree[2 * node], tree[2 * node + 1]
        if n.feature in known:
            return worth(x, known, tree, 2 * node + (x[n.feature] >= n.cut))
        return (left.size * worth(x, known, tree, 2 * node) + right.size * worth(x, known, tree, 2 * node + 1)) / n.size

    for r in got:
        x = [r.a, r.b, r.c]
        total = lambda known: sum(worth(x, known, t) for t in by.values())  # noqa: E731, B023
        parts = [0.0] * 3
        for order in itertools.permutations(range(3)):
            for i, f in enumerate(order):
                parts[f] += (total(order[: i + 1]) - total(order[:i])) / 6
        assert r.parts == pytest.approx(parts, abs=1e-9) and r.base == pytest.approx(total(()))
        assert r.base + sum(r.parts) == pytest.approx(r.predicted[0])


def test_probabilities(spark):
    df = frame(spark).withColumn("late", (F.col("y") > 12).cast("int"))
    nodes = B.fit(df, "late", XS, AT, [B.LOGIT], trees=15, depth=2, shrink=2)
    got = B.predict(df, nodes, XS, [B.LOGIT], "p").select("late", F.col("p")[0].alias("p")).collect()
    assert np.mean([(r.p > 0.5) == bool(r.late) for r in got]) > 0.9
    assert abs(np.mean([r.p for r in got]) - np.mean([r.late for r in got])) < 0.03


def test_cuts_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1.0), (2, nan, 1.0), (3, inf, 9.0), (4, 5.0, 9.0), (5, 5.0, None), (6, 1.0, nan), (7, -inf, 1.0)]
    df = spark.createDataFrame(rows, "id long, a double, y double").withColumns({"predicted.x": F.create_map(F.lit("k"), F.lit(1)), "cut": F.lit("mine")})
    at = B.cuts(df.where("a < 10"), ["a"], 4)
    assert at[0] == sorted(set(at[0])) and set(at[0]) <= {-inf, 1.0, 5.0}
    nodes = B.fit(df, "y", ["a"], [[2.0]], [50], trees=3, depth=1, shrink=1, least=1)
    out = B.predict(df, nodes, ["a"], [50])
    assert out.columns == [*df.columns, "predicted"]
    assert {r.id: r.predicted[0] for r in out.collect()} == {1: 1.0, 2: 1.0, 3: 9.0, 4: 9.0, 5: 9.0, 6: 1.0, 7: 1.0}
    assert {r["size"] for r in nodes.where("node = 1").collect()} == {5}
    empty = df.limit(0)
    none = B.fit(empty, "y", ["a"], [[]], [50, 90], trees=1)
    assert {(r["size"], r.value) for r in none.collect()} == {(0, 0)} and B.predict(empty, none, ["a"], [50]).count() == 0
    assert B.contributions(df, none, ["a"], 90).select("base", "parts").distinct().collect() == [(0.0, [0.0])]
    with pytest.raises(ValueError):
        B.fit(df, "y", ["a"], [[]], [50, 50])


def test_failure_forecast_has_a_floor_that_is_named_first(spark):
    from gritstone.plans import maintenance

    df = frame(spark).withColumn("late", (F.col("y") > 12).cast("int"))
    nodes = B.fit(df, "late", XS, AT, [B.LOGIT], trees=6, depth=2, shrink=2)
    rows = df.where("id < 60").withColumn("far", F.when(F.col("id") % 3 == 0, "b").when(F.col("id") % 3 == 1, "unseen"))
    parts = {r.id: dict(zip(XS, r.parts, strict=True)) for r in B.contributions(rows, nodes, XS, B.LOGIT).collect()}
    plain = {r.id: r.p[0] for r in B.predict(rows, nodes, XS, [B.LOGIT], "p").collect()}
    out = maintenance.failure_forecast(rows, nodes, XS, "far", 2)
    assert out.columns == [*rows.columns, "p", "top_factors", "risk_band"]
    for r in out.collect():
        up = sorted((x for x in XS if parts[r.id][x] > 0), key=lambda x: (-parts[r.id][x], x)) or sorted(XS, key=lambda x: (-abs(parts[r.id][x]), x))
        want = up[:2] if r.far is None else [r.far, *[x for x in up[:2] if x != r.far][:1]]
        assert [f.feature for f in r.top_factors] == want
        assert r.p == pytest.approx(plain[r.id] if r.far is None else max(plain[r.id], 0.35))
        assert r.risk_band == ("high" if r.p >= 0.6 else "medium" if r.p >= 0.3 else "low")
        assert all((f.shap is None) == (f.feature == "unseen") for f in r.top_factors)


def test_forecast_is_in_order_and_leaves_the_size_out(spark):
    from gritstone.plans import task_time

    df = frame(spark).select("id", F.col("a").alias("quantity"), F.when(F.col("id") % 7 > 0, F.col("c")).alias("c"), F.when(F.col("id") % 11 > 0, F.col("y")).alias("minutes"))
    nodes = task_time.fit_forecast(df, "minutes", ["quantity", "c"], trees=5, depth=2, shrink=2)
    off = task_time.widening(df, nodes, ["quantity", "c"], "minutes", 0.9).first().offset
    out = task_time.forecast(df, nodes, ["quantity", "c"], off)
    assert out.columns == [*df.columns, "p10_min", "p50_min", "p90_min", "factors"]
    got = out.collect()
    assert len(got) == 900 and all(r.p10_min <= r.p50_min <= r.p90_min and [f.feature for f in r.factors] == ["c"] for r in got)
    known = [r for r in got if r.minutes is not None]
    assert np.mean([r.p10_min - 1e-9 <= r.minutes <= r.p90_min + 1e-9 for r in known]) >= 0.9
    assert task_time.widening(df.limit(0), nodes, ["quantity", "c"], "minutes").first().offset == 0.0
