"""Windows, islands and as-of joins against plain Python on random series."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gritstone.operators import asof, clean, islands
from gritstone.operators import windows as W

T0 = datetime(2024, 1, 1)


def series(spark, seed=1, keys=3, n=60, ties=False):
    rng = random.Random(seed)
    rows = []
    for k in range(keys):
        t = 0
        for i in range(n):
            t += rng.choice([0, 30, 60, 60, 90, 400]) if ties else rng.choice([30, 60, 60, 90, 400])
            rows.append((f"k{k}", T0 + timedelta(seconds=t), i, rng.choice([None, *(rng.uniform(-5, 5) for _ in range(6))]), rng.random() < 0.5))
    return rows, spark.createDataFrame(rows, "key string, ts timestamp, i int, x double, flag boolean").withColumn("us", W.micros("ts"))


def inside(rows, r, seconds):
    return [q for q in rows if q[0] == r[0] and r[1] - timedelta(seconds=seconds) < q[1] <= r[1]]


def test_trailing_is_half_open(spark):
    rows, df = series(spark)
    got = {(r.key, r.i): r for r in W.trailing_stats(df, "key", "x", 300).collect()}
    for r in rows:
        xs = [q[3] for q in inside(rows, r, 300) if q[3] is not None]
        g = got[r[0], r[2]]
        assert g.n == len(xs)
        if xs:
            m = sum(xs) / len(xs)
            assert g.mean == pytest.approx(m) and g.std == pytest.approx((sum((x - m) ** 2 for x in xs) / len(xs)) ** 0.5, abs=1e-9)


def test_chunks_change_nothing(spark):
    _, df = series(spark, 2)
    compute = lambda x, keys: x.withColumn("s", F.sum("x").over(W.trailing(keys, 300)))
    plain = {(r.key, r.i): r.s for r in compute(df, ["key"]).collect()}
    for chunk in (300, 500, 7200):
        assert {(r.key, r.i): r.s for r in W.chunked(df, "key", 300, chunk, compute).collect()} == pytest.approx(plain)
    with pytest.raises(ValueError):
        W.chunked(df, "key", 300, 200, compute)


def test_only_the_past_counts(spark):
    """Rows after a time change nothing at or before it."""
    rows, df = series(spark, 3)
    cut = T0 + timedelta(seconds=2000)
    f = lambda d: {(r.key, r.i): r.s for r in d.withColumn("s", W.slope(F.col("us") / 6e7, F.col("x"), W.trailing("key", 900), null_aware=True)).where(F.col("ts") <= F.lit(cut)).collect()}
    assert f(df) == f(df.where(F.col("ts") <= F.lit(cut)))


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("chunk", [None, 600.0])
def test_asof(spark, direction, exact, chunk):
    left, l = series(spark, 4, ties=True)
    right, r = series(spark, 5, ties=True)
    got = asof.asof_join(l.select("key", "ts", "i"), r.select("key", F.col("ts").alias("rts"), F.col("i").alias("j")), "key", "ts", "rts", ["j"], direction, exact, tie="j", chunk=chunk).collect()
    assert len(got) == len(left)
    back = direction == "backward"
    for g in got:
        ok = [(q[1], q[2]) for q in right if q[0] == g.key and ((q[1] < g.ts if back else q[1] > g.ts) or exact and q[1] == g.ts)]
        assert g.j == (max(ok)[1] if back else min(ok)[1] if ok else None) if ok else g.j is None


def test_intervals(spark):
    spans = spark.createDataFrame([("a", 0, 10, "p"), ("a", 10, 20, "q"), ("b", 5, 6, "r")], "key string, s long, e long, name string").withColumns({c: F.timestamp_seconds(c) for c in "se"})
    points = spark.createDataFrame([("a", 0), ("a", 9), ("a", 10), ("a", 20), ("b", 6), ("c", 1)], "key string, t long").withColumn("t", F.timestamp_seconds("t"))
    got = asof.point_in_interval(points, spans, "key", "t", "s", "e", ["name"]).orderBy("key", "t").collect()
    assert [r.name for r in got] == ["p", "p", "q", None, None, None]
    pairs = asof.overlap_join(spans, spans, "key", ("s", "e"), ("s", "e"), 3, {"name": "other"}).where("name <> other").count()
    assert pairs == 0  # touching intervals don't overlap


def test_overlap_pairs_once(spark):
    rng = random.Random(6)
    rows = [(f"k{i % 3}", s := rng.randint(0, 500), s + rng.randint(1, 120), i) for i in range(120)]
    df = spark.createDataFrame(rows, "key string, s long, e long, i int").withColumns({c: F.timestamp_seconds(c) for c in "se"})
    got = sorted((r.i, r.j) for r in asof.overlap_join(df, df, "key", ("s", "e"), ("s", "e"), 50, {"i": "j"}).where("i < j").collect())
    assert got == sorted((a[3], b[3]) for a in rows for b in rows if a[0] == b[0] and a[3] < b[3] and a[1] < b[2] and a[2] > b[1])


def test_runs(spark):
    rows, df = series(spark, 7)
    got = {(r.key, r.i): (r.run_start, r.run_pos) for r in islands.runs(df, "key", 120, "flag").collect()}
    state = {}
    for k, ts, i, _, flag in rows:
        before = state.get(k)
        pos, start = (before[0] + 1, before[3]) if before and (ts - before[1]).total_seconds() <= 120 and before[2] == flag else (1, ts)
        state[k] = (pos, ts, flag, start)
        assert got[k, i] == (int((start - datetime(1970, 1, 1)).total_seconds() * 1e6), pos)


def test_glitches(spark):
    """A lone impossible reading goes; two in a row, or one after a gap, stay."""
    xs = [50, 150, 51, 150, 150, 52, None, 53]
    rows = [("m", T0 + timedelta(minutes=i), float(x) if x else None, 1.0) for i, x in enumerate(xs)] + [("m", T0 + timedelta(minutes=60), 150.0, 1.0)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, x double, y double").withColumn("us", W.micros("ts"))
    got = clean.repair_glitches(df, "key", {"x": (0, 100), "y": (0, 2)}, 120).orderBy("ts").collect()
    assert [r.x for r in got] == [50, 50, 51, 51, 150, 52, 52, 53, 150]
    assert [r.glitch for r in got] == [None, "x", None, "x", None, None, "x", None, None]


def test_lookback(spark):
    rows, df = series(spark, 8)
    targets = df.select("key", "ts", "i")
    got = {(r.key, r.i): r.m for r in W.lookback_mean(targets, df, "key", "ts", "ts", "x", 600, "m").collect()}
    for k, ts, i, _, _ in rows:
        xs = [q[3] for q in rows if q[0] == k and ts - timedelta(seconds=600) <= q[1] < ts and q[3] is not None]
        assert got[k, i] == (pytest.approx(sum(xs) / len(xs)) if xs else None)


def test_running_totals(spark):
    rng = random.Random(9)
    rows = [(rng.choice([0.1, 0.2, rng.random()]), rng.randint(0, 5)) for _ in range(300)]
    got = W.running_totals(spark.createDataFrame(rows, "s double, v int"), "s", ["v"], 7).collect()
    assert sorted((r.s, r.v, r.total_v) for r in got) == sorted((s, v, sum(b for a, b in rows if a >= s)) for s, v in rows)
