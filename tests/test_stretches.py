"""Running values by stretches against one window a key; spaced rows against a loop."""

import random

from pyspark.sql import functions as F

from gritstone.operators import stretches as S
from gritstone.operators.stretches import Stretches, reached, spaced


def series(spark, seed=1, n=600):
    rng = random.Random(seed)
    rows, us = [], {"a": 0, "b": 0, None: 0}
    for _ in range(n):
        k = rng.choice(["a", "a", "a", "b", None])
        us[k] += rng.randrange(1, 90) * 1_000_000 + (3_000_000_000 if rng.random() < 0.01 else 0)
        rows.append((k, us[k], rng.choice([None, rng.randrange(100)]), rng.random() < 0.1, rng.random() < 0.6))
    return rows, spark.createDataFrame(rows, "k string, us long, x int, sure boolean, may boolean")


def test_running_values_equal_those_of_one_window(spark):
    _, df = series(spark)
    x = F.col("x")
    wanted = dict(last={"a1": x, "a2": F.when(x > 90, F.col("us"))}, before={"b": F.struct("us", "x")}, total={"c1": x, "c2": F.lit(1)}, top={"d": x}, top_before={"e": x})
    one = Stretches(("k",)).scan(df, **wanted)
    for seconds in (30.0, 600.0, 1e7):
        cut = Stretches(("k",), seconds).scan(df, **wanted)
        assert cut.columns == one.columns and sorted(map(str, cut.collect())) == sorted(map(str, one.collect()))


def loop(rows, seconds):
    out, last = [], {}
    for k, us, _, sure, may in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if k is None:
            continue
        if sure or (may and (k not in last or us - last[k] >= seconds * 1e6)):
            out.append((k, us))
            last[k] = us
    return sorted(out)


def test_spaced_rows_equal_a_loop(spark):
    for seed, seconds in ((2, 100.0), (3, 2000.0), (4, 0.5)):
        rows, df = series(spark, seed, 500)
        got = spaced(df, "k", "sure", "may", seconds, "post", chunk=700.0)
        assert got.columns == [*df.columns, "post"] and got.count() == len(rows)
        assert sorted((r.k, r.us) for r in got.where("post").collect()) == loop(rows, seconds)


def test_long_chains_take_few_rounds(spark):
    n = 3000
    nodes = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("at"), F.when(F.col("id") + 2 < n, F.col("id") + 2).alias("then"), (F.col("id") == 0).alias("begins"))
    assert sorted(r.at for r in reached(nodes, "k", "at", "then", "begins").collect()) == list(range(0, n, 2))


def test_spaced_rows_are_never_broadcast(spark, monkeypatch):
    """Small files hold many rows, and a broadcast of them passes the driver in each round."""
    plans, write = [], S.written_once

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(S, "written_once", seen)
    monkeypatch.setattr(S.asof, "written_once", seen)
    rows = [(k, i * 1_000_000, i % 40 == 0, i % 3 == 0) for k in range(4) for i in range(200)]
    out = S.spaced(spark.createDataFrame(rows, "k long, us long, sure boolean, may boolean"), "k", "sure", "may", 5, "post")
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 6 and not any("Broadcast" in p for p in plans)
    assert out.where("post").count() > 100
