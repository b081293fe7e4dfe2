import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gritstone.llm import sharding as s


def test_key_law(spark, small, texts):
    rows = s.assign(spark.read.parquet(f"{small}/documents.parquet"), s.tree(16), s.tree(16, extra=1), bucket_rows=7).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        assert r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_shares_follow_weights_and_growth_moves_little(spark):
    ids = spark.range(40_000).select(F.col("id").cast("string").alias("k"))
    counts = lambda root: {r[0]: r[1] for r in ids.groupBy(s.place(F.col("k"), root).alias("s")).count().collect()}
    even = counts(s.tree(16))
    assert len(even) == 16 and max(even.values()) < 1.15 * 2500 and min(even.values()) > 0.85 * 2500
    moved = ids.where(s.place(F.col("k"), s.tree(16)) != s.place(F.col("k"), s.tree(16, extra=1))).count()
    assert abs(moved - 40_000 / 17) < 250
    heavy = s.Node("root", (s.Node("a", own=3.0, shard=0), s.Node("b", own=1.0, shard=1)))
    assert abs(counts(heavy)[0] - 30_000) < 500


def test_weight_change_stays_in_its_subtree(spark):
    """More weight for one shard of a rack moves keys only into subtrees that hold it."""
    ids = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    rack = lambda w: s.Node("r0", (s.Node("x", own=w, shard=0), s.Node("y", own=1.0, shard=1)))
    root = lambda w: s.Node("root", (rack(w), s.Node("r1", (s.Node("z", own=1.0, shard=2), s.Node("u", own=1.0, shard=3)))))
    pairs = ids.select(s.place(F.col("k"), root(1.0)).alias("a"), s.place(F.col("k"), root(2.0)).alias("b")).where("a <> b").collect()
    assert pairs and all(r.b in (0, 1) for r in pairs) and not any(r.a in (2, 3) and r.b in (2, 3) for r in pairs)


def test_odd_rows(odd_docs, no_docs):
    rows = s.assign(odd_docs, s.tree(4)).collect()
    assert len(rows) == odd_docs.count() and all(r.grown_shard is None for r in rows)
    assert {r.size for r in rows if r.doc_id in (2, 3)} == {1} and len({r.shard for r in rows if r.doc_id == 6}) == 1
    assert s.assign(no_docs, s.tree(4)).collect() == []


def test_weight_zero(spark):
    """A shard that is drained gets no keys, and only its keys move; no weight at all is refused."""
    ids = spark.range(5_000).select(F.col("id").cast("string").alias("k"))
    root = lambda w: s.Node("root", (s.Node("a", (s.Node("x", own=w, shard=0), s.Node("y", own=1.0, shard=1))), s.Node("z", own=1.0, shard=2)))
    moved = ids.select(s.place(F.col("k"), root(1.0)).alias("a"), s.place(F.col("k"), root(0.0)).alias("b"))
    assert moved.where("b = 0").count() == 0 and moved.where("a <> 0 and a <> b and a <> 1").count() == 0
    for bad in (s.Node("root", (s.Node("x", own=0.0, shard=0), s.Node("y", own=0.0, shard=1))), s.Node("root", (s.Node("x", own=-1.0, shard=0), s.Node("y", own=2.0, shard=1)))):
        with pytest.raises(ValueError):
            s.place(F.col("k"), bad)
