"""Operators 12 and 13 against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest

from gritstone.llm import centroids, lattice, vector_codes


def lattice_of(v, scale):
    return [scale * int(x) if abs(x) >= 2.0**53 else math.floor(scale * x) for x in v]


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def apart(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def closest(x, book):
    return min((apart(x, c), i) for i, c in enumerate(book))


def moved(book, rows, at):
    out = []
    for i, c in enumerate(book):
        mine = [x for x, a in zip(rows, at, strict=True) if a == i]
        out.append([sum(col) // len(mine) for col in zip(*mine, strict=True)] if mine else c)
    return out


def long(x):
    return min(x, 2**63 - 1)


def plain_clusters(rows, k, rounds, length, scale=256):
    kept = [(i, lattice_of(v, scale), v) for i, v in rows if good(v) and len(v) == length]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[2]))
    book, xs = [x for _, x, _ in order[:k]], [x for _, x, _ in kept]
    for _ in range(rounds):
        book = moved(book, xs, [closest(x, book)[1] for x in xs])
    found = [closest(x, book) for x in xs]
    own = [sum(d for d, c in found if c == i) for i in range(len(book))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in book]
    return sorted(((i, c, long(d), long(own[c]), long(sum(own)), sha[c]) for (i, _, _), (d, c) in zip(kept, found, strict=True)), key=str)


def plain_codes(rows, parts, entries, rounds, scale=1024):
    kept = [(i, v, label) for i, v, label in rows if good(v)]
    w = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    pad = lambda v: [*v, *[0.0] * (w * parts - len(v))]
    kept = [(i, lattice_of(pad(v), scale), label, v) for i, v, label in kept]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[:entries]
    cut = lambda x: [x[p * w : (p + 1) * w] for p in range(parts)]
    books = [[cut(x)[p] for _, x, _, _ in order] for p in range(parts)]
    xs = [cut(x) for _, x, _, _ in kept]
    for _ in range(rounds):
        books = [moved(b, [x[p] for x in xs], [closest(x[p], b)[1] for x in xs]) for p, b in enumerate(books)]
    found = [[closest(x[p], b) for p, b in enumerate(books)] for x in xs]
    error = [sum(d for d, _ in f) for f in found]
    by = {}
    for (_, _, label, _), e in zip(kept, error, strict=True):
        by[label] = by.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{c:02x}" for _, c in f), long(e), long(by[label]), sha) for (i, _, label, _), f, e in zip(kept, found, error, strict=True)), key=str)


def odd_rows(rng, n, width, size=1.0):
    """Ties, copies, repeated and missing ids, unusable vectors."""
    rows = [(i, [rng.uniform(-size, size) for _ in range(width)]) for i in range(n)]
    rows += [(n + i, [0.25] * width) for i in range(n // 2)] + [(n + i, [float(rng.randrange(-1, 2)) for _ in range(width)]) for i in range(n)]
    rows += [(3, [0.5] * width), (3, [0.5] * width), (None, [0.125] * width), (None, [rng.random() for _ in range(width)])]
    return rows + [(7000, None), (7001, [None] + [1.0] * (width - 1)), (7002, [float("nan")] * width), (7003, [float("-inf")] * width)]


def clusters(spark, rows, kind="double", **how):
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], f"vec_id long, embedding array<{kind}>, cluster int, vector string, `a.b` double")
    return sorted((tuple(r) for r in centroids.cluster(df, **how).collect()), key=str)


def codes(spark, rows, kind="double", **how):
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], f"vec_id long, embedding array<{kind}>, label int, code int, part string, `a.b` double")
    return sorted((tuple(r) for r in vector_codes.encode(df, **how).collect()), key=str)


def test_clusters_equal_brute_force(spark):
    rng = random.Random(5)
    rows = odd_rows(rng, 60, 6) + [(8000, [1.0] * 5), (8001, [1.0] * 7), (8002, [])]
    assert clusters(spark, rows, k=9, rounds=3, length=6) == plain_clusters(rows, 9, 3, 6)
    assert clusters(spark, rows[:3], k=9, rounds=2, length=6) == plain_clusters(rows[:3], 9, 2, 6)
    assert clusters(spark, [], k=9) == []


@pytest.mark.parametrize("size", [1e5, 1e9, 1e17, 1e200, 1e307])
def test_clusters_of_large_components_are_exact(spark, size):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) * (size if i % 3 == 0 else 1.0) for _ in range(4)]) for i in range(40)]
    assert clusters(spark, rows, k=6, rounds=2, length=4) == plain_clusters(rows, 6, 2, 4)


def test_intervals_hold_and_spare_exact_work():
    """An interval of single precision holds the exact value, and most rows need no exact comparison."""
    rng = np.random.default_rng(3)
    for top in (3, 300, lattice.limit(64)):
        x, c = rng.integers(-top, top + 1, (300, 64)), rng.integers(-top, top + 1, (40, 64))
        low, high = lattice.intervals(x, c, np.float32)
        exact = [[sum(int(v) * int(v) for v in b) - 2 * sum(int(v) * int(w) for v, w in zip(a, b, strict=True)) for b in c.tolist()] for a in x.tolist()]
        assert all(low[i, j] <= e <= high[i, j] for i, row in enumerate(exact) for j, e in enumerate(row))
    x, c = np.floor(256 * rng.normal(size=(5000, 64))).astype(np.int64), np.floor(256 * rng.normal(size=(40, 64))).astype(np.int64)
    counts = {}
    at, d = lattice.nearest(x, c, counts)
    full = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    assert (at == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all() and counts["open"] < 0.05 * counts["rows"]


def test_codes_equal_brute_force(spark):
    rng = random.Random(7)
    rows = [(*r, [None, 1, 1, 2][k % 4]) for k, r in enumerate(odd_rows(rng, 70, 8))] + [(9000, [], 5), (9001, [1.0], None), (9002, [0.5] * 9, 1)]
    assert codes(spark, rows, entries=20, rounds=3) == plain_codes(rows, 4, 20, 3)
    assert codes(spark, rows[:5], rounds=2) == plain_codes(rows[:5], 4, 256, 2)
    assert codes(spark, [(1, [], None)], rounds=1) == plain_codes([(1, [], None)], 4, 256, 1)
    assert codes(spark, []) == []
    few = [(i, [float(np.float32(x)) for x in v] if good(v) else v, label) for i, v, label in rows]
    assert codes(spark, few, "float", entries=20, rounds=3) == plain_codes(few, 4, 20, 3)


@pytest.mark.parametrize("size", [1e4, 1e9, 1e200])
def test_codes_of_large_components_are_exact(spark, size):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) * (size if i % 5 == 2 else 1.0) for _ in range(8)], i % 2) for i in range(50)]
    assert codes(spark, rows, entries=12, rounds=3) == plain_codes(rows, 4, 12, 3)


def test_group_bounds_spare_scans_and_change_nothing():
    rng = np.random.default_rng(4)
    middle = rng.integers(-2000, 2000, (64, 16))
    x = (middle[rng.integers(0, 64, 4000)] + rng.integers(-60, 60, (4000, 16))).astype(float)
    book = np.floor(x[:256]).astype(np.int64)
    group = vector_codes.groups_of(book)
    at, _, bounds = vector_codes.full_scan(x, book, group)
    counts = {}
    for r in range(1, 5):
        new = np.array([np.floor(x[at == e].mean(axis=0)) if (at == e).any() else book[e] for e in range(256)]).astype(np.int64)
        at, d, bounds = vector_codes.bounded_scan(x, new, group, vector_codes.moves(book, new, group), at, bounds, counts)
        whole, least, _ = vector_codes.full_scan(x, new, group)
        assert (at == whole).all() and (d == least).all()
        full = vector_codes._distances(x, new)
        full[np.arange(len(x)), at] = np.inf
        for g in range(vector_codes.GROUPS):
            assert (bounds[:, g] <= np.sqrt(full[:, group == g].min(axis=1, initial=np.inf))).all()
        book = new
    assert counts["scanned"] < 0.5 * 4 * len(x) * 256


def test_queries_equal_sql(spark, small):
    import duckdb

    from gritstone.llm import queries

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{small}/embeddings.parquet'")
    for name in ("op12_centroids", "op13_vector_codes"):
        got = queries.QUERIES[name](spark, small)
        want = con.sql(queries.ORACLE[name])
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
