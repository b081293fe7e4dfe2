"""Operator 12: k-means on integers, exact, by float32 screening with rounding-error intervals.

Each round reads the vectors once. A task multiplies a batch with all centroids in single precision; the error bound of that product gives
each centroid an interval, and most rows have only one centroid whose interval reaches below all others' upper ends. For
the rest, exact integer distances decide, ties to the lowest number (`lattice.nearest`). A task returns one row of exact sums for each centroid, which
Spark adds up; only the centroids come to the driver.

Edge cases: rows whose vector is null, has another length, or holds null or non-finite components are left out. Components may be of any
finite size: large ones are screened in doubles and settled in Python's integers, distances and sums beyond a long
are written as the largest long. Rows without vec_id take part, but begin a centroid last. Rows that repeat a vec_id or a vector count each. With fewer vectors than centroids
there are as many centroids as vectors. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lattice
from .frames import cut, keep, scratched

#: Rows multiplied at once, which bounds the product.
STEP = 4096


def usable(vectors: DataFrame, length: int) -> DataFrame:
    x = F.col("embedding")
    return vectors.where((F.size(x) == length) & lattice.finite(x)).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("vector") if dict(vectors.dtypes)["embedding"] != "array<float>" else x.alias("vector"))


def _assigned(batch: pa.RecordBatch, model: np.ndarray, scale: int):
    """(rows, components, centroid, distance) of a batch in pieces: small integers, then large ones."""
    width = model.shape[1]
    x, small, large = lattice.on_lattice(lattice.matrix(batch.column("vector"), width), scale, lattice.limit(width))
    for rows, values in ((np.flatnonzero(small), x[small]), (np.flatnonzero(~small), large)):
        for i in range(0, len(rows), STEP):
            part = values[i : i + STEP]
            yield rows[i : i + STEP], part, *lattice.nearest(part, model)


def _moved(rows: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """Centroids after a round."""
    k, width = len(centroids), len(centroids[0])
    most = lattice.limit(width)

    def run(batches):
        sums, model = lattice.Sums(k, width), lattice.table(centroids, width, most)
        for batch in batches:
            for _, x, at, _ in _assigned(batch, model, scale):
                sums.add(at, x)
        found = list(sums.rows())
        yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in found], pa.int32()), pa.array([x for _, x in found], pa.list_(pa.int64()))], ["cluster", "limbs"])

    total = lattice.totals(rows.select("vector").mapInArrow(run, "cluster int, limbs array<long>"), ["cluster"], width)
    return lattice.means(centroids, {g: v for (g,), v in total.items()})


@scratched
def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, length: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each usable row of `vectors` (vec_id, embedding).

    Components are floor(scale x), scale a power of two. Centroids begin as the vectors with the smallest sha256 of `seed:vec_id`.
    """
    spark, rows = vectors.sparkSession, usable(vectors, length)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(order.alias("order"), "vector").orderBy(F.asc_nulls_last("order"), "vector").limit(k).collect()  # k rows
    begin = np.array([r.vector for r in first], float).reshape(-1, length)
    x, small, large = lattice.on_lattice(begin, scale, lattice.limit(length))
    rest = iter(large.tolist())
    centroids = [x[i].tolist() if small[i] else next(rest) for i in range(len(x))]
    for _ in range(rounds if centroids else 0):
        centroids = _moved(rows, centroids, scale)

    def run(batches):
        model = lattice.table(centroids, length, lattice.limit(length))
        for batch in batches:
            for picked, _, at, distance in _assigned(batch, model, scale):
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(picked)), pa.array(at, pa.int32()), lattice.as_long(distance)], ["vec_id", "cluster", "distance"])

    placed = cut(rows.mapInArrow(run, "vec_id long, cluster int, distance long"), "placed")
    each = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()  # at most k rows
    whole = min(sum(int(r.total) for r in each), lattice.LONG)
    told = [(r.cluster, min(int(r.total), lattice.LONG), hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()) for r in each]
    named = spark.createDataFrame(told, "cluster int, cluster_inertia long, centroid_sha256 string")
    out = placed.join(F.broadcast(named), "cluster")  # at most k rows
    keep(placed)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(whole).cast("long").alias("inertia"), "centroid_sha256")


def cluster_sql(k: int = 40, rounds: int = 5, length: int = 64, scale: int = 256, seed: int = 2) -> str:
    """The same rows, each round a step of the query."""
    steps = [
        f"""with v as materialized (select row_number() over () as r, vec_id::bigint as vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as x from embeddings
  where embedding is not null and len(embedding) = {length} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (select (row_number() over (order by sha256('{seed}:' || vec_id)) - 1)::int as c, x from v order by sha256('{seed}:' || vec_id) limit {k})"""
    ]
    for i in range(rounds + 1):
        steps.append(f"d{i} as (select r, vec_id, v.x, c, list_sum(list_transform(list_zip(v.x, c{i}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from v cross join c{i})")
        steps.append(f"a{i} as materialized (select r, vec_id, x, c, d from (select *, row_number() over (partition by r order by d, c) as n from d{i}) where n = 1)")
        if i < rounds:
            steps.append(f"""m{i} as (select c, list(m order by j) as x from (select c, j, floor(sum(x[j]) / count(*))::bigint as m from a{i}, unnest(range(1, {length + 1})) as t(j) group by c, j) group by c),
c{i + 1} as materialized (select c, coalesce(m{i}.x, c{i}.x) as x from c{i} left join m{i} using (c))""")
    return ",\n".join(steps) + f"""
select vec_id, a.c as cluster, d as distance, (sum(d) over (partition by a.c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(e.x, ',')) as centroid_sha256
from a{rounds} a join c{rounds} e on a.c = e.c"""
