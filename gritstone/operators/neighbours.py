"""Nearest neighbours of a table in itself, and clusters of dense points, without meeting all pairs.

Pivots, a sample of the points, divide space into cells: a point belongs to its nearest pivot. A cell's points lie in blocks (rings) by their
distance to the pivot. A point whose search radius is r can have a neighbour in a cell only if three bounds allow it: its
distance to the pivot less r is at most the cell's outer radius, plus r at least its inner one, and half of what the pivot is further than its own is at most r. So
a block of points meets only the rings that its own bounds reach, by a join on the cell, and numpy compares the two blocks.
Equal vectors are one point with a weight, so copies never meet each other.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import remove, written_once
from .components import components

#: Points in a block; pivots are one for each so many points, and so many at most, as tasks hold them all.
BLOCK, PER_PIVOT, MOST_PIVOTS = 1024, 2048, 1024
#: Slack on bounds for the rounding of distances.
SLACK = 1e-9
BLOCKS = "cell int, ring int, lo double, hi double, ids array<long>, weights array<long>, labels array<long>, flat array<double>, dist array<double>"
NEEDED = ["ids", "weights", "labels", "flat"]


class Space:
    """The distinct points of a table by cell, and the pivots."""

    def __init__(self, df: DataFrame, key: str, vector: str) -> None:
        x = F.transform(F.col(vector), lambda v: v.cast("double"))
        usable = df.withColumn("_x", x).where(F.col("_x").isNotNull() & F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))
        self.rows = usable.select(F.col(key).cast("long").alias("id"), F.col("_x").alias("vector"))
        grouped = written_once(self.rows.groupBy("vector").agg(F.min("id").alias("point"), F.count(F.lit(1)).alias("n")), "points")
        total = grouped.count()
        count = max(1, min(MOST_PIVOTS, -(-total // PER_PIVOT)))
        self.pivots = np.array([r.vector for r in grouped.orderBy(F.xxhash64("point"), "point").limit(count).collect()], float)  # at most MOST_PIVOTS
        self.points = written_once(_placed(grouped, self.pivots), "placed") if total else grouped.select("point", "n", "vector", F.lit(0).alias("cell"), F.lit(0.0).alias("dist"))
        remove(grouped) if total else None
        spans = self.points.groupBy("cell").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi")).collect()  # a row a pivot
        self.inner, self.outer = (np.full(len(self.pivots), end) for end in (np.inf, -np.inf))
        for r in spans if total else []:
            self.inner[r.cell], self.outer[r.cell] = r.lo, r.hi

    def blocks(self, points: DataFrame) -> DataFrame:
        """Points of `self.points` (those of a subset, with a label) in rings of at most BLOCK, as arrays."""
        ring = F.floor((F.row_number().over(Window.partitionBy("cell").orderBy("dist", "point")) - 1) / BLOCK).cast("int")
        row = F.struct("dist", "point", "n", "label", "vector")
        packed = points.withColumn("ring", ring).groupBy("cell", "ring").agg(F.array_sort(F.collect_list(row)).alias("r"))  # at most BLOCK rows
        return packed.select("cell", "ring", F.col("r")[0]["dist"].alias("lo"), F.element_at("r", -1)["dist"].alias("hi"), F.col("r.point").alias("ids"), F.col("r.n").alias("weights"), F.col("r.label").alias("labels"), F.flatten("r.vector").alias("flat"), F.col("r.dist").alias("dist"))

    def visits(self, blocks: DataFrame, radius: Callable) -> DataFrame:
        """For each block and each cell that its points may have neighbours in: these points, their radius and their distance to the pivot."""
        pivots, inner, outer = self.pivots, self.inner, self.outer
        schema = "cell int, lo double, hi double, q_ids array<long>, q_flat array<double>, q_reach array<double>, q_dist array<double>"

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    x, own = _matrix(batch, i, "flat"), _array(batch, i, "dist")
                    ids, far = _array(batch, i, "ids"), _apart(x, pivots)
                    exact = radius(x, _array(batch, i, "weights"), far)
                    reach = exact * (1 + SLACK)
                    out = []
                    for c in np.flatnonzero(((far - reach[:, None] <= outer * (1 + SLACK)) & (far + reach[:, None] >= inner * (1 - SLACK))).any(axis=0)):
                        d = far[:, c]
                        at = np.flatnonzero((d - reach <= outer[c] * (1 + SLACK)) & (d + reach >= inner[c] * (1 - SLACK)) & ((d - own) / 2 <= reach + SLACK * d))
                        if len(at):
                            out.append((int(c), float((d[at] - reach[at]).min()), float((d[at] + reach[at]).max()), ids[at], x[at].ravel(), exact[at], d[at]))
                    if out:
                        kinds = [pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.int64()), *[pa.list_(pa.float64())] * 3]
                        yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], ["cell", "lo", "hi", "q_ids", "q_flat", "q_reach", "q_dist"])

        return blocks.select("ids", "weights", "flat", "dist").mapInArrow(run, schema)

    def meet(self, visits: DataFrame, blocks: DataFrame, step: Callable, schema: str) -> DataFrame:
        """`step(ids, reach, distances, block ids, weights, labels)` for each pair of blocks that may hold neighbours; it returns columns.

        Distances beyond a query's reach are infinite.
        """
        q = visits.withColumnsRenamed({"lo": "q_lo", "hi": "q_hi"})
        rings = blocks.select("cell", "lo", "hi", *NEEDED)
        pairs = q.join(rings, "cell").where((F.col("lo") * (1 - SLACK) <= F.col("q_hi")) & (F.col("hi") * (1 + SLACK) >= F.col("q_lo")))
        names = [c.split(" ")[0] for c in schema.split(", ")]

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    reach, d = _array(batch, i, "q_reach"), _array(batch, i, "q_dist")
                    lo, hi = batch.column("lo")[i].as_py() * (1 - SLACK), batch.column("hi")[i].as_py() * (1 + SLACK)
                    wide = reach * (1 + SLACK)
                    at = np.flatnonzero((d - wide <= hi) & (d + wide >= lo))
                    if not len(at):
                        continue
                    x, y = _matrix(batch, i, "q_flat", "q_ids")[at], _matrix(batch, i, "flat")
                    far = _apart(x, y)
                    far[far > reach[at, None]] = np.inf
                    got = step(_array(batch, i, "q_ids")[at], far, *(_array(batch, i, c) for c in ("ids", "weights", "labels")))
                    if len(got[0]):
                        yield pa.RecordBatch.from_arrays(got, names)

        return pairs.select("lo", "hi", "q_ids", "q_flat", "q_reach", "q_dist", *NEEDED).mapInArrow(run, schema)

    def close(self) -> None:
        remove(self.points)


def _array(batch: pa.RecordBatch, i: int, name: str) -> np.ndarray:
    return batch.column(name)[i].values.to_numpy()


def _matrix(batch: pa.RecordBatch, i: int, name: str, ids: str = "ids") -> np.ndarray:
    return _array(batch, i, name).reshape(len(batch.column(ids)[i]), -1)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances between rows, components added in order; one matrix at a time is held."""
    out = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        out += (x[:, j, None] - y[None, :, j]) ** 2
    return np.sqrt(out)


def _placed(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Points with the cell of their nearest pivot and their distance to it."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                x = part.column("vector").flatten().to_numpy().reshape(part.num_rows, -1)
                d = _apart(x, pivots)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("point"), part.column("n"), part.column("vector"), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], ["point", "n", "vector", "cell", "dist"])

    return points.select("point", "n", "vector").mapInArrow(run, "point long, n long, vector array<double>, cell int, dist double")


def _kth(d: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Distance within which each row has a weight of at least k; infinite if it never has."""
    order = np.argsort(d, axis=1, kind="stable")
    total = np.cumsum(weights[order], axis=1)
    at = (total < k).sum(axis=1)
    return np.where(at < d.shape[1], np.take_along_axis(d, np.take_along_axis(order, np.minimum(at, d.shape[1] - 1)[:, None], axis=1), axis=1)[:, 0], np.inf)


def _point_k_distances(space: Space, blocks: DataFrame, k: int) -> DataFrame:
    """point and k_distance, exact."""

    def radius(x, weights, far):
        # both are upper bounds of the k-th distance: within the own block, and among the pivots, which are points too
        return np.minimum(_kth(_apart(x, x), weights, k), _kth(far, np.ones(far.shape[1], int), k))

    def best(ids, far, others, weights, labels):
        keep = min(k, far.shape[1])
        at = np.argpartition(far, keep - 1, axis=1)[:, :keep]
        d = np.take_along_axis(far, at, axis=1)
        row, column = np.nonzero(np.isfinite(d))
        return [pa.array(ids[row]), pa.array(d[row, column]), pa.array(weights[at[row, column]])]

    # a point may have no bound yet (fewer than k rows in its block and few pivots); then it visits all cells
    near = space.meet(space.visits(blocks, radius), blocks, best, "point long, d double, n long")
    w = Window.partitionBy("point").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return near.withColumn("total", F.sum("n").over(w)).where(F.col("total") >= k).groupBy("point").agg(F.min("d").alias("k_distance"))


def k_distances(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """id and k_distance: how far the k-th nearest row of the table is, the row itself included; exact.

    Keys are whole numbers. Rows whose vector is null or holds null or non-finite components take no part; a table of fewer than k rows gives nulls. All vectors
    have one length. Copies of a vector are one point with their count.
    """
    space = Space(df, key, vector)
    blocks = written_once(space.blocks(space.points.withColumn("label", F.col("point"))), "blocks")
    found = written_once(_point_k_distances(space, blocks, k), "k-distances")
    remove(blocks)
    own = space.points.join(found, "point", "left").select("vector", "k_distance")
    return space.rows.join(own, "vector").select("id", "k_distance")


def density_clusters(df: DataFrame, key: str, vector: str, eps: float, least: int) -> DataFrame:
    """id, core, cluster: clusters of dense points (DBSCAN).

    A row is core if at least `least` rows, itself included, are within eps. Core rows within eps of each other share a cluster, named
    by its least core id; other rows within eps of a core row join the cluster with the least name among those; the rest are noise (null).
    A pair of blocks sends back links between its groups of linked points, not its pairs.
    """
    space = Space(df, key, vector)
    points = space.points.withColumn("label", F.col("point"))
    blocks = written_once(space.blocks(points), "blocks")
    dense = written_once(_dense(space, blocks, eps, least), "dense")
    remove(blocks)
    core = written_once(space.blocks(points.join(dense, "point", "left_semi")), "core")
    reach = lambda x, weights, far: np.full(len(x), eps)
    links = space.meet(space.visits(core, reach), core, _spanning, "a long, b long")
    named = written_once(components(links, "a", "b").select(F.col("node").alias("point"), F.col("component").alias("label")), "named")
    cores = written_once(space.blocks(space.points.join(named, "point")), "named-core")
    rest = space.blocks(points.join(dense, "point", "left_anti"))

    def least_label(ids, far, others, weights, labels):
        names = np.where(np.isfinite(far), labels[None, :], np.iinfo(np.int64).max).min(axis=1)
        at = np.flatnonzero(np.isfinite(far).any(axis=1))
        return [pa.array(ids[at]), pa.array(names[at])]

    border = space.meet(space.visits(rest, reach), cores, least_label, "point long, label long").groupBy("point").agg(F.min("label").alias("label"))
    labelled = written_once(named.withColumn("core", F.lit(True)).unionByName(border.withColumn("core", F.lit(False))), "labelled")
    remove(core, cores, dense, named)
    own = space.points.join(labelled, "point", "left").select("vector", F.coalesce("core", F.lit(False)).alias("core"), F.col("label").alias("cluster"))
    return space.rows.join(own, "vector").select("id", "core", "cluster")


def _dense(space: Space, blocks: DataFrame, eps: float, least: int) -> DataFrame:
    """Points with at least `least` rows within eps: counts of each pair of blocks, added up."""

    def count(ids, far, others, weights, labels):
        return [pa.array(ids), pa.array(np.isfinite(far) @ weights)]

    near = space.meet(space.visits(blocks, lambda x, weights, far: np.full(len(x), eps)), blocks, count, "point long, n long")
    return near.groupBy("point").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("point")


def _spanning(ids, far, others, weights, labels):
    """Links from each point to the least point of its group in this pair of blocks: as many as points, not as pairs."""
    near = np.isfinite(far)
    q, p = ids.copy(), np.where(near.any(axis=0), others, np.iinfo(np.int64).max)
    while True:
        new_p = np.minimum(p, np.where(near, q[:, None], np.iinfo(np.int64).max).min(axis=0))
        new_q = np.minimum(q, np.where(near, new_p[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new_p == p).all() and (new_q == q).all():
            break
        p, q = new_p, new_q
    at = near.any(axis=0)
    return [pa.array(np.concatenate([ids, others[at]])), pa.array(np.concatenate([q, p[at]]))]
