"""Connected components of a graph that is given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import remove, written_once


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node and component (its least node) of every node of an edge; nodes are numbers or strings.

    Two steps by turns until nothing changes: larger neighbours move to the least neighbour (large star), then
    smaller ones (small star). Each step is a grouped minimum and a join with it, so a node of many edges is never gathered in one
    task, and the rounds grow with the logarithm of the longest path. Each round is a table in the shared folder. Edges with a null are left out.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    state = written_once(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(state.where("u = v"))
        down = large.where("v < u").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = written_once(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).unionByName(state.where("u = v")).distinct(), "edges")
        remove(state)
        state = after
        now = state.where("u <> v").agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    # every node is an edge's larger end by now, or a component's least
    ends = state.where("u <> v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    tops = state.select(F.col("v").alias("node")).distinct().join(ends.select("node"), "node", "left_anti")
    return ends.unionByName(tops.select("node", F.col("node").alias("component")))
