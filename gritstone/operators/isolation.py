"""Isolation forests: trees from bounded samples, kept as a table of nodes, scores of all rows in batches.

A row that random cuts part from the others after few steps is unusual. Nothing here is drawn at run time: samples and cuts come from digests of row ids and node
numbers, so a forest is the same on every run and any cluster.

Nulls, NaN and infinities in features count as 0. Rows with a NULL group are not sampled and have a NULL score; so have rows of groups without a
forest. Repeated rows are rows of their own; a group of equal rows gets trees of one leaf and scores of 0.5. Columns of the table keep their names and pass as they are.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Defaults: trees of a forest, rows a tree.
TREES, SAMPLE = 100, 256
#: Nodes of all forests together that a driver and every task may hold (28 bytes each).
MOST_NODES = 8_000_000


def picked(df: DataFrame, group: str, row_id: str, features: list[str], trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """The rows that a forest may see: the first trees * sample of each group in the order of the digests of their ids.

    Ids are expected to be unique. Spark keeps only so many rows a group and task before it shuffles.
    """
    order = Window.partitionBy("grp").orderBy(F.md5(F.col("id").cast("string")), "id")
    rows = df.where(F.col(group).isNotNull()).select(F.col(group).cast("string").alias("grp"), F.col(row_id).alias("id"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= trees * sample)


def grow(rows: DataFrame, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """The nodes of one forest a group, from `picked` rows: grp, tree, node, size, feature, threshold.

    The root is node 1, the children of k are 2k (values under the threshold) and 2k + 1; leaves have no feature. Rows are dealt to trees in turn; where there are fewer than trees * sample,
    each goes to as many trees as it takes to fill them. A tree is one task's work on `sample` rows at most.
    """
    xs = [c for c in rows.columns if c.startswith("x")]
    counts = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    copies = F.least(F.lit(trees), F.greatest(F.lit(1), F.floor(F.lit(trees * sample) / F.col("n"))))
    dealt = rows.join(counts, "grp").withColumn("c", F.explode(F.sequence(F.lit(0), copies.cast("int") - 1)))
    dealt = dealt.select("grp", ((F.col("rank") - 1 + F.col("c")) % trees).cast("int").alias("tree"), *xs)
    deepest = math.ceil(math.log2(max(sample, 2)))

    def tree(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        nodes = _nodes(f"{key[0]}:{key[1]}", _finite(frame[xs].to_numpy(dtype=float)), deepest)
        return pd.DataFrame({"grp": key[0], "tree": key[1], **{c: [n[i] for n in nodes] for i, c in enumerate(("node", "size", "feature", "threshold"))}})

    return dealt.groupBy("grp", "tree").applyInPandas(tree, "grp string, tree int, node long, size long, feature int, threshold double")


def score(df: DataFrame, forest: DataFrame, group: str, features: list[str], name: str = "score") -> DataFrame:
    """Adds `name`: 0 to 1, higher for rows that are parted sooner, from the mean length of their paths.

    The node table is bounded by groups, trees and samples, not by rows; every task holds it. A frame with more than `MOST_NODES` nodes is refused.
    """
    spark = df.sparkSession
    nodes = forest.limit(MOST_NODES + 1).toPandas()
    if len(nodes) > MOST_NODES:
        raise ValueError(f"a forest of more than {MOST_NODES} nodes: fewer groups, trees or rows a tree")
    held = spark.sparkContext.broadcast(_arrays(nodes))

    @F.pandas_udf("double")
    def scored(key: pd.Series, *values: pd.Series) -> pd.Series:
        x = _finite(np.column_stack([v.to_numpy(dtype=float) for v in values]))
        out = np.full(len(key), np.nan)
        for g, (trees, whole) in ((g, held.value[g]) for g in key.dropna().unique() if g in held.value):
            rows = np.flatnonzero((key == g).to_numpy())
            out[rows] = 2 ** -(_lengths(x[rows], trees) / whole) if whole else 0.5
        return pd.Series(out)

    return df.withColumn(name, scored(F.col(group).cast("string"), *(F.col(c).cast("double") for c in features)))


def limits(rows: DataFrame, forest: DataFrame, share: float = 0.03) -> DataFrame:
    """grp and score_limit: the score that a `share` of the group's `picked` rows exceed; a row above it is flagged."""
    xs = [c for c in rows.columns if c.startswith("x")]
    return score(rows, forest, "grp", xs).groupBy("grp").agg(F.percentile("score", F.lit(1 - share)).alias("score_limit"))


def path_length(n: int) -> float:
    """The mean number of cuts that part a row from n - 1 others in a random tree."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def draw(*parts: object) -> int:
    """A number under 2**32 that follows from the parts."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def _finite(x: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(x), x, 0.0)


def _nodes(seed: str, x: np.ndarray, deepest: int) -> list[tuple]:
    """The nodes of a tree over the rows of x; a cut is made in a feature that varies among the node's rows."""
    out, open_ = [], [(1, np.arange(len(x)))]
    while open_:
        node, rows = open_.pop()
        low, high = (x[rows].min(axis=0), x[rows].max(axis=0)) if len(rows) else (np.zeros(0), np.zeros(0))
        varying = np.flatnonzero(high > low)
        if not len(varying) or node >> deepest:
            out.append((node, len(rows), None, None))
            continue
        f = int(varying[draw(seed, node, "f") % len(varying)])
        cut = float(low[f] + (high[f] - low[f]) * ((draw(seed, node, "t") + 0.5) / 2**32))
        out.append((node, len(rows), f, cut))
        under = x[rows, f] < cut
        open_ += [(2 * node, rows[under]), (2 * node + 1, rows[~under])]  # the first is empty where rounding puts the cut on the lowest value
    return out


def _arrays(nodes: pd.DataFrame) -> dict[str, tuple[list[tuple], float]]:
    """For each group its trees as arrays by position, and the sum of the path lengths of whole samples."""
    forests: dict[str, list] = defaultdict(list)
    whole: dict[str, float] = defaultdict(float)
    for (g, _), t in nodes.sort_values(["grp", "tree", "node"]).groupby(["grp", "tree"], sort=False):
        node, size, leaf = t["node"].tolist(), t["size"].tolist(), t["feature"].isna().tolist()
        at = {n: i for i, n in enumerate(node)}
        child = [np.array([i if end else at[2 * n + side] for i, (n, end) in enumerate(zip(node, leaf, strict=True))]) for side in (0, 1)]
        depth = [n.bit_length() - 1 for n in node]
        length = np.array([d + path_length(n) for d, n in zip(depth, size, strict=True)])
        forests[g].append((t["feature"].fillna(0).to_numpy(dtype=int), t["threshold"].fillna(0.0).to_numpy(dtype=float), *child, length, max(depth)))
        whole[g] += path_length(size[0])
    return {g: (trees, whole[g]) for g, trees in forests.items()}


def _lengths(x: np.ndarray, trees: list[tuple]) -> np.ndarray:
    total, rows = np.zeros(len(x)), np.arange(len(x))
    for feature, threshold, left, right, length, steps in trees:
        at = np.zeros(len(x), dtype=int)
        for _ in range(steps):
            at = np.where(x[rows, feature[at]] < threshold[at], left[at], right[at])
        total += length[at]
    return total
