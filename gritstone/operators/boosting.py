"""Boosted trees for quantiles and for probabilities, grown by histograms, kept as a table of nodes; exact contributions of features.

A row adds, for each model and feature, its gradient to the bin of its value. Every task sums its rows into one histogram of a size that rows don't change, Spark sums these, and the
driver picks cuts from one histogram of models x nodes x features x bins. Targets and scores are integers (thousandths), so that sums don't depend on order and a fit
is the same on any cluster. Each pass reads the table anew and scores rows with the trees so far: no state lies between passes, and lost tasks repeat only their own share. A fit takes
depth + 1 passes a tree, so a table that is costly to make should be written first.

Rows whose target is NULL, NaN or infinite, or for probabilities neither 0 nor 1, aren't learned from. NULL and NaN features lie below every cut, so they go left. Repeated rows count as often as they
are there. An empty table gives trees of one leaf of value 0. Columns of the table keep their names and pass as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Thousandths: the unit of targets and scores.
UNIT = 1000
#: The model name of probabilities; quantiles are named by their percent.
LOGIT = "logit"
NODES = "model string, tree int, node long, size long, feature int, cut double, value long"
#: Nodes that a driver and every task may hold, cells of the histogram of a pass.
MOST_NODES, MOST_CELLS = 1_000_000, 20_000_000


@dataclass
class _Tree:
    """Nodes by number (root 1, children 2k below the cut and 2k + 1): size, feature or None, cut, value."""

    size: dict[int, int] = field(default_factory=dict)
    split: dict[int, tuple[int, float]] = field(default_factory=dict)
    value: dict[int, int] = field(default_factory=dict)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.ones(len(x), dtype=np.int64)
        for node, (f, cut) in sorted(self.split.items()):  # parents have smaller numbers
            here = np.flatnonzero(at == node)
            at[here] = 2 * node + (x[here, f] >= cut)
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        leaves = self.leaf_of(x)
        out = np.zeros(len(x), dtype=np.int64)
        for node, value in self.value.items():
            out[leaves == node] = value
        return out


def cuts(df: DataFrame, features: list[str], bins: int = 64) -> list[list[float]]:
    """At most bins - 1 cuts a feature, at its quantiles over all rows (Spark's mergeable sketch)."""
    at = [(i + 1) / bins for i in range(bins - 1)]
    cols = [F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"x{i}") for i, c in enumerate(features)]
    found = df.select(*cols).agg(*(F.percentile_approx(f"x{i}", at, 10_000).alias(f"x{i}") for i in range(len(features)))).first()
    return [sorted(set(q or [])) for q in found]


def fit(df: DataFrame, target: str, features: list[str], at: list[list[float]], models: list[int | str], trees: int = 20, depth: int = 3, shrink: int = 4, least: int = 20) -> DataFrame:
    """Nodes of one model for each of `models`: the percent of a quantile of `target`, or LOGIT for the probability that it is 1.

    Tree 0 is one leaf, the quantile or log-odds step of all rows; each later tree is fitted to what the trees before it leave, with leaf values divided by `shrink`. A cut leaves `least` rows or
    more on either side; of equal gains the first feature and lowest cut count. A quantile's leaf is the exact quantile of its residuals: they travel as counts of distinct
    thousandths, bounded by the target's range and not by rows.
    """
    names = [str(m) for m in models]
    if len(set(names)) < len(names) or any(n != LOGIT and not 0 < int(n) < 100 for n in names):
        raise ValueError("models are different percents from 1 to 99, or LOGIT")
    width = max((len(c) for c in at), default=0) + 1
    if len(names) * 2**depth * len(features) * width > MOST_CELLS:
        raise ValueError(f"a histogram of more than {MOST_CELLS} cells: fewer models, levels, features or bins")
    data = df.select(F.col(target).cast("double").alias("y"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)))
    grown: dict[str, list[_Tree]] = {n: [] for n in names}
    for number in range(trees + 1):
        new = {n: _Tree() for n in names}
        totals: dict[tuple[str, int], np.ndarray] = {}
        open_ = [(n, 1) for n in names]
        for level in range(depth if number else 1):
            sums = _histogram(data, at, width, grown, new, open_)
            for i, (n, node) in enumerate(open_):
                if level == 0:
                    totals[n, 1] = sums[i, 0].sum(axis=0)
                    new[n].size[1] = int(totals[n, 1][0])
                found = _best(sums[i], at, least) if number else None
                if found:
                    f, k, sides = found
                    new[n].split[node] = (f, at[f][k])
                    for child, side in zip((2 * node, 2 * node + 1), sides, strict=True):
                        totals[n, child], new[n].size[child] = side, int(side[0])
            open_ = [(n, c) for n, node in open_ if node in new[n].split for c in (2 * node, 2 * node + 1)]
            if not open_:
                break
        middles = _residuals(data, at, grown, new, [n for n in names if n != LOGIT])
        for n in names:
            for node in new[n].size.keys() - new[n].split.keys():
                _, g, h = (int(v) for v in totals[n, node])
                whole = middles.get((n, node), 0) if n != LOGIT else UNIT * g / (h + 1_000_000)
                new[n].value[node] = math.floor(whole / (shrink if number else 1))
            grown[n].append(new[n])
    rows = [(n, t, node, size, *tree.split.get(node, (None, None)), tree.value.get(node)) for n in names for t, tree in enumerate(grown[n]) for node, size in sorted(tree.size.items())]
    return df.sparkSession.createDataFrame(rows, NODES)


def predict(df: DataFrame, nodes: DataFrame, features: list[str], models: list[int | str], name: str = "predicted") -> DataFrame:
    """Adds `name`: an array with each model's value, a quantile in the target's unit or a probability."""
    held, order = _held(nodes), [str(m) for m in models]

    @F.pandas_udf("array<double>")
    def scored(*values: pd.Series) -> pd.Series:
        x = _matrix(values)
        out = [sum((t.score(x) for t in held.value[m]), np.zeros(len(x), dtype=np.int64)) / UNIT for m in order]
        out = [1 / (1 + np.exp(-v)) if m == LOGIT else v for m, v in zip(order, out, strict=True)]
        return pd.Series(list(np.column_stack(out)))

    return df.withColumn(name, scored(*(F.col(c).cast("double") for c in features)))


def contributions(df: DataFrame, nodes: DataFrame, features: list[str], model: int | str, name: str = "parts", base: str = "base") -> DataFrame:
    """Adds `base`, the model's mean score over the rows it learned from, and `name`, each feature's Shapley value in the score (log-odds for LOGIT), in the order of `features`.

    Base and parts sum to the score. A feature that is left out takes both sides of its cuts by their shares of the rows. The work is rows x leaves x depth squared.
    """
    held, own = _held(nodes), str(model)

    @F.pandas_udf("array<double>")
    def shared(*values: pd.Series) -> pd.Series:
        x = _matrix(values)
        out = np.zeros((len(x), len(values)))
        for tree in held.value[own]:
            for value, _, path in _paths(tree):
                _share(out, x, value, path)
        return pd.Series(list(out / UNIT))

    mean = math.fsum(value * share for tree in held.value[own] for value, share, _ in _paths(tree)) / UNIT
    return df.withColumns({base: F.lit(mean), name: shared(*(F.col(c).cast("double") for c in features))})


def _matrix(values: tuple[pd.Series, ...]) -> np.ndarray:
    x = np.column_stack([v.to_numpy(dtype=float) for v in values])
    return np.where(np.isnan(x), -np.inf, x)


def _held(nodes: DataFrame):
    rows = nodes.limit(MOST_NODES + 1).collect()
    if len(rows) > MOST_NODES:
        raise ValueError(f"more than {MOST_NODES} nodes")
    models: dict[str, dict[int, _Tree]] = {}
    for r in rows:
        tree = models.setdefault(r.model, {}).setdefault(r.tree, _Tree())
        tree.size[r.node] = r.size
        if r.feature is None:
            tree.value[r.node] = r.value
        else:
            tree.split[r.node] = (r.feature, r.cut)
    return nodes.sparkSession.sparkContext.broadcast({m: [t for _, t in sorted(ts.items())] for m, ts in models.items()})


def _learned(frame: pd.DataFrame, grown: dict[str, list[_Tree]]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Features, targets in thousandths and scores so far of the rows that count."""
    y = frame["y"].to_numpy(dtype=float)
    good = np.isfinite(y) & (np.isin(y, (0.0, 1.0)) if LOGIT in grown else True)
    x, y = _matrix(tuple(frame[c] for c in frame.columns[1:]))[good], y[good]
    return x, np.floor(y * UNIT).astype(np.int64), {m: sum((t.score(x) for t in trees), np.zeros(len(x), dtype=np.int64)) for m, trees in grown.items()}


def _gradients(model: str, y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integer gradients and curvatures: percents of the quantile's loss, millionths of the probability's."""
    if model != LOGIT:
        return np.where(y > score, int(model), int(model) - 100), np.ones(len(y), dtype=np.int64)
    p = np.floor(1e6 / (1 + np.exp(-score / UNIT))).astype(np.int64)
    return y // UNIT * 1_000_000 - p, p * (1_000_000 - p) // 1_000_000


def _histogram(data: DataFrame, at: list[list[float]], width: int, grown: dict, new: dict, open_: list[tuple[str, int]]) -> np.ndarray:
    """Rows, gradients and curvatures by open node, feature and bin; one partial histogram a task."""
    shape = (len(open_), len(at), width, 3)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(shape, dtype=np.int64)
        for frame in frames:
            x, y, scores = _learned(frame, grown)
            bins = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(at)]
            for i, (m, node) in enumerate(open_):
                here = np.flatnonzero(new[m].leaf_of(x) == node)
                g, h = _gradients(m, y[here], scores[m][here])
                for f, b in enumerate(bins):
                    for k, v in enumerate((None, g, h)):
                        sums[i, f, :, k] += np.bincount(b[here], v, width).astype(np.int64)  # a batch's sums are exact in doubles
        cell = np.flatnonzero(sums.reshape(-1, 3)[:, 0])
        yield pd.DataFrame({"cell": cell, **{c: sums.reshape(-1, 3)[cell, k] for k, c in enumerate("ngh")}})

    found = data.mapInPandas(partial, "cell long, n long, g long, h long").groupBy("cell").agg(*(F.sum(c).alias(c) for c in "ngh")).toPandas()
    sums = np.zeros((math.prod(shape[:3]), 3), dtype=np.int64)
    sums[found["cell"].to_numpy(dtype=np.int64)] = found[list("ngh")].to_numpy(dtype=np.int64)
    return sums.reshape(shape)


def _best(sums: np.ndarray, at: list[list[float]], least: int) -> tuple[int, int, tuple[np.ndarray, np.ndarray]] | None:
    """The feature and cut of the greatest positive gain, with the sums of both sides."""
    whole, best = sums[0].sum(axis=0), None
    gain_of = lambda s: float(s[1]) * float(s[1]) / float(max(s[2], 1))
    for f, edges in enumerate(at):
        under = sums[f].cumsum(axis=0)
        for k in range(len(edges)):
            left, right = under[k], whole - under[k]
            if min(left[0], right[0]) < least:
                continue
            gain = gain_of(left) + gain_of(right) - gain_of(whole)
            if gain > (best[0] if best else 0.0):
                best = (gain, f, k, (left, right))
    return best[1:] if best else None


def _residuals(data: DataFrame, at: list[list[float]], grown: dict, new: dict, models: list[str]) -> dict[tuple[str, int], int]:
    """The quantile of the residuals in each leaf of the new trees."""
    if not models:
        return {}

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x, y, scores = _learned(frame, grown)
            for m in models:
                pairs, n = np.unique(np.column_stack([new[m].leaf_of(x), y - scores[m]]), axis=0, return_counts=True)
                yield pd.DataFrame({"model": m, "node": pairs[:, 0], "residual": pairs[:, 1], "n": n})

    counts = data.mapInPandas(counted, "model string, node long, residual long, n long").groupBy("model", "node", "residual").agg(F.sum("n").alias("n"))
    leaf = Window.partitionBy("model", "node")
    upto = counts.withColumns({"upto": F.sum("n").over(leaf.orderBy("residual")), "all": F.sum("n").over(leaf)})
    rank = F.floor((F.col("model").cast("long") * F.col("all") + 99) / 100)  # the ceiling of the percent of all
    return {(r.model, r.node): r.at for r in upto.where(F.col("upto") >= rank).groupBy("model", "node").agg(F.min("residual").alias("at")).collect()}


def _paths(tree: _Tree) -> Iterator[tuple[int, float, dict[int, tuple[float, float, float]]]]:
    """Each leaf's value, its share of the rows and its path: for each feature the range of values that goes there and the share of rows that did."""
    open_ = [(1, 1.0, {})]
    while open_:
        node, share, path = open_.pop()
        if node not in tree.split:
            yield tree.value[node], share, path
            continue
        f, cut = tree.split[node]
        low, high, kept = path.get(f, (-np.inf, np.inf, 1.0))
        for child, lo, hi in ((2 * node, low, min(high, cut)), (2 * node + 1, max(low, cut), high)):
            part = tree.size[child] / tree.size[node]
            open_.append((child, share * part, {**path, f: (lo, hi, kept * part)}))


def _share(out: np.ndarray, x: np.ndarray, value: int, path: dict[int, tuple[float, float, float]]) -> None:
    """Adds a leaf's Shapley values: the mean over all orders of features of what each adds when it becomes known."""
    m = len(path)
    inside = {f: ((x[:, f] >= lo) & ((x[:, f] < hi) | (hi == np.inf))).astype(float) for f, (lo, hi, _) in path.items()}
    for f, (_, _, part) in path.items():
        known = [np.ones(len(x))]  # by the number of known features: the sum, over their choices, of the chance to come here
        for o in path.keys() - {f}:
            known = [a * path[o][2] + b * inside[o] for a, b in zip([*known, 0.0], [0.0, *known], strict=True)]
        weight = sum(k / (m * math.comb(m - 1, s)) for s, k in enumerate(known))
        out[:, f] += value * (inside[f] - part) * weight
