"""Vectors on the integer lattice, for operators whose results must be exact: components, distances, sums.

Components are int64 where all of a row are small enough that distances are exact in int64 and doubles, else Python's integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Exact sums travel as limbs of so many bits, each in a long: sums of limbs over any number of tasks don't overflow.
BITS = 31
LONG = (1 << 63) - 1


def finite(vector: Column) -> Column:
    """Whether a vector of doubles is there and none of its components is null or non-finite."""
    return vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))


def limit(width: int) -> int:
    """Components up to this size have squared distances whose terms are exact in doubles."""
    return math.isqrt((1 << 53) // (4 * max(1, width)))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles; shorter rows are filled with zeros."""
    lengths = np.diff(np.asarray(column.offsets))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def on_lattice(x: np.ndarray, scale: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(scale x), scale a power of two: int64 rows (0 where a row is not small), which rows are small, and the others as Python's integers."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    small = (np.abs(y) <= most).all(axis=1)
    large = np.array([[int(v) * scale if abs(v) >= 2.0**53 else math.floor(v * scale) for v in row] for row in x[~small].tolist()], object).reshape(-1, x.shape[1])
    return np.where(small[:, None], y, 0).astype(np.int64), small, large


def table(rows: list[list[int]], width: int, most: int) -> np.ndarray:
    """Python's integers as int64 if all are small."""
    out = np.array(rows, object).reshape(-1, width)
    return out.astype(np.int64) if all(abs(v) <= most for r in rows for v in r) else out


def apart(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances between rows of two equally long tables."""
    if x.dtype != object and c.dtype != object:
        return ((x - c) ** 2).sum(axis=1)
    return np.array([sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)) for p, q in zip(x.tolist(), c.tolist(), strict=True)], object)


def intervals(x: np.ndarray, c: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of |c|^2 - 2 x.c, which orders the centroids of a row as their distances do, from one matrix product in `kind`.

    A product of n terms errs by at most g |x| |c| with g = m u / (1 - m u), in any order of summation, where m = n + 4 also
    covers the rounding of the components and u is half a unit in the last place of `kind`; the slack covers what is rounded in doubles after it.
    """
    xf, cf = x.astype(kind), c.astype(kind)
    u = float(np.finfo(kind).eps) / 2
    m = x.shape[1] + 4
    g = m * u / (1 - m * u)
    nx, nc = (np.sqrt((t.astype(float) ** 2).sum(axis=1)) * (1 + 1e-12 * m) for t in (xf, cf))
    c2 = np.array([float(sum(int(v) ** 2 for v in row)) for row in c.tolist()])
    reach = nx[:, None] * nc[None, :]
    mid = c2[None, :] - 2.0 * (xf @ cf.T).astype(float)
    err = 2.0 * g * reach + 2.0**-48 * (c2[None, :] + 2.0 * reach)
    return mid - err, mid + err


def nearest(x: np.ndarray, c: np.ndarray, counts: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The nearest row of `c` for each row of `x`, ties to the lowest number, and its exact squared distance.

    Intervals in single precision leave one centroid for most rows; where they overlap, exact distances decide. Large integers are
    screened in doubles, and integers beyond doubles not at all.
    """
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    exact = x.dtype != object and c.dtype != object
    top = 0 if exact else max(abs(int(v)) for t in (x, c) if t.dtype == object for row in t.tolist() for v in row)
    if top < 1 << 400:
        low, high = intervals(x, c, np.float32 if exact else np.float64)
        maybe = low <= high.min(axis=1)[:, None]
    else:
        maybe = np.ones((len(x), len(c)), bool)
    at = maybe.argmax(axis=1)
    open_ = np.flatnonzero(maybe.sum(axis=1) > 1)
    if counts is not None:
        counts["rows"], counts["open"] = counts.get("rows", 0) + len(x), counts.get("open", 0) + len(open_)
    if len(open_):
        row, column = np.nonzero(maybe[open_])
        d = apart(x[open_[row]], c[column])
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        if d.dtype == object:
            for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(row)], strict=True)):
                at[open_[i]] = column[min(range(a, b), key=lambda j: (d[j], column[j]))]
        else:
            least = np.minimum.reduceat(d, starts)
            hit = np.flatnonzero(d == least[row])  # columns ascend, so a row's first hit is the lowest number
            first = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]
            at[open_] = column[first]
    return at, apart(x, c[at])


class Sums:
    """Exact sums of rows by group, and how many rows each has (the last column)."""

    def __init__(self, groups: int, width: int) -> None:
        self.total = np.zeros((groups, width + 1), object)

    def add(self, group: np.ndarray, x: np.ndarray) -> None:
        ones = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
        if x.dtype == object:
            for g, row in zip(group.tolist(), ones, strict=True):
                self.total[g] += row
            return
        for i in range(0, len(x), 8192):  # sums of so many small components are exact in doubles
            pick = np.zeros((len(self.total), len(group[i : i + 8192])))
            pick[group[i : i + 8192], np.arange(pick.shape[1])] = 1.0
            self.total += (pick @ ones[i : i + 8192].astype(float)).astype(np.int64).astype(object)

    def rows(self) -> Iterable[tuple[int, list[int]]]:
        """(group, limbs) of the groups with rows; limb l of column j stands at l * columns + j."""
        for g, row in enumerate(self.total):
            if row[-1]:
                yield g, limbs(row.tolist())


def limbs(values: list[int]) -> list[int]:
    out = []
    while True:
        if all(-(1 << BITS) <= v < 1 << BITS for v in values):
            return out + values
        out += [v & (1 << BITS) - 1 for v in values]
        values = [v >> BITS for v in values]


def totals(partial: DataFrame, keys: list[str], width: int) -> dict[tuple, list[int]]:
    """Sums of the limbs of all tasks by key, added up in Spark: one short list for each of the model's entries."""
    found = partial.select(*keys, F.posexplode("limbs").alias("pos", "limb")).groupBy(*keys, "pos").agg(F.sum("limb").alias("limb")).collect()  # entries x components x limbs
    out: dict[tuple, list[int]] = {}
    for r in found:
        values = out.setdefault(tuple(r[k] for k in keys), [0] * (width + 1))
        values[r.pos % (width + 1)] += r.limb << BITS * (r.pos // (width + 1))
    return out


def means(old: list[list[int]], sums: dict[int, list[int]]) -> list[list[int]]:
    """floor(sum / count) of each entry's rows; entries without rows stay."""
    return [[v // sums[i][-1] for v in sums[i][:-1]] if i in sums else row for i, row in enumerate(old)]


def as_long(values: np.ndarray) -> pa.Array:
    """Distances as longs; what is beyond a long becomes the largest."""
    return pa.array([min(v, LONG) for v in values.tolist()] if values.dtype == object else values, pa.int64())


def capped(total: Column) -> Column:
    """A sum of such longs, in decimals, as a long: where one of them or the sum is beyond, both are the largest."""
    return F.least(total, F.lit(str(LONG)).cast("decimal(38,0)")).cast("long")
