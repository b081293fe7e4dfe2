"""Operator 3: exact top-k by inner product with a three-phase uniform threshold.

Components become integers floor(256 x), so scores are exact. Vectors lie in blocks of
candidates and blocks of queries, and each query block meets each candidate block once
a phase, by an equi-join on the candidate block's number: the contract asks for every pair to be
weighed. The components form `PARTS` lists, whose partial scores are summed by the whole.

1. Each block gives, for each query, the k largest partial scores of each list; only these entries get
   whole scores. The k-th best whole score a query gets from all blocks is a safe cutoff.
2. The cutoff goes out with the query blocks. Some part of a vector that reaches cutoff t
   has at least t / PARTS, so each block collects the entries with such a part and no others.
3. The whole scores of the collected entries are resolved exactly; those under the cutoff go, and of a block's
   rest only its k best can matter. The k best over all blocks are the result.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor do rows without
vec_id. Vectors of different lengths meet in the components that both have; others count as 0. Ties go to
the smaller vec_id. With repeated vec_ids a query leaves out all rows of its own id and counts others once
a row; of a query's own rows, the least vector asks. Scores that don't fit a long are ranked exactly and written as
the nearest long. An empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut, keep, scratched

#: With few lists an entry that reaches the cutoff stands out in one of them.
PARTS = 2
#: Vectors in a block, and components in a block of candidates; long vectors lie in blocks of fewer.
CANDIDATE_BLOCK, QUERY_BLOCK, COMPONENTS = 8192, 256, 1 << 19
LONG = (-(1 << 63), (1 << 63) - 1)
#: `beyond` ranks scores outside of the longs; null for the others.
ENTRY = "query_id long, vec_id long, score long, beyond binary"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and components as doubles, without unusable rows."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("vector"))


def _width_class(vector: Column) -> Column:
    """Lengths in powers of two, at most 33 classes; vectors of a class lie in blocks together, padded to its longest."""
    return F.ceil(F.log2(F.greatest(F.size(vector), F.lit(1)))).cast("int")


def _blocks(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """Blocks of about `size` vectors of alike lengths (number, ids and flat components), and how many numbers there are."""
    classes = rows.groupBy(_width_class(F.col("vector")).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).orderBy("class").collect()  # at most 33 rows
    number, width, blocks = F.lit(0), F.lit(0), 0
    for c in classes:
        mine = _width_class(F.col("vector")) == c["class"]
        n = max(1, -(-c.n // max(1, min(size, COMPONENTS // max(1, c.width)))))
        number = F.when(mine, F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n)).cast("int") + blocks).otherwise(number)
        width, blocks = F.when(mine, F.lit(c.width)).otherwise(width), blocks + n
    padded = F.concat("vector", F.array_repeat(F.lit(0.0), (F.col("width") - F.size("vector")).cast("int")))
    placed = rows.select(number.alias("block"), "vec_id", "vector", width.alias("width")).select("block", F.struct("vec_id", padded.alias("vector")).alias("row"))
    packed = placed.groupBy("block").agg(F.collect_list("row").alias("rows"))
    return cut(packed.select("block", F.col("rows.vec_id").alias("ids"), F.flatten("rows.vector").alias("flat")), name), blocks


def _matrix(batch: pa.RecordBatch, i: int, ids: str, flat: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a block, and floor(256 x) of its components as doubles; where 256 x leaves the doubles, as Python's integers."""
    own = batch.column(ids)[i].values.to_numpy()
    x = batch.column(flat)[i].values.to_numpy().reshape(len(own), -1)
    with np.errstate(over="ignore"):
        whole = np.floor(x * 256)
    return own, whole if np.isfinite(whole).all() else _exact(x)


def _exact(x: np.ndarray) -> np.ndarray:
    """floor(256 x) as Python's integers; doubles of 2**53 and more are integers themselves."""
    return np.array([[int(v) * 256 if abs(v) >= 2.0**53 else math.floor(v * 256) for v in row] for row in x.tolist()], object).reshape(x.shape)


def _integers(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def _small(x: np.ndarray, width: int) -> np.ndarray:
    """Which vectors are so small that sums of products with each other stay exact in doubles."""
    limit = math.sqrt(2.0**53 / max(1, width))
    return np.array([max(map(abs, row), default=0) <= limit for row in x.tolist()], bool) if x.dtype == object else np.abs(x).max(axis=1, initial=0) <= limit


def _resolve(q: np.ndarray, c: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Whole scores of single entries, in stretches of bounded memory."""
    step = max(1, (1 << 20) // max(1, q.shape[1]))
    return np.concatenate([np.einsum("ij,ij->i", q[row[i : i + step]], c[column[i : i + step]]) for i in range(0, len(row), step)]) if len(row) else np.zeros(0)


def _best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Of entries, those among the k best of their query: larger score first, then smaller id."""
    if score.dtype == object:
        order = np.array(sorted(range(len(score)), key=lambda i: (query[i], -score[i], ids[i])), np.int64)
    else:
        order = np.lexsort((ids, -score, query))
    place = np.arange(len(order)) - np.searchsorted(query[order], query[order], side="left")
    return order[place < k]


def _listed(q: np.ndarray, c: np.ndarray, own: np.ndarray, k: int, cutoff: np.ndarray | None) -> np.ndarray:
    """Phase 1 (no cutoff): the k largest entries of each list. Phase 2: entries with a part of at least cutoff / PARTS."""
    wanted = np.zeros(own.shape, bool)
    for cols in np.array_split(np.arange(q.shape[1]), PARTS):
        part = q[:, cols] @ c[:, cols].T
        if cutoff is None:
            part[own] = -np.inf
            top = np.argpartition(-part, min(k, part.shape[1]) - 1, axis=1)[:, :k]
            np.put_along_axis(wanted, top, True, axis=1)
        else:
            wanted |= PARTS * part >= cutoff[:, None]
    return wanted & ~own


def _entries(q_ids, q, ids, c, k: int, cutoff: np.ndarray | None):
    """Rows, columns and whole scores of the entries of one pair of blocks that may matter, and how many were resolved."""
    width = min(q.shape[1], c.shape[1])
    q, c = q[:, :width], c[:, :width]
    own = q_ids[:, None] == ids[None, :]
    small_q, small_c = _small(q, width), _small(c, width)
    rows, columns, scores, resolved = [], [], [], 0
    if small_q.any() and small_c.any():
        a, b = np.flatnonzero(small_q), np.flatnonzero(small_c)
        qs, cs = q[a].astype(float), c[b].astype(float)
        row, column = np.nonzero(_listed(qs, cs, own[np.ix_(a, b)], k, None if cutoff is None else cutoff[a]))
        score = _resolve(qs, cs, row, column)
        resolved = len(row)
        if cutoff is not None:
            reach = score >= cutoff[a][row]
            row, column, score = row[reach], column[reach], score[reach]
        rows.append(a[row]), columns.append(b[column]), scores.append(score)
    if not (small_q.all() and small_c.all()):  # large vectors are few: their entries are all resolved, in Python's integers
        row, column = np.nonzero(~own & ~(small_q[:, None] & small_c[None, :]))
        qi, ci = ({i: _integers(x[i : i + 1])[0] for i in set(at.tolist())} for x, at in ((q, row), (c, column)))
        exact = [int(np.dot(qi[i], ci[j])) for i, j in zip(row.tolist(), column.tolist(), strict=True)]
        resolved += len(exact)
        scores = [np.array([int(x) for x in s.tolist()], object) for s in scores]
        rows.append(row), columns.append(column), scores.append(np.array(exact, object))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(scores), resolved


def _beyond(score: int) -> bytes | None:
    """Bytes in the order of the integers, for those that a long can't hold (and its least)."""
    if LONG[0] < score <= LONG[1]:
        return None
    n = abs(score)
    size = (n.bit_length() + 7) // 8
    raw = size.to_bytes(4) + n.to_bytes(size)
    return b"\1" + raw if score > 0 else b"\0" + bytes(255 - x for x in raw)


def _search(pairs: DataFrame, k: int, phase: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q = _matrix(batch, i, "q_ids", "q_flat")
                ids, c = _matrix(batch, i, "ids", "flat")
                # no cutoff, or one that a long can't hold, lets everything through
                cutoff = None if phase == 1 else np.array([-np.inf if x is None or x == LONG[0] else np.nextafter(float(x), -np.inf) for x in batch.column("cutoff")[i].as_py()], float)
                row, column, score, _ = _entries(q_ids, q, ids, c, k, cutoff)
                best = _best(row, score, ids[column], k)
                row, column, score = row[best], column[best], score[best]
                beyond = [_beyond(x) for x in score] if score.dtype == object else [None] * len(score)
                held = [min(max(x, LONG[0]), LONG[1]) for x in score] if score.dtype == object else score.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[row], pa.int64()), pa.array(ids[column], pa.int64()), pa.array(held, pa.int64()), pa.array(beyond, pa.binary())], ["query_id", "vec_id", "score", "beyond"])

    return pairs.mapInArrow(run, ENTRY)


def _met(blocks: DataFrame, candidates: DataFrame, numbers: int, *columns: str) -> DataFrame:
    """Each query block with each candidate block, from a shuffle: the copies of the query blocks outgrow any estimate of their size, so none are broadcast."""
    spread = blocks.select(F.col("block").alias("q_block"), F.explode(F.sequence(F.lit(0), F.lit(max(1, numbers) - 1))).alias("block"), F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat"), *columns)
    return spread.hint("merge").join(candidates, "block")


@scratched
def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of `vectors` (vec_id, embedding) for each row of `queries`."""
    asked = usable(queries).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    (candidates, numbers), (blocks, _) = _blocks(usable(vectors), CANDIDATE_BLOCK, "candidates"), _blocks(asked, QUERY_BLOCK, "queries")
    first = _search(_met(blocks, candidates, numbers), k, 1)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("beyond"), "vec_id")
    cutoff = cut(first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query_id", F.col("score").alias("cutoff")), "cutoff")
    # the cutoffs in the order of a block's ids; a query with fewer than k candidates has none
    each = blocks.select("block", F.posexplode("ids").alias("pos", "query_id")).join(cutoff.hint("merge"), "query_id", "left")
    told = each.groupBy("block").agg(F.expr("transform(array_sort(collect_list(struct(pos, cutoff))), x -> x.cutoff)").alias("cutoff"))
    second = _search(_met(blocks.join(told.hint("merge"), "block"), candidates, numbers, "cutoff"), k, 2)
    ranked = second.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    out = cut(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "ranked")
    keep(out)
    return out
