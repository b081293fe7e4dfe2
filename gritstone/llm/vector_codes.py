"""Operator 13: product codes of vectors; codebooks by Lloyd's rounds with group bounds (Yinyang), exact on integers.

Each vector is cut into equal parts, and each part position has a codebook. Its first entries are clustered into groups. A row carries, for each
part, its entry and one lower bound a group on the distance to the group's other entries. When the codebook has moved,
a group's bound falls by the largest move of its entries, rounded down; the exact distance to the row's own entry, rounded up, is its upper bound. Only groups whose
bound doesn't exceed it are scanned, with exact integer distances, ties to the lower index. Rows and bounds pass from round to round as a table in the
shared folder, written with the exact sums of each task, so a lost executor costs a re-read; the table before goes.

Edge cases: rows whose vector is null or holds null or non-finite components are left out. Vectors count as filled with zeros up to the longest
one's length, rounded up to whole parts. Components of any finite size count: rows or codebooks with large ones are
settled by `lattice.nearest` in Python's integers, and errors beyond a long are written as the largest long. Rows without vec_id begin an entry last; rows that repeat a vec_id or vector count each. With fewer than
256 vectors there are as many entries as vectors. An empty table gives an empty result. Columns besides vec_id, embedding and label are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lattice
from .frames import cut, discard, join_dealt, keep, scratched

#: Groups of a codebook; a bound is four bytes.
GROUPS = 16
STEP = 4096
STATE = "vec_id long, label string, vector array<double>, code binary, bounds binary, part int, entry int, limbs array<long>"


def usable(vectors: DataFrame) -> DataFrame:
    x = F.col("embedding")
    vector = x if dict(vectors.dtypes)["embedding"] == "array<float>" else x.cast("array<double>")
    label = F.concat(F.when(F.col("label").isNull(), "none").otherwise("is "), F.coalesce(F.col("label").cast("string"), F.lit("")))  # nulls are a label of their own
    return vectors.where(lattice.finite(x)).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), vector.alias("vector"))


def groups_of(book: np.ndarray, count: int = GROUPS) -> np.ndarray:
    """Group numbers of a codebook's entries: some rounds of k-means over at most 256 entries; the same for the same entries."""
    x = book.astype(float)
    centers = x[np.linspace(0, len(x) - 1, min(count, len(x))).astype(int)]
    for _ in range(5):
        at = ((x[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        centers = np.array([x[at == g].mean(axis=0) if (at == g).any() else centers[g] for g in range(len(centers))])
    return at


def _down(x: np.ndarray) -> np.ndarray:
    """Lower bounds in four bytes."""
    return np.nextafter((x * (1 - 1e-12)).astype(np.float32), np.float32(-1))


def moves(old: np.ndarray, new: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The largest move of a group's entries, rounded up."""
    moved = np.sqrt(((new - old).astype(float) ** 2).sum(axis=1)) * (1 + 1e-12)
    return np.array([moved[group == g].max(initial=0.0) for g in range(GROUPS)])


def full_scan(x: np.ndarray, book: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, squared distance, bounds) from all distances; integers so small that doubles are exact."""
    d = _distances(x, book)
    at = d.argmin(axis=1)
    rows = np.arange(len(x))
    best = d[rows, at]
    d[rows, at] = np.inf
    return at, best, _down(np.sqrt(np.stack([d[:, group == g].min(axis=1, initial=np.inf) for g in range(GROUPS)], axis=1)))


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    b = book.astype(float)
    return (x * x).sum(axis=1)[:, None] - 2.0 * (x @ b.T) + (b * b).sum(axis=1)[None, :]


def bounded_scan(x: np.ndarray, book: np.ndarray, group: np.ndarray, drift: np.ndarray, at: np.ndarray, bounds: np.ndarray, counts: dict | None = None):
    """The same from a row's entry and bounds of the round before: only groups whose bound fails are scanned."""
    own = ((x - book[at].astype(float)) ** 2).sum(axis=1)
    upper = np.sqrt(own) * (1 + 1e-12)
    lower = _down(np.maximum(bounds.astype(float) - drift[None, :], 0.0))
    new, best, second = at.copy(), own.copy(), np.full(len(x), np.inf)
    for g in range(GROUPS):
        members = np.flatnonzero(group == g)
        rows = np.flatnonzero(lower[:, g] <= upper)
        if not len(members) or not len(rows):
            continue
        if counts is not None:
            counts["scanned"] = counts.get("scanned", 0) + len(rows) * len(members)
        d = _distances(x[rows], book[members])
        d[members[None, :] == at[rows][:, None]] = np.inf
        least = d.argmin(axis=1)
        each = np.arange(len(rows))
        first = d[each, least]
        lower[rows, g] = _down(np.sqrt(first))
        better = (first < best[rows]) | (first == best[rows]) & (members[least] < new[rows])
        won = rows[better]
        d[each, least] = np.inf
        second[won] = d[better].min(axis=1, initial=np.inf)
        new[won], best[won] = members[least][better], first[better]
    changed = np.flatnonzero(new != at)
    lower[changed, group[new[changed]]] = _down(np.sqrt(second[changed]))
    left = group[at[changed]]  # the entry that a row has left is one of its group's others now
    lower[changed, left] = np.minimum(lower[changed, left], _down(np.sqrt(own[changed])))
    return new, best, lower


class Coder:
    """Codebooks of one round, and what is needed to carry bounds over from the round before."""

    def __init__(self, books: list[list[list[int]]], before: list[list[list[int]]] | None, groups: list[np.ndarray], width: int, scale: int) -> None:
        self.part, self.scale = width // len(books), scale
        most = lattice.limit(self.part)
        self.books = [lattice.table(b, self.part, most) for b in books]
        old = [lattice.table(b, self.part, most) for b in before or books]
        self.groups = groups
        #: Bounds hold on between codebooks of small integers only.
        self.drift = [moves(o, n, g) if before and o.dtype == n.dtype == np.int64 else None for o, n, g in zip(old, self.books, groups, strict=True)]

    def code(self, batch: pa.RecordBatch, sums: list[lattice.Sums] | None):
        """(codes, bounds, error) of a batch: rows x parts, rows x parts x groups, and exact sums of squared distances."""
        n, parts = batch.num_rows, len(self.books)
        flat = lattice.matrix(batch.column("vector"), self.part * parts)
        codes, bounds = np.zeros((n, parts), np.int64), np.zeros((n, parts, GROUPS), np.float32)
        error = np.zeros(n, object)
        had = "code" in batch.schema.names
        if had:
            old = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, parts)
            lower = np.frombuffer(b"".join(batch.column("bounds").to_pylist()), np.float32).reshape(n, parts, GROUPS)
        for p, (book, group, drift) in enumerate(zip(self.books, self.groups, self.drift, strict=True)):
            x, small, large = lattice.on_lattice(flat[:, p * self.part : (p + 1) * self.part], self.scale, lattice.limit(self.part))
            for i in range(0, n, STEP):
                rows = np.flatnonzero(small[i : i + STEP]) + i
                if not len(rows):
                    continue
                if book.dtype == object:
                    at, d = lattice.nearest(x[rows], book)
                elif had and drift is not None:
                    at, d, bounds[rows, p] = bounded_scan(x[rows].astype(float), book, group, drift, old[rows, p].astype(np.int64), lower[rows, p])
                else:
                    at, d, bounds[rows, p] = full_scan(x[rows].astype(float), book, group)
                self._take(sums, p, rows, at, d, x[rows], codes, error)
            rows = np.flatnonzero(~small)
            if len(rows):
                self._take(sums, p, rows, *lattice.nearest(large, book), large, codes, error)
        return codes, bounds, error

    def _take(self, sums, p, rows, at, d, x, codes, error) -> None:
        codes[rows, p] = at
        error[rows] += np.array([int(v) for v in d.tolist()], object)
        if sums is not None:
            sums[p].add(at, x)


def _round(rows: DataFrame, coder: Coder, vector: str) -> DataFrame:
    """Rows with new codes and bounds, and rows of sums (part, entry, limbs), which have no vector."""
    schema = STATE.replace("array<double>", vector)

    def run(batches):
        sums = [lattice.Sums(len(b), coder.part) for b in coder.books]
        for batch in batches:
            n = batch.num_rows
            codes, bounds, _ = coder.code(batch, sums)
            raw, low = codes.astype(np.uint8), bounds.reshape(n, -1)
            none = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("vec_id", "label", "vector")] + [pa.array([r.tobytes() for r in raw], pa.binary()), pa.array([r.tobytes() for r in low], pa.binary()), *none], names)
        found = [(p, e, x) for p, s in enumerate(sums) for e, x in s.rows()]
        kinds = [pa.int64(), pa.string(), pa.list_(pa.float32() if vector == "array<float>" else pa.float64()), pa.binary(), pa.binary()]
        told = [pa.array([p for p, _, _ in found], pa.int32()), pa.array([e for _, e, _ in found], pa.int32()), pa.array([x for _, _, x in found], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(found), k) for k in kinds] + told, names)

    names = [c.split(" ")[0] for c in STATE.split(", ")]
    return rows.mapInArrow(run, schema)


@scratched
def encode(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each usable row of `vectors` (vec_id, embedding, label).

    Components are floor(scale x), scale a power of two; codebooks begin as the parts of the vectors with the smallest vec_ids. At most 256 entries.
    """
    rows = usable(vectors)
    kind = dict(rows.dtypes)["vector"]
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    part = max(1, -(-longest // parts))
    width = part * parts
    first = rows.select("vec_id", "vector").orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()  # the codebooks' entries
    padded = np.array([[*r.vector, *[0.0] * (width - len(r.vector))] for r in first], float).reshape(-1, width)
    x, small, large = lattice.on_lattice(padded, scale, lattice.limit(part))
    rest = iter(large.tolist())
    whole = [x[i].tolist() if small[i] else next(rest) for i in range(len(x))]
    books = [[r[p * part : (p + 1) * part] for r in whole] for p in range(parts)]
    groups = [groups_of(np.array(b, float).reshape(-1, part)) if whole else np.zeros(0, int) for b in books]
    before, state, written = None, rows, rows
    for _ in range(rounds if whole else 0):
        done = cut(_round(state, Coder(books, before, groups, width, scale), kind), "coded")
        discard(written)
        written, state = done, done.where("part is null").select("vec_id", "label", "vector", "code", "bounds")
        sums = lattice.totals(done.where("part is not null").select("part", "entry", "limbs"), ["part", "entry"], part)
        before, books = books, [lattice.means(b, {e: v for (q, e), v in sums.items() if q == p}) for p, b in enumerate(books)]
    coder = Coder(books, before, groups, width, scale)

    def run(batches):
        for batch in batches:
            codes, _, error = coder.code(batch, None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([r.tobytes().hex() for r in codes.astype(np.uint8)], pa.string()), lattice.as_long(error)], ["vec_id", "label", "code", "error"])

    coded = cut(state.mapInArrow(run, "vec_id long, label string, code string, error long"), "codes")
    each = cut(coded.groupBy("label").agg(lattice.capped(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error")), "labels")
    out = cut(join_dealt(coded, each, "label", "vec_id"), "with-labels")
    keep(out)
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def encode_sql(length: int = 64, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The same rows for vectors of one length, each round a step of the query."""
    w = length // parts
    steps = [
        f"""with v as materialized (select row_number() over () as r, vec_id::bigint as vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
y as materialized (select r, vec_id, p, x[p * {w} + 1 : p * {w} + {w}] as x from v, unnest(range({parts})) as t(p)),
c0 as materialized (select p, (row_number() over (partition by p order by vec_id) - 1)::int as c, x from y qualify row_number() over (partition by p order by vec_id) <= {entries})"""
    ]
    for i in range(rounds + 1):
        steps.append(f"d{i} as (select r, y.p, min(struct_pack(d := list_sum(list_transform(list_zip(y.x, c{i}.x), lambda q: (q[1] - q[2]) * (q[1] - q[2])))::bigint, c := c)) as m from y join c{i} on y.p = c{i}.p group by r, y.p)")
        steps.append(f"a{i} as materialized (select y.*, m.c as c, m.d as d from y join d{i} using (r, p))")
        if i < rounds:
            steps.append(f"""m{i} as (select p, c, list(m order by j) as x from (select p, c, j, floor(sum(x[j]) / count(*))::bigint as m from a{i}, unnest(range(1, {w + 1})) as t(j) group by p, c, j) group by p, c),
c{i + 1} as materialized (select c{i}.p, c{i}.c, coalesce(m{i}.x, c{i}.x) as x from c{i} left join m{i} on c{i}.p = m{i}.p and c{i}.c = m{i}.c)""")
    return ",\n".join(steps) + f""",
o as (select r, string_agg(lpad(printf('%x', c), 2, '0'), '' order by p) as code, sum(d)::bigint as error from a{rounds} group by r)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, (select sha256(string_agg(array_to_string(x, ','), ',' order by p, c)) from c{rounds}) as codebooks_sha256 from o join v using (r)"""
