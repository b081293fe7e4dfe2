"""Operator 9: near-duplicates with b-bit MinHash.

1. One scan computes, for each document, a digest of its word sequence, the size of its
   shingle set, the minima of several hash functions (only their low `BITS` bits are
   kept, packed) and the keys of bands of whole minima.
2. Equal word sequences form a class; its smallest doc_id stands for it from here on.
3. Bands that two or more classes share give candidate pairs, but not all pairs of a band:
   first each class is held against one hub of its bands, the member that shares most bands
   with others (the text that a group's copies were made from shares more than they do).
4. Bit counts of packed signatures estimate each pair's similarity, corrected for chance
   collisions of low bits; pairs far below the threshold end there. The rest is confirmed
   on full shingle sets, which a second scan makes for documents in shared bands.
5. Bands whose members are still in different components have open pairs. Small bands list
   them. Large bands are joined to clusters, whose sets lie in bounded blocks; each block of
   sets outside a cluster's main component meets each block of the cluster, and what
   comes out are the links that connect components, not the pairs. No partner is capped or dropped.
6. Components of the confirmed links.

A band, hub or node with over a thousandth of all rows is dealt over many tasks in every join
(`frames.dealt`); counts and extremes of a band are summed before they are shuffled.

Two sets at the threshold share none of the bands with a probability under 1e-6; all else is exact.

Edge cases: fewer words than a shingle make one shingle of them all; null, empty and blank
texts have an empty set and link with nothing; a long text is read whole; equal doc_ids are one
document, whose texts are linked with each other; repeated rows keep a row each; rows without
doc_id are kept, with no component, and link with nothing; an empty table has no rows in the
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import cut, dealt, documents, heavy_keys, held, join_dealt, keep, map_text, quoted, scratched, spread

ROWS, BITS = 6, 4
#: An estimate this many hundredths below the threshold is over five standard deviations away.
MARGIN = 15


@dataclass(frozen=True)
class Likeness:
    """What near means: shingles of so many words, and a similarity of so many hundredths or more."""

    words: int = 5
    share: int = 80

    @property
    def bands(self) -> int:
        """So many that two sets at the threshold share none with a probability under one in a million; fours fill bytes."""
        return 4 * math.ceil(math.log(1e-6) / math.log(1 - (self.share / 100) ** ROWS) / 4)

    @property
    def hashes(self) -> int:
        return ROWS * self.bands


#: Bands of up to so many members list their open pairs.
SMALL = 12
#: Shingles in a block of sets that ask, and in a block of sets that are asked; asking blocks that one task compares with a block.
ASKING, ASKED, GROUP = 200_000, 500_000, 16


class _WordHashes(dict):
    """64-bit hashes of words, remembered; starts anew when it holds `limit` words."""

    limit = 200_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def _word_hashes() -> _WordHashes:
    return held(("minhash",), _WordHashes)


@lru_cache(4)
def _families(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of n hash functions."""
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def shingles(text: str | None, n: int) -> tuple[np.ndarray, bytes]:
    """Distinct shingle hashes of a text and a digest of its word sequence."""
    words = text.encode("utf-8", "replace").lower().split() if text else []  # bytes.lower: A-Z only
    if not words:
        return np.zeros(0, np.uint64), b""
    ids = np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))
    n = min(n, len(words))
    mixed = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - n + 1 + k]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(mixed ^ (mixed >> np.uint64(32))), hashlib.blake2b(b" ".join(words), digest_size=16).digest()


#: Shingles hashed at once.
STRETCH = 1 << 16


def minima(found: np.ndarray, n: int) -> np.ndarray:
    """The smallest value of each of n hash functions over a set, 32 bits each."""
    multiply, add = _families(n)
    out = np.full(n, np.iinfo(np.uint64).max)
    for at in range(0, len(found), STRETCH):  # so memory doesn't grow with a text
        some = found[at : at + STRETCH]
        for start in range(0, n, 16):  # a block of functions at a time stays in the CPU's cache
            part = slice(start, start + 16)
            out[part] = np.minimum(out[part], (some[None, :] * multiply[part, None] + add[part, None]).min(axis=1))
    return (out >> np.uint64(32)).astype(np.uint32)


def sketch(found: np.ndarray, like: Likeness) -> tuple[bytes, list[int]]:
    """Packed low bits of the minima, and a key for each band."""
    low = minima(found, like.hashes)
    bits = ((low[:, None] >> np.arange(BITS, dtype=np.uint32)) & 1).astype(np.uint8)
    rows = low.reshape(like.bands, ROWS).astype(np.uint64)
    key = np.arange(like.bands, dtype=np.uint64) + np.uint64(1)
    for k in range(ROWS):
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + rows[:, k]
    return np.packbits(bits.T.ravel()).tobytes(), (key ^ (key >> np.uint64(32))).astype(np.int64).tolist()


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities of packed signatures (one a row): agreeing functions by bit counts, less chance collisions."""
    differ = np.bitwise_or.reduce((a ^ b).reshape(len(a), BITS, -1), axis=1)
    same = 1 - np.bitwise_count(differ).sum(axis=1) / (8 * differ.shape[1])
    chance = 2.0**-BITS
    return (same - chance) / (1 - chance)


def signatures(docs: DataFrame, like: Likeness) -> DataFrame:
    """doc_id, exact (a digest of the text), digest of the word sequence, n_shingles, signature, bands; empty sets have neither of the last two digests nor bands."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"digest": [], "n_shingles": [], "signature": [], "bands": []}
            for text in batch.column("text").to_pylist():
                found, digest = shingles(text, like.words)
                signature, bands = sketch(found, like) if len(found) else (None, None)
                for name, x in zip(out, (digest or None, len(found), signature, bands), strict=True):
                    out[name].append(x)
            return {"doc_id": batch.column("doc_id"), "exact": batch.column("exact"), **out}

        return step

    return map_text(documents(docs, exact_text().alias("exact")), make, "doc_id long, exact binary, digest binary, n_shingles long, signature binary, bands array<long>")


def exact_text() -> Column:
    """A digest of a text as it is; null of a null text."""
    return F.unhex(F.md5(F.col("text").cast("string").cast("binary")))


def _likely(pairs: DataFrame, share: int) -> DataFrame:
    """Pairs whose sizes and estimated similarity allow a link."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
            keep = estimate(a, b) * 100 >= share - MARGIN
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.mapInArrow(run, "a long, b long")


def _confirm(rows: DataFrame, share: int) -> DataFrame:
    """a, b, set_a, set_b to a, b and whether they link."""

    def run(batches):
        for batch in batches:
            linked = []
            for i in range(batch.num_rows):
                x, y = (np.asarray(batch.column(c)[i].values) for c in ("set_a", "set_b"))
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= share * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, digest and the hashes of the whole shingle set."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            sets, digests = zip(*(shingles(t, words) for t in batch.column("text").to_pylist()), strict=True)
            ends = np.cumsum([0, *map(len, sets)])
            return {"doc_id": batch.column("doc_id"), "digest": digests, "shingles": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))}

        return step

    return map_text(documents(docs), make, "doc_id long, digest binary, shingles array<long>")


def components(links: DataFrame, name: str = "labels") -> DataFrame:
    """id and root (the smallest id reachable) of every id in `links` (a, b).

    Labels shrink along links and then jump to the label of their label, so a
    round more than halves a path. Each round is a written table; it ends when none changes.
    """
    edges = cut(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-edges")
    heavy = heavy_keys(edges.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "b", "n", edges.count())
    labels = edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    labels = cut(labels, name)
    while True:
        near = dealt(edges, heavy, "b", "a").join(spread(labels.withColumnRenamed("id", "b"), heavy, "b"), ["b", "salt"]).groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        lower = cut(labels.join(near, "id").select("id", F.least("root", "near").alias("new"), "root"), f"{name}-lower")
        jump = lower.select(F.col("id").alias("new"), F.col("new").alias("far"))  # every label is an id
        moved = cut(join_dealt(lower, jump, "new", "id").select("id", F.least("new", "far").alias("root"), (F.least("new", "far") < F.col("root")).alias("moved")), name)
        labels = moved.select("id", "root")
        if not moved.where("moved").limit(1).count():
            return labels


@scratched
def duplicates(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id, kept."""
    signed, nodes = _classes(docs, like)
    roots = components(_links(docs, nodes, like).union(_same_document(signed, nodes)), "final")
    by_digest = _rooted(nodes, roots).select("digest", F.col("least.doc_id").alias("component"))
    rows = signed.select("doc_id", "digest", "n_shingles").join(by_digest, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = cut(rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "duplicates")
    keep(out)
    return out


@scratched
def drop_copies(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """One row of each group of near-duplicate texts, with all columns of `docs`.

    Groups are of texts, whatever their ids, so no text goes because its id occurs twice. The row with the smallest
    doc_id stays, among those the one with the least digest of its text, and of rows with equal id and text the one
    whose other columns, written as JSON, come first. Texts without words stay, one row for each id and text; rows without doc_id all stay.
    """
    signed, nodes = _classes(docs, like)
    roots = components(_links(docs, nodes, like), "final")
    least = _rooted(nodes, roots).select(F.col("least.doc_id").alias("kept_id"), F.col("least.exact").alias("kept_exact"))
    alone = signed.where("digest is null and doc_id is not null").select("doc_id", "exact")
    kept = cut(least.union(alone).distinct(), "kept")
    keep(kept)
    others = [quoted(c) for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*others)) if others else F.lit("")  # columns of any type, maps too, have an order as text
    same = (F.col("kept_id") == F.col("own_id")) & F.col("kept_exact").eqNullSafe(F.col("own_exact"))
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("own_id"), exact_text().alias("own_exact"), F.struct(*map(quoted, docs.columns)).alias("row"), order.alias("order"))
    once = rows.groupBy("own_id", "own_exact").agg(F.min_by("row", "order").alias("row")).join(kept, same, "left_semi").select("row.*")
    return once.unionByName(docs.where("doc_id is null"))


def _classes(docs: DataFrame, like: Likeness) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and a node for each different word sequence with the first of its documents."""
    signed = cut(signatures(docs, like), "signatures")
    named = signed.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    first = [F.first(c).alias(c) for c in ("n_shingles", "signature", "bands")]  # alike in all rows of a digest
    return signed, cut(named.groupBy("digest").agg(F.min(F.struct("doc_id", "exact")).alias("rep"), *first).withColumn("node", F.monotonically_increasing_id()), "nodes")


def _same_document(signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the texts that share a doc_id."""
    named = signed.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "digest")
    several = named.groupBy("doc_id").agg(F.min("digest").alias("one"), F.max("digest").alias("other")).where("one <> other").select("doc_id", "one")
    pairs = named.distinct().join(several, "doc_id").where("digest <> one").select("one", F.col("digest").alias("other")).distinct()
    of = nodes.select("digest", "node")
    return pairs.join(of.toDF("one", "a"), "one").join(of.toDF("other", "b"), "other").select("a", "b")


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """digest, and the least document of its component."""
    of = cut(nodes.select("node", "rep", "digest").join(roots.withColumnRenamed("id", "node"), "node", "left").select("digest", "rep", F.coalesce("root", "node").alias("root")), "rooted")
    return join_dealt(of, of.groupBy("root").agg(F.min("rep").alias("least")), "root", "digest").select("digest", "least")


def _links(docs: DataFrame, nodes: DataFrame, like: Likeness) -> DataFrame:
    """Confirmed links that connect all nodes that any links of shared bands connect."""
    keys = nodes.select(F.explode("bands").alias("band"), "node", "n_shingles")
    shared = cut(keys.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "shared")
    heavy = heavy_keys(shared, "band", "members", nodes.count() * like.bands)
    salted = ["band", "salt"]
    members = cut(dealt(keys, heavy, "band", "node").join(spread(shared, heavy, "band"), salted), "members")
    sets = _sets(docs, nodes, members, like.words)
    weight = members.groupBy("node").agg(F.sum("members").alias("weight"))
    hubs = members.join(weight, "node").groupBy("band").agg(F.max(F.struct("weight", "node", "n_shingles")).alias("hub"))
    share = like.share
    linked = lambda pairs: cut(_confirm(_with_sets(_with_signatures(pairs, nodes, share), sets), share), "links")
    first = linked(_hub_pairs(members.join(spread(hubs, heavy, "band"), salted), share))
    rooted = members.join(components(first).withColumnRenamed("id", "node"), "node", "left").select(*salted, "node", "n_shingles", F.coalesce("root", "node").alias("root"))
    open_ = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("node").alias("low"), F.count(F.lit(1)).alias("left")).where("lo <> hi").select("band", "left", "low")
    rest = cut(rooted.join(spread(open_, heavy, "band"), salted), "open")
    few = linked(_all_pairs(rest.where(F.col("left") <= SMALL), share))
    return first.union(few).union(cut(_cluster_links(rest.where(F.col("left") > SMALL), sets, share), "links"))


def _fits(a: Column | str, b: Column | str, share: int) -> Column:
    """Whether two set sizes allow a link."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * share


def _hub_pairs(with_hubs: DataFrame, share: int) -> DataFrame:
    """Each node (a) with the weightiest hub (b) of its bands whose size allows a link."""
    each = with_hubs.where((F.col("node") != F.col("hub.node")) & _fits("n_shingles", "hub.n_shingles", share)).groupBy("node").agg(F.max("hub")["node"].alias("hub"))
    return each.select(F.col("node").alias("a"), F.col("hub").alias("b"))


def _all_pairs(rest: DataFrame, share: int) -> DataFrame:
    """Open pairs of small bands: at most SMALL members each."""
    held = rest.groupBy("band").agg(F.collect_list(F.struct("node", "root", "n_shingles")).alias("xs"))
    partners = lambda x: F.filter("xs", lambda y: (y["node"] > x["node"]) & (y["root"] != x["root"]) & _fits(x["n_shingles"], y["n_shingles"], share))
    pairs = F.flatten(F.transform("xs", lambda x: F.transform(partners(x), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))
    return held.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def _cluster_links(rest: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Links between components of large bands, in bounded blocks of sets."""
    together = components(rest.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct(), "clusters").toDF("node", "cluster")
    own = cut(rest.select("node", "root", "n_shingles").distinct().join(together, "node"), "clustered")
    sizes = own.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    blocks = lambda total, size: F.ceil(F.col(total) / size) + 1
    main = sizes.groupBy("cluster").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.sum("s").alias("all"), (F.sum("s") - F.max(F.struct("n", "s"))["s"]).alias("outside"))
    main = main.select("cluster", "main", blocks("outside", ASKING).alias("n_a"), blocks("all", ASKED).alias("n_b"))
    rows = join_dealt(own, main, "cluster", "node").join(sets, "node")
    block = lambda n: F.pmod(F.xxhash64("node"), n).cast("int").alias("block")
    one = F.struct("node", "root", "shingles").alias("x")
    pack = lambda df, prefix: df.groupBy("cluster", "block", "n_a", "n_b").agg(F.collect_list("x").alias("xs")).select("cluster", "block", "n_a", "n_b", *(F.col(f"xs.{c}").alias(f"{prefix}_{c}") for c in ("node", "root", "shingles")))
    asking = pack(rows.where("root <> main").select("cluster", block(F.col("n_a")), "n_a", "n_b", one), "a")
    asked = pack(rows.select("cluster", block(F.col("n_b")), "n_a", "n_b", one), "b")
    # a key is an asked block and a group of asking blocks, so the block pairs of one cluster go to many tasks
    group = lambda n: F.floor(n / GROUP).cast("int")
    asking = asking.withColumn("b_block", F.explode(F.sequence(F.lit(0), (F.col("n_b") - 1).cast("int")))).withColumn("group", group(F.col("block"))).drop("block", "n_a", "n_b")
    asked = asked.withColumn("group", F.explode(F.sequence(F.lit(0), group(F.col("n_a") - 1)))).withColumnRenamed("block", "b_block").drop("n_a", "n_b")
    return asking.join(asked, ["cluster", "b_block", "group"]).drop("cluster", "b_block", "group").mapInArrow(partial(_connect, share=share), "a long, b long")


def _connect(batches, share: int):
    """Of two blocks of sets, links that connect different components: no more than there are sets."""
    for batch in batches:
        for i in range(batch.num_rows):
            a_node, a_root, a_sets, b_node, b_root, b_sets = (batch.column(c)[i].values for c in ("a_node", "a_root", "a_shingles", "b_node", "b_root", "b_shingles"))
            ends = np.append(0, np.cumsum(pc.list_value_length(b_sets).to_numpy()))
            known, ids = np.unique(b_sets.flatten().to_numpy(), return_inverse=True)
            size_b, b_nodes = np.diff(ends), b_node.to_numpy()
            parent: dict[int, int] = {}

            def find(x, parent=parent):
                while (y := parent.get(x, x)) != x:
                    x = y
                return x

            out = []
            for node, root, own in zip(a_node.to_pylist(), a_root.to_pylist(), a_sets, strict=True):
                x = own.values.to_numpy()
                at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                mark = np.zeros(len(known), np.int64)
                mark[at[known[at] == x]] = 1
                both = np.add.reduceat(mark[ids], ends[:-1])
                for k in np.flatnonzero((100 * both >= share * (len(x) + size_b - both)) & (b_nodes != node)).tolist():
                    r, t = find(root), find(b_root[k].as_py())
                    if r != t:
                        parent[r] = t
                        out.append((node, int(b_nodes[k])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])


def _with_signatures(pairs: DataFrame, nodes: DataFrame, share: int) -> DataFrame:
    """Pairs whose signatures make a link likely."""
    of = nodes.select("node", "signature")
    x = pairs.join(of.toDF("a", "sig_a"), "a").join(of.toDF("b", "sig_b"), "b")
    return _likely(x.select("a", "b", "sig_a", "sig_b"), share)


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with both sets; a hub's copies of its set are made in many tasks."""
    second = join_dealt(cut(pairs, "likely"), sets.toDF("b", "set_b"), "b", "a")  # a hub is always b
    return second.join(sets.toDF("a", "set_a"), "a").select("a", "b", "set_a", "set_b")


def _sets(docs: DataFrame, nodes: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """Shingle sets of the nodes in shared bands, from a second scan of the texts."""
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("rep.doc_id").alias("rep"), "digest")
    texts = documents(docs).join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    found = shingle_sets(texts, words).withColumnRenamed("doc_id", "rep").join(wanted, ["rep", "digest"])
    return cut(found.select("node", "shingles").dropDuplicates(["node"]), "sets")
