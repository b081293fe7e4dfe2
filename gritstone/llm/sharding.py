"""Operator 8: sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard. On each level every child draws -ln(u) / weight
from a hash of key and child, and the least draw wins: a child gets keys in proportion
to its weight, and a change of one weight moves keys only to or from that child. A new
shard comes as a region of its own, so the grown tree takes keys only into it.

All draws are built-in functions of the key alone: placing needs no shuffle. Slots need
counts: rows get their place within a shard and a bucket of the input's order, and the
running totals of the buckets are added. Keys have no say in the buckets, so repeated
rows don't meet in one task.

Edge cases: a child of weight 0, as a shard that is being drained, gets no keys, and a tree without any weight is
refused; null texts have one byte of size, long ones are measured whole; a null doc_id is a key of its own; repeated
doc_ids go to one shard; an empty table has no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut, keep, scratched

#: Rows of the input that are numbered together; other buckets are numbered beside them.
BUCKET_ROWS = 1 << 16


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; the weight of an inner node is that of its shards."""

    name: str
    children: tuple[Node, ...] = ()
    own: float = 1.0
    shard: int | None = None

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


def tree(shards: int = 16, racks: int = 2, per_rack: int = 2, extra: int = 0) -> Node:
    """Shards 0.. in racks of `per_rack` and regions of `racks`; each of `extra` further shards is a region of its own."""
    leaf = lambda i: Node(f"shard{i}", shard=i)
    rows = [Node(f"rack{i // per_rack}", tuple(map(leaf, range(i, min(i + per_rack, shards))))) for i in range(0, shards, per_rack)]
    regions = [Node(f"region{i // racks}", tuple(rows[i : i + racks])) for i in range(0, len(rows), racks)]
    return Node("root", (*regions, *(Node(f"added{i}", (leaf(i),)) for i in range(shards, shards + extra))))


def place(key: Column, node: Node) -> Column:
    """The shard of a key below a node."""
    if node.shard is not None:
        return F.lit(node.shard)
    if any(not c.weight >= 0 for c in node.children):
        raise ValueError(f"a child of {node.name} has a weight below 0")
    live = [c for c in node.children if c.weight > 0]
    if not live:
        raise ValueError(f"no child of {node.name} has a weight above 0")
    if len(live) == 1:
        return place(key, live[0])
    draws = [F.struct((_draw(key, c.name) / F.lit(c.weight)).alias("draw"), F.lit(i).alias("child")) for i, c in enumerate(live)]
    choice = F.least(*draws)["child"]
    below = [place(key, c) for c in live]
    return F.element_at(F.array(*below), choice + 1) if all(c.shard is not None for c in live) else _case(choice, below)


def _case(choice: Column, below: list[Column]) -> Column:
    out = F.when(choice == 0, below[0])
    for i, x in enumerate(below[1:], 1):
        out = out.when(choice == i, x)
    return out


def _draw(key: Column, name: str) -> Column:
    """-ln of a uniform number from 52 bits of a hash of key and child."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 12)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 52))


@scratched
def assign(docs: DataFrame, root: Node, grown: Node | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        place(key, root).cast("int").alias("shard"), (place(key, grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
    )
    written = cut(rows.withColumn("row", F.monotonically_increasing_id()), "placed")
    keep(written)
    rows = written.withColumn("bucket", F.floor(F.col("row") / bucket_rows))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("row")) - 1
    placed = rows.withColumn("local", local).join(before, ["shard", "bucket"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("local") + F.col("before")).cast("long").alias("slot"), "grown_shard")
