"""Running values over long series, a stretch of time a task.

A running value (the last that was set, a sum, a maximum) of a key is what it is within the row's stretch, put together with what all earlier stretches
leave behind. Each stretch leaves one row, so only these few rows of a key meet in one task. Without a length, a key is one stretch
and no rows are joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import remove, written_once
from . import asof


@dataclass(frozen=True)
class Stretches:
    keys: tuple[str, ...]
    seconds: float | None = None
    order: str = "us"

    def scan(self, df: DataFrame, last: dict[str, Column] | None = None, before: dict[str, Column] | None = None, total: dict[str, Column] | None = None, top: dict[str, Column] | None = None, top_before: dict[str, Column] | None = None) -> DataFrame:
        """Adds running values of a key's rows in their order.

        last: the last value that isn't null, this row included; before: the same without this row; total: sums, this row included; top and top_before: maxima
        with and without this row. A struct as a value of `before` is never null, so it gives the row before.
        """
        seen = {"last": last or {}, "before": before or {}, "total": total or {}, "top": top or {}, "top_before": top_before or {}}
        named = {n: c for kind in seen.values() for n, c in kind.items()}
        inputs = {n: f"_of_{n}" for n in named}
        marked = df.withColumns({inputs[n]: c for n, c in named.items()})
        if self.seconds is None:
            w = Window.partitionBy(*self.keys).orderBy(self.order)
            return marked.withColumns({n: _inside(kind, inputs[n], w) for kind, of in seen.items() for n in of}).drop(*inputs.values())
        marked = written_once(marked.withColumn("_stretch", F.floor(F.col(self.order) / round(self.seconds * 1e6))), "stretches")  # read for the rows and for what a stretch leaves
        w = Window.partitionBy(*self.keys, "_stretch").orderBy(self.order)
        inside = marked.withColumns({n: _inside(kind, inputs[n], w) for kind, of in seen.items() for n in of})
        each = marked.groupBy(*self.keys, "_stretch").agg(*(_leaves(kind, inputs[n], self.order).alias(n) for kind, of in seen.items() for n in of))
        earlier = Window.partitionBy(*self.keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
        carried = each.select(*self.keys, "_stretch", *(_carry(kind, n).over(earlier).alias(f"_from_{n}") for kind, of in seen.items() for n in of))
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in self.keys] + [F.col("a._stretch").eqNullSafe(F.col("b._stretch"))]
        both = inside.alias("a").join(carried.alias("b").hint("merge"), same).select("a.*", *(f"b._from_{n}" for n in named))
        out = both.withColumns({n: _together(kind, n) for kind, of in seen.items() for n in of})
        return out.drop("_stretch", *inputs.values(), *(f"_from_{n}" for n in named))


def _inside(kind: str, c: str, w) -> Column:
    to_here, to_before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    if kind in ("last", "before"):
        return F.last(c, ignorenulls=True).over(to_here if kind == "last" else to_before)
    return F.coalesce(F.sum(c).over(to_here), F.sum(F.lit(0)).over(to_here)) if kind == "total" else F.max(c).over(to_here if kind == "top" else to_before)


def _leaves(kind: str, c: str, order: str) -> Column:
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))) if kind in ("last", "before") else F.sum(c) if kind == "total" else F.max(c)


def _carry(kind: str, n: str) -> Column:
    return F.last(n, ignorenulls=True) if kind in ("last", "before") else F.sum(n) if kind == "total" else F.max(n)


def _together(kind: str, n: str) -> Column:
    old = F.col(f"_from_{n}")
    return F.coalesce(F.col(n), old) if kind in ("last", "before") else F.col(n) + F.coalesce(old, F.lit(0)) if kind == "total" else F.greatest(F.col(n), old)


def reached(nodes: DataFrame, key: str, at: str, then: str, begins: str) -> DataFrame:
    """key and `at` of all nodes that are reached from those where `begins` holds, by going from `at` to `then` again and again.

    Pointer doubling: after round n the jumps are 2**n steps long and all nodes fewer steps away are found, so a chain of a
    million steps takes twenty rounds. A key's chain lies in any number of tasks; each round is a table in the shared folder. The joins are told to sort:
    the files are so small for their rows that Spark would send a table to every executor, by way of the driver, in each round.
    """
    jumps = written_once(nodes.where(F.col(then).isNotNull()).select(F.col(key).alias("k"), F.col(at).alias("a"), F.col(then).alias("b")), "jumps")
    found = written_once(nodes.where(begins).select(F.col(key).alias("k"), F.col(at).alias("a")).distinct(), "reached")
    count = found.count()
    while True:
        more = written_once(found.unionByName(found.join(jumps.hint("merge"), ["k", "a"]).select("k", F.col("b").alias("a"))).distinct(), "reached")
        remove(found)
        found, old, count = more, count, more.count()
        if count == old:
            remove(jumps)
            return found.select(F.col("k").alias(key), F.col("a").alias(at))
        longer = written_once(jumps.join(jumps.select("k", F.col("a").alias("b"), F.col("b").alias("c")).hint("merge"), ["k", "b"]).select("k", "a", F.col("c").alias("b")), "jumps")
        remove(jumps)
        jumps = longer


def spaced(df: DataFrame, key: str, sure: str, may: str, seconds: float, name: str, chunk: float = 86_400.0) -> DataFrame:
    """Adds `name`: rows that are sure, and rows that may if the last one of either kind is at least `seconds` ago; needs `us`.

    Which rows count depends on which did before. From a row that counts, the next one that does is the next sure row or the first that
    may after `seconds`, whichever is earlier: a successor that each row has, whether it counts or not. Those that count are the ones that are reached
    from the first row of a key and from its sure rows. Rows of one key and time count as one: where one is sure, those that only may don't count.
    """
    yes, perhaps = F.coalesce(F.col(sure), F.lit(False)), F.coalesce(F.col(may), F.lit(False))
    times = df.where(F.col(key).isNotNull() & (yes | perhaps)).groupBy(key, "us").agg(F.max(yes).alias("_sure"), F.max(perhaps).alias("_may"))
    nodes = written_once(times.select(F.col(key).alias("_key"), "us", "_sure", "_may", F.timestamp_micros("us").alias("_ts"), F.timestamp_micros(F.col("us") + round(seconds * 1e6)).alias("_then")), "nodes")
    later = lambda which, column: nodes.where(which).select("_key", F.col("_ts").alias(column))
    to_sure = asof.asof_join(nodes, later("_sure", "_s"), "_key", "_ts", "_s", ["_s"], "forward", exact=False, chunk=chunk)
    to_may = asof.asof_join(to_sure, later("_may", "_m"), "_key", "_then", "_m", ["_m"], "forward", chunk=chunk)
    first = nodes.groupBy("_key").agg(F.min("us").alias("_first"))
    linked = to_may.join(first.hint("merge"), "_key").select("_key", "us", F.unix_micros(F.least("_s", "_m")).alias("_next"), (F.col("_sure") | (F.col("us") == F.col("_first"))).alias("_begins"))
    hit = reached(linked, "_key", "us", "_next", "_begins").join(nodes.select("_key", "us", "_sure").hint("merge"), ["_key", "us"])
    at = hit.select(F.col("_key").alias(key), "us", F.col("_sure").alias("_hit_sure"))
    told = F.when(F.col("_hit_sure").isNull(), False).otherwise(yes | (perhaps & ~F.col("_hit_sure")))
    return df.join(at.hint("merge"), [key, "us"], "left").select(*df.columns, told.alias(name))
