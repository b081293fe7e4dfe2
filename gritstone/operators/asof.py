"""As-of joins, point-in-interval and overlap joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written_once
from .windows import micros


def asof_join(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, columns: list[str], direction: str = "backward", exact: bool = True, tie: str | None = None, chunk: float | None = None) -> DataFrame:
    """Each left row with the nearest right row of its key at or before (or after) its time.

    One sort of the union of both sides. Of right rows with one time the last by `tie` counts
    (the first, looking forward). With `chunk` seconds a key's series is cut into stretches
    that are sorted apart; what a stretch takes from others comes from one row a stretch. The rows of both sides
    are then a table in the shared folder.
    """
    kept = left.columns
    pick = F.struct(*(F.col(c) for c in columns))
    # on equal times: a right row comes first in the direction of search, unless exact matches don't count
    l_rank, r_rank = (1, 0) if exact else (0, 1)
    l = left.withColumns({"_us": micros(left_on), "_side": F.lit(l_rank), "_left": F.lit(True)})
    r = right.where(F.col(right_on).isNotNull()).select(F.col(by), micros(right_on).alias("_us"), F.lit(r_rank).alias("_side"), F.lit(False).alias("_left"), (F.col(tie) if tie else F.lit(0)).alias("_tie"), pick.alias("_right"))
    both = l.unionByName(r, allowMissingColumns=True)
    ahead = direction == "forward"
    order = [F.col("_us").desc() if ahead else F.col("_us"), "_side", F.col("_tie").desc() if ahead else F.col("_tie")]
    seen = F.last("_right", ignorenulls=True)
    if chunk is None:
        w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("_found", seen.over(w)).where("_left")
    else:
        # written once, as the rows and what each stretch leaves to later ones are both read from it
        both = written_once(both.withColumn("_chunk", F.floor(F.col("_us") / round(chunk * 1_000_000))), "asof")
        w = Window.partitionBy(by, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        inside = both.withColumn("_found", seen.over(w)).where("_left")
        nearest = (F.min_by if ahead else F.max_by)("_right", F.when(~F.col("_left"), F.struct("_us", "_tie")))
        each = both.groupBy(by, "_chunk").agg(nearest.alias("_last"))
        c = Window.partitionBy(by).orderBy(F.col("_chunk").desc() if ahead else F.col("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
        carried = each.select(by, "_chunk", F.last("_last", ignorenulls=True).over(c).alias("_carried"))
        # a row a key and stretch, which grow with the rows: never broadcast
        found = inside.join(carried.hint("merge"), [by, "_chunk"], "left").withColumn("_found", F.coalesce("_found", "_carried"))
    return found.select(*kept, *(F.col("_found")[c].alias(c) for c in columns))


def point_in_interval(points: DataFrame, intervals: DataFrame, by: str, ts: str, start: str, end: str, columns: list[str], chunk: float | None = None) -> DataFrame:
    """Each point with the interval [start, end) of its key that holds it; intervals of a key don't overlap.

    With `chunk` seconds a hot key's points are sorted in stretches of time (see `asof_join`).
    """
    kept = points.columns
    found = asof_join(points, intervals, by, ts, start, [*columns, end] if end not in columns else columns, chunk=chunk)
    inside = F.col(ts) < F.col(end)
    return found.select(*kept, *(F.when(inside, F.col(c)).alias(c) for c in columns))


def buckets(start: Column, end: Column, seconds: float) -> Column:
    """Numbers of all time buckets that an interval of microseconds touches."""
    size = round(seconds * 1_000_000)
    return F.sequence(F.floor(start / size), F.floor(F.greatest(start, end - 1) / size))


def overlap_join(a: DataFrame, b: DataFrame, by: str, a_span: tuple[str, str], b_span: tuple[str, str], seconds: float, columns: dict[str, str]) -> DataFrame:
    """Pairs of half-open intervals of a key that overlap: a.start < b.end and a.end > b.start.

    Both sides are dealt by key and time bucket, and a pair counts in the bucket where the
    later of its two starts lies: an equi-join, for hot keys too, with no pair twice. `columns` names what is taken from b.
    """
    size = round(seconds * 1_000_000)
    x = a.withColumns({"_a0": micros(a_span[0]), "_a1": micros(a_span[1])}).withColumn("_bucket", F.explode(buckets(F.col("_a0"), F.col("_a1"), seconds)))
    y = b.select(F.col(by), micros(b_span[0]).alias("_b0"), micros(b_span[1]).alias("_b1"), *(F.col(c).alias(n) for c, n in columns.items())).withColumn("_bucket", F.explode(buckets(F.col("_b0"), F.col("_b1"), seconds)))
    pairs = x.join(y, [by, "_bucket"]).where((F.col("_a0") < F.col("_b1")) & (F.col("_a1") > F.col("_b0")) & (F.floor(F.greatest("_a0", "_b0") / size) == F.col("_bucket")))
    return pairs.drop("_bucket", "_a0", "_a1", "_b0", "_b1")


def cut_by_first(intervals: DataFrame, events: DataFrame, by: str, start: str, end: str, ts: str, name: str) -> DataFrame:
    """Intervals with `name`: their end, or the first event of their key inside them if there is one: the next one from the start on."""
    kept = intervals.columns
    found = asof_join(intervals, events.select(by, F.col(ts).alias("_first")), by, start, "_first", ["_first"], "forward")
    return found.select(*kept, F.when(F.col("_first") < F.col(end), F.col("_first")).otherwise(F.col(end)).alias(name))
