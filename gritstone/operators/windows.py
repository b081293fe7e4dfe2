"""Trailing, lagged and cumulative windows over keyed time series.

Frames are half-open: the window of d ends at a row and holds times in (t - d, t].
A hot key's series can be split over tasks with `chunk`: rows are copied into the next
chunk of time as far as the window reaches back, and each chunk is windowed alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

DAY = 86_400.0


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def no_nan(x: Column) -> Column:
    """NaN as NULL; Spark compares and aggregates NaN as a large number."""
    return F.when(~F.isnan(x), x)


def by(key: str | list[str], order: str | Column = "us") -> WindowSpec:
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(order)


def trailing(key: str | list[str], seconds: float, order: str = "us") -> WindowSpec:
    """(t - seconds, t] over a column of microseconds."""
    return by(key, order).rangeBetween(-round(seconds * 1_000_000) + 1, 0)


def trailing_stats(df: DataFrame, key: str, value: str, seconds: float, prefix: str = "") -> DataFrame:
    """Count, sum, mean and population deviation of the trailing window; needs a column `us`."""
    w, x = trailing(key, seconds), F.col(value)
    return df.withColumns({f"{prefix}n": F.count(x).over(w), f"{prefix}sum": F.sum(x).over(w), f"{prefix}mean": F.avg(x).over(w), f"{prefix}std": F.stddev_pop(x).over(w)})


def chunked(df: DataFrame, key: str | list[str], seconds: float, chunk: float, compute: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """Run a trailing-window computation on chunks of time, so that one key's rows spread over many tasks.

    `compute(frame, keys)` adds columns from windows over `keys` that reach back `seconds` at most.
    """
    if chunk < seconds:
        raise ValueError("a chunk must be at least as long as the window")
    size = round(chunk * 1_000_000)
    own = F.floor(F.col("us") / size)
    reach = F.floor((F.col("us") + round(seconds * 1_000_000) - 1) / size)
    copies = df.withColumn("_own", own).withColumn("_chunk", F.explode(F.sequence(own, reach)))
    return compute(copies, [*([key] if isinstance(key, str) else key), "_chunk"]).where("_own = _chunk").drop("_own", "_chunk")


def slope(t: Column, x: Column, w: WindowSpec, null_aware: bool = False, least: int = 3) -> Column:
    """Least-squares slope of x on t over a window.

    Plain: 0 where the denominator vanishes; rows without x still count for n and t.
    null_aware: only rows with x count, and fewer than `least` of them give NULL.
    """
    n, st, stt = (F.count(t).over(w), F.sum(t).over(w), F.sum(t * t).over(w)) if not null_aware else (F.count(x).over(w), F.sum(F.when(x.isNotNull(), t)).over(w), F.sum(F.when(x.isNotNull(), t * t)).over(w))
    den = n * stt - st * st
    got = F.when(den > 1e-9, (n * F.sum(t * x).over(w) - st * F.sum(x).over(w)) / den)
    return F.when(n >= least, got) if null_aware else F.coalesce(got, F.lit(0.0))


def weighted_trailing_mean(x: Column, weight: Column, w: WindowSpec) -> Column:
    """Mean of x by weight, over rows that have x."""
    return F.try_divide(F.sum(x * weight).over(w), F.sum(F.when(x.isNotNull(), weight)).over(w))


def lagged_mean(x: Column, weight: Column, key: str, order: str, far: int, near: int, least: float) -> Column:
    """Weighted mean over (t - far, t - near], NULL below `least` weight; orders are whole numbers."""
    w = by(key, order).rangeBetween(-far + 1, -near)
    total = F.sum(F.when(x.isNotNull(), weight)).over(w)
    return F.when(total >= least, F.sum(x * weight).over(w) / total)


def prior_mean(total: Column, count: Column, w: WindowSpec) -> Column:
    """Mean over all earlier rows, from sums and counts a row; the row itself stays out."""
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return F.try_divide(F.sum(total).over(before), F.sum(count).over(before))


def lookback_mean(targets: DataFrame, history: DataFrame, key: str, at: str, on: str, value: str, seconds: float, name: str) -> DataFrame:
    """For each target, the mean of `value` over history rows of its key in [at - seconds, at).

    One window over the union of both sides, in place of a range join.
    """
    columns = targets.columns
    left = targets.withColumns({"_us": micros(at), "_x": F.lit(None).cast("double"), "_target": F.lit(True)})
    right = history.select(F.col(key), micros(on).alias("_us"), F.col(value).cast("double").alias("_x"), F.lit(False).alias("_target"))
    both = left.unionByName(right, allowMissingColumns=True)
    w = by(key, "_us").rangeBetween(-round(seconds * 1_000_000), -1)
    return both.withColumn(name, F.avg("_x").over(w)).where("_target").select(*columns, name)


def held_for(cond: Column, key: str, seconds: float) -> Column:
    """Whether a condition held on every reading of the trailing window."""
    return F.min(cond.cast("int")).over(trailing(key, seconds)) == 1


def full_frame(value: Column, w: WindowSpec, rows: int) -> Column:
    """A windowed value only where the frame has all its rows."""
    return F.when(F.count(F.lit(1)).over(w) == rows, value)


def ffill(x: Column, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def reverse_total(x: Column, w: WindowSpec) -> Column:
    """Sum of this row and all later ones."""
    return F.sum(x).over(w.rowsBetween(0, Window.unboundedFollowing))


def latest(df: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order that must be total."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def head_tail_change(df: DataFrame, key: str, order: list[Column], reverse: list[Column], value: str, n: int, name: str) -> DataFrame:
    """Mean of the last n rows of a key less that of its first n."""
    w, v = Window.partitionBy(key).orderBy(*order), Window.partitionBy(key).orderBy(*reverse)
    ranked = df.withColumns({"_a": F.row_number().over(w), "_z": F.row_number().over(v)})
    return ranked.groupBy(key).agg((F.avg(F.when(F.col("_z") <= n, F.col(value))) - F.avg(F.when(F.col("_a") <= n, F.col(value)))).alias(name))


def hop_windows(df: DataFrame, ts: str, length: str, step: str) -> DataFrame:
    """Each row in every sliding window that holds it: columns start and end."""
    return df.withColumn("_w", F.window(F.col(ts).cast("timestamp"), length, step)).withColumns({"start": F.col("_w.start"), "end": F.col("_w.end")}).drop("_w")


def running_totals(df: DataFrame, order: str, values: list[str], buckets: int = 64) -> DataFrame:
    """Adds total_v, the sum of v over all rows up to this one, highest `order` first; rows of equal order share it.

    A window over the whole table would be one task. Rows are dealt by approximate quantiles of
    `order`, summed within their bucket, and the totals of higher buckets, a row each, are added.
    """
    cuts = sorted(set(df.approxQuantile(order, [i / buckets for i in range(1, buckets)], 0.5 / buckets)))
    bucket = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    dealt = df.withColumn("_bucket", bucket)
    w = Window.partitionBy("_bucket").orderBy(F.desc(order))
    inside = dealt.withColumns({f"_in_{v}": F.sum(v).over(w) for v in values})
    each = dealt.groupBy("_bucket").agg(*(F.sum(v).alias(f"_all_{v}") for v in values))
    higher = Window.orderBy(F.desc("_bucket"))
    above = each.select("_bucket", *((F.sum(f"_all_{v}").over(higher) - F.col(f"_all_{v}")).alias(f"_above_{v}") for v in values))
    return inside.join(F.broadcast(above), "_bucket").select(*df.columns, *((F.col(f"_in_{v}") + F.col(f"_above_{v}")).alias(f"total_{v}") for v in values))  # at most `buckets` rows
