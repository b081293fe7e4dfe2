"""Gaps and islands: runs of rows without a gap or a change of state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def breaks(key: str | list[str], gap_seconds: float, *states: str) -> Column:
    """Whether a row (by `us`) begins a run: first of its key, after a gap, or another state."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy("us")
    new = F.lag("us").over(w).isNull() | (F.col("us") - F.lag("us").over(w) > round(gap_seconds * 1_000_000))
    for s in states:
        new = new | ~F.lag(s).over(w).eqNullSafe(F.col(s))
    return new


def runs(df: DataFrame, key: str, gap_seconds: float, *states: str) -> DataFrame:
    """Adds run_id (within the key), run_start (us) and run_pos; needs a column `us`."""
    w = Window.partitionBy(key).orderBy("us")
    marked = df.withColumn("_new", breaks(key, gap_seconds, *states))
    named = marked.withColumn("run_id", F.sum(F.col("_new").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    r = Window.partitionBy(key, "run_id").orderBy("us")
    return named.withColumns({"run_start": F.first("us").over(r), "run_pos": F.row_number().over(r)})


def run_summary(df: DataFrame, key: str, gap_seconds: float, *states: str, **aggregates: Column) -> DataFrame:
    """One row a run: first and last time, length, and further aggregates."""
    found = runs(df, key, gap_seconds, *states)
    return found.groupBy(key, "run_id", *states).agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("n"), *(c.alias(n) for n, c in aggregates.items()))


def run_starts(active: Column, key: str, gap_seconds: float, value: str | None = None) -> Column:
    """True on the first row of each run of active rows; a gap or another value begins a new run."""
    w = Window.partitionBy(key).orderBy("us")
    joined = F.coalesce(F.lag(active).over(w), F.lit(False)) & (F.col("us") - F.lag("us").over(w) <= round(gap_seconds * 1_000_000))
    if value:
        joined = joined & F.lag(value).over(w).eqNullSafe(F.col(value))
    return active & ~F.coalesce(joined, F.lit(False))


def latched(on: Column, off: Column, window) -> Column:
    """Whether the last row so far that decides, by `on` or else by `off`, said on; `window` reaches from the first row to this one."""
    return F.coalesce(F.last(F.when(on, True).when(off, False), ignorenulls=True).over(window), F.lit(False))


def hold_trigger(df: DataFrame, key: str, cond: Column, seconds: float) -> DataFrame:
    """Rows where a condition has just been true for longer than `seconds`: one a run."""
    found = runs(df.withColumn("_c", F.coalesce(cond, F.lit(False))), key, float(1 << 40), "_c")
    r = Window.partitionBy(key, "run_id").orderBy("us")
    over = F.col("_c") & (F.col("us") - F.col("run_start") > round(seconds * 1_000_000))
    fired = found.withColumn("_over", over).withColumn("_before", F.coalesce(F.lag("_over").over(r), F.lit(False)))
    return fired.where("_over and not _before").drop("_c", "_over", "_before", "run_id", "run_pos")


def sessions(df: DataFrame, ts: str, gap: str, *keys: str, **aggregates: Column) -> DataFrame:
    """Rows of a key no further than `gap` apart as one row; the same call works on a stream."""
    w = F.session_window(F.col(ts).cast("timestamp"), gap)
    return df.groupBy(*keys, w.alias("_w")).agg(*(c.alias(n) for n, c in aggregates.items())).drop("_w")
