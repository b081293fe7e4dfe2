"""Sessions and order-dependent levels; the same calls work on streams and on tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.islands import latched
from ..operators.windows import no_nan


def coalesce_events(df: DataFrame, ts: str, gap: str, keys: list[str], watermark: str | None = None, **aggregates: Column) -> DataFrame:
    """Events of a key no further than `gap` apart become one row: start_ts, last_ts, n and more.

    On a stream give a watermark: a session ends when the watermark has passed it.
    """
    df = df.withWatermark(ts, watermark) if watermark else df
    got = df.groupBy(*keys, F.session_window(F.col(ts), gap).alias("_w")).agg(F.min(ts).alias("start_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n"), *(c.alias(n) for n, c in aggregates.items()))
    return got.drop("_w")


def step_level(level: int, x: float | None, floors: list[float], slack: float) -> int:
    """The next level: up as soon as a floor is reached, down only when `slack` below it."""
    if x is None or x != x:
        return level
    up = sum(x >= f for f in floors)
    while level > up and x < floors[level - 1] - slack:
        level -= 1
    return max(level, up)


def orphans(alerts: DataFrame, tracked: DataFrame, now: Column, quiet: str = "30 seconds", never: tuple[str, ...] = ("SOS",)) -> DataFrame:
    """Open alerts (id, ts, last_ts, resolved_at, alert_code) that nobody tracks (id) any more and that have been quiet: a restart resolves them."""
    old = F.coalesce("last_ts", "ts") <= now - F.expr(f"interval {quiet}")
    return alerts.where(F.col("resolved_at").isNull() & old & ~F.col("alert_code").isin(*never)).join(tracked.select("id").distinct(), "id", "left_anti")


def hysteresis(df: DataFrame, key: str, order: str, value: str, floors: list[float], slack: float, name: str) -> DataFrame:
    """Adds the level of each row in the order of its key: floors that were reached and have not been left by `slack` since."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = no_nan(F.col(value).cast("double"))
    return df.withColumn(name, sum((latched(x >= f, x < f - slack, w).cast("int") for f in floors), F.lit(0)))


def hysteresis_stream(stream: DataFrame, key: str, ts: str, value: str, floors: list[float], slack: float, forget_ms: int = 86_400_000) -> DataFrame:
    """The level of each key after each row, kept across micro-batches; rows of a batch are taken in time order.

    A key that is silent for a day is forgotten and begins at level 0 again.
    """
    kind = stream.schema[key].dataType.simpleString()

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        level = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(ts, kind="stable")
        levels = []
        for x in rows[value]:
            level = step_level(level, x, floors, slack)
            levels.append(level)
        state.update((level,))
        state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame({key: rows[key], ts: rows[ts], "level": levels})

    return stream.select(key, ts, value).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {ts} timestamp, level int", "level int", "append", GroupStateTimeout.ProcessingTimeTimeout)
