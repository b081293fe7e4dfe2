"""Lookups in a table that is renewed while a stream runs.

A key looks its row up at its first reading and again once `every_s` seconds of data time have passed since it last did; between two lookups it keeps what it
found. A lookup finds the newest row of the key that was written at or before the reading's time, by data time, not by when the job
runs, so a replay gives the same rows. Readings with a NULL key or time find nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import windows as W
from ..operators.asof import asof_join
from ..operators.stretches import Stretches, spaced
from ..sources.shared import remove, written_once


def renewed(df: DataFrame, table: DataFrame, key: str, ts: str, at: str, columns: list[str], every_s: float, chunk: float | None = None, tie: str | None = None) -> DataFrame:
    """The rows of a table with `columns` of the lookup table (key, at, ...) and `checked_at`, the time of the lookup that counts."""
    rows = df.withColumn("us", W.micros(ts)).withColumns({"_no": F.lit(False), "_yes": F.col("us").isNotNull()})
    posts = spaced(rows, key, "_no", "_yes", every_s, "_looks")
    seen = Stretches((key,), chunk).scan(posts, last={"_checked": F.when(F.col("_looks"), F.col("us"))})
    told = seen.withColumn("checked_at", F.when(F.col("us").isNotNull(), F.timestamp_micros("_checked"))).select(*df.columns, "checked_at")
    return asof_join(told, table, key, "checked_at", at, columns, tie=tie, chunk=chunk)


def checked_stream(stream: DataFrame, key: str, ts: str, every_s: float, forget_ms: int | None = 86_400_000) -> DataFrame:
    """Adds `checked_at` to the rows of a stream; a key's last lookup is its state, forgotten after a day of silence. Rows of a micro-batch are taken in time order.

    `forget_ms` None keeps keys, for runs that end when their input does (with a timer pending, Spark goes on to make empty batches).
    A row older than the last lookup of its key keeps that lookup's time, so it may see what was written after it.
    """
    every, names = round(every_s * 1e6), stream.columns

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("_us", kind="stable")
        checked = []
        for us in rows["_us"].tolist():
            if last is None or us - last >= every:
                last = us
            checked.append(last)
        state.update((last,))
        if forget_ms is not None:
            state.setTimeoutDuration(forget_ms)
        yield rows[names].assign(_checked=checked)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    known = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("_us", W.micros(ts))
    told = known.groupBy(key).applyInPandasWithState(run, f"{fields}, _checked long", "checked long", "append", GroupStateTimeout.NoTimeout if forget_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
    return told.withColumn("checked_at", F.timestamp_micros("_checked")).drop("_checked")


def write_renewed(stream: DataFrame, read: Callable[[SparkSession], DataFrame], key: str, ts: str, at: str, columns: list[str], every_s: float, sink: Callable[[DataFrame, int], None], tie: str | None = None, forget_ms: int | None = 86_400_000) -> DataStreamWriter:
    """A writer that gives each micro-batch of `renewed` rows to `sink` with its number; start it with a checkpoint.

    `read` is called for each micro-batch, so files that were added since are seen. Of the table, only keys of the batch and rows up to its last lookup
    go into the join. A batch that is run again after a failure has its number, by which a sink can replace what it wrote.
    """

    def one(batch: DataFrame, number: int) -> None:
        rows = written_once(batch, "batch")  # the state is not computed twice
        until = rows.agg(F.max("checked_at")).first()[0]
        keys = rows.select(key).distinct()
        newest = read(rows.sparkSession).where(F.col(at) <= F.lit(until).cast("timestamp")).join(keys, key, "left_semi")
        sink(asof_join(rows, newest, key, "checked_at", at, columns, tie=tie), number)
        remove(rows)

    return checked_stream(stream, key, ts, every_s, forget_ms).writeStream.foreachBatch(one)
