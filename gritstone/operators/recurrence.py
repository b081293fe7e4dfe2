"""Recurrences over ordered rows of a key: each value needs the one before, so no window can say them.

Rows are dealt by key and sorted; a task carries one number from row to row, whatever the
length of a series. Nulls: a null key is a key of its own, a null input keeps the last value.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def carried(df: DataFrame, key: str, order: list[str], inputs: list[str], step: Callable[..., float | None], name: str) -> DataFrame:
    """Adds `name`: step(value of the key's row before, *inputs); the first row of a key gets None for it."""

    def run(batches):
        now, x = object(), None
        for batch in batches:
            out = []
            for k, *values in zip(*(batch.column(c).to_pylist() for c in (key, *inputs)), strict=True):
                x = step(x if k == now else None, *values)
                now = k
                out.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, name])

    dealt = df.repartition(key).sortWithinPartitions(key, *order)
    return dealt.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def follow(df: DataFrame, key: str, order: list[str], target: str, alpha: float, name: str, noise: str | None = None) -> DataFrame:
    """First-order recurrence towards a target: x = alpha * x before + (1 - alpha) * target + noise; starts at the first target."""

    def step(x, goal, extra=None):
        if x is None or goal is None:
            return goal if x is None else x
        return alpha * x + (1 - alpha) * goal + (extra or 0.0)

    return carried(df, key, order, [target, *([noise] if noise else [])], step, name)


def bounded_walk(df: DataFrame, key: str, order: list[str], change: str, name: str, start: float = 0.5, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Running sum of changes that stays within limits; the first row is at `start`."""

    def step(x, delta):
        return start if x is None else min(high, max(low, x + (delta or 0.0)))

    return carried(df, key, order, [change], step, name)
