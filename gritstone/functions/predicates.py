"""Predicates and conditional columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def half_open(ts: str, start: str, end: str) -> Column:
    """[start, end) of a timestamp column."""
    return (F.col(ts) >= F.lit(start).cast("timestamp")) & (F.col(ts) < F.lit(end).cast("timestamp"))


def closed(ts: str, start: str, end: str) -> Column:
    return F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))


def threshold(x: Column, levels: dict[str, float], above: bool = True, gate: tuple[Column, float] | None = None) -> dict[str, Column]:
    """For each level whether the value is beyond its limit, while the gate signal, if any, is over its own."""
    open_ = F.coalesce(gate[0] > gate[1], F.lit(False)) if gate else F.lit(True)
    return {name: F.coalesce((x > limit if above else x < limit) & open_, F.lit(False)) for name, limit in levels.items()}


def one_hot(column: str, values: list[str]) -> dict[str, Column]:
    return {v: (F.col(column) == v).cast("int") for v in values}


def known(column: str, levels: list[str]) -> Column:
    """The value if it is among the levels, else NULL."""
    return F.when(F.col(column).isin(*levels), F.col(column))


def bands(x: Column, floors: list[tuple[float, str]], below: str) -> Column:
    """The name of the first floor that a value reaches, highest first."""
    return reduce(lambda c, f: c.when(x >= f[0], f[1]), floors[1:], F.when(x >= floors[0][0], floors[0][1])).otherwise(below)


def visible(df: DataFrame, owner: Column, me, manager: bool) -> DataFrame:
    """Rows that a user may see: their own, or all of them for a manager."""
    return df if manager else df.where(owner == F.lit(me))


def is_false(x: Column) -> Column:
    """Only an explicit false counts."""
    return F.coalesce(~x, F.lit(False))
