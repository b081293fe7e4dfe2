"""Upserts, idempotent inserts, ordered dedupe, updates and deletes as new frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], newest: Column) -> DataFrame:
    """`target` with the rows of `changes` in place of those of equal keys, or added.

    Columns that `changes` lacks keep the target's values. Of several changes of one key the one with the
    greatest `newest` counts.
    """
    w = Window.partitionBy(*keys).orderBy(newest.desc())
    last = changes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").withColumn("_sent", F.lit(True))
    t, c = target.alias("t"), last.alias("c")
    both = t.join(c, [F.col(f"t.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys], "full")
    sent = F.col("c._sent").isNotNull()
    return both.select(*(F.when(sent, F.col(f"c.{x}")).otherwise(F.col(f"t.{x}")).alias(x) if x in changes.columns else F.col(f"t.{x}").alias(x) for x in target.columns))


def insert_new(target: DataFrame, rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """`target` and those rows whose keys it lacks; of equal new keys the first by `order`."""
    w = Window.partitionBy(*keys).orderBy(order)
    fresh = rows.join(target.select(*keys), keys, "left_anti").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return target.unionByName(fresh)


def union_first(keys: list[str], *frames: DataFrame, order: list[Column]) -> DataFrame:
    """Union with one row a key: from the earliest frame that has it, then by `order`."""
    tagged = [f.withColumn("_from", F.lit(i)) for i, f in enumerate(frames)]
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f)
    w = Window.partitionBy(*keys).orderBy("_from", *order)
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_from")


def update(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    """New values where a condition holds (NULL: it doesn't)."""
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in values.items()})


def delete(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False)))


def change_counts(df: DataFrame, **steps: Column) -> DataFrame:
    """How many rows each step would change, and their first and last id, before any is applied."""
    return df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in steps.items()))


def apply_changes(table: DataFrame, feed: DataFrame, key: str, seq: str, op: str) -> DataFrame:
    """A change feed on a table: the last change of a key counts; op 'delete' removes, others replace or add."""
    w = Window.partitionBy(key).orderBy(F.desc(seq))
    last = feed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    kept = table.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where(F.col(op) != "delete").select(*table.columns))
