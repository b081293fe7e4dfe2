"""Standardised scores, bands and top contributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fit_scales(df: DataFrame, groups: list[str], columns: list[str], population: bool = True, least: int = 0) -> DataFrame:
    """mean_c and std_c of each group; a deviation of zero counts as 1, and with few rows there is no scale."""
    std = F.stddev_pop if population else F.stddev_samp
    out = []
    for c in columns:
        enough = F.count(c) > least
        out += [F.when(enough, F.avg(c)).alias(f"mean_{c}"), F.when(enough, F.coalesce(F.nullif(std(c), F.lit(0.0)), F.lit(1.0))).alias(f"std_{c}")]
    return df.groupBy(*groups).agg(*out)


def z_scores(df: DataFrame, scales: DataFrame, groups: list[str], columns: dict[str, float]) -> DataFrame:
    """Adds z_c, signed by each column's bad direction; groups without scale have NULL."""
    joined = df.join(scales, groups, "left")
    return joined.withColumns({f"z_{c}": F.lit(float(sign)) * (F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}") for c, sign in columns.items()}).drop(*(f"{p}_{c}" for c in columns for p in ("mean", "std")))


def global_z(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds z_c against all rows; the scales are one row."""
    scales = df.agg(*(f(c).alias(f"{p}_{c}") for c in columns for p, f in (("mean", F.avg), ("std", F.stddev_pop))))
    return df.join(F.broadcast(scales)).select(*df.columns, *(((F.col(c) - F.col(f"mean_{c}")) / F.nullif(F.col(f"std_{c}"), F.lit(0.0))).alias(f"z_{c}") for c in columns))


def index(weights: dict[str, float]) -> Column:
    """Weighted sum of columns; NULL counts as 0."""
    return sum((F.lit(w) * F.coalesce(F.col(c), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))


def top_by_size(values: dict[str, Column], n: int) -> Column:
    """Structs (name, value) of the n values of greatest size; of equals the first named, NULLs out."""
    items = F.array(*(F.struct((-F.abs(v)).alias("k"), F.lit(i).alias("i"), F.lit(name).alias("name"), v.alias("value")) for i, (name, v) in enumerate(values.items())))
    return F.transform(F.slice(F.array_sort(F.filter(items, lambda x: x["value"].isNotNull())), 1, n), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))


def top_contributions(values: dict[str, Column], n: int) -> Column:
    """The n largest positive contributions, or, if there are none, the n of greatest size."""
    items = F.array(*(F.struct((-v).alias("k"), F.lit(i).alias("i"), F.lit(name).alias("name"), v.alias("value")) for i, (name, v) in enumerate(values.items())))
    positive = F.transform(F.slice(F.array_sort(F.filter(items, lambda x: x["value"] > 0)), 1, n), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))
    return F.when(F.size(positive) > 0, positive).otherwise(top_by_size(values, n))


def min_max(x: Column, low: float, high: float) -> Column:
    """0 to 1 between two bounds."""
    return F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def rank_desc(groups: list[str], score: str) -> Column:
    return F.rank().over(Window.partitionBy(*groups).orderBy(F.col(score).desc_nulls_last()))
