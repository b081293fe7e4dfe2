"""Aggregates that need more than one built-in function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_mean(x: Column, weight: Column) -> Column:
    """Mean of x by weight over rows that have both, with positive weight."""
    ok = x.isNotNull() & (weight > 0)
    return F.try_divide(F.sum(F.when(ok, x * weight)), F.sum(F.when(ok, weight)))


def ratio(a: Column, b: Column) -> Column:
    """Ratio of two sums, NULL unless the lower is positive."""
    return F.when(F.sum(b) > 0, F.sum(a) / F.sum(b))


def most(label: Column, weight: Column) -> Column:
    """Label of the greatest weight; of equal weights the smallest label."""
    ranked = F.min(F.struct((-weight).alias("w"), label.alias("label")))
    return ranked["label"]


def row_max(columns: dict[str, Column]) -> tuple[Column, Column]:
    """Greatest of a row's columns without NULLs, and its name; of equals the first named."""
    items = F.filter(F.array(*(F.struct(c.alias("x"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, (n, c) in enumerate(columns.items()))), lambda s: s["x"].isNotNull())
    top = F.array_max(items)
    return top["x"], top["n"]


def worst(level: Column, ranks: dict[str, int]) -> Column:
    """The level of highest rank in a group; unknown levels don't count."""
    table = F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv))
    return F.max(F.struct(table[level].alias("rank"), level.alias("level")))["level"]


def at_rank(df: DataFrame, keys: list[str], value: str, rank: Column, name: str) -> DataFrame:
    """One row a group: the value at a rank from 1 on, in rising order; `rank` may use the group's count, `n`. NULLs don't count.

    Values are counted first, so a group travels as its distinct values. Their counts are summed up in order: in one sorted
    window a group, which is never held whole, or without keys in buckets of values side by side (`windows.running_totals`).
    """
    from .windows import running_totals

    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_k"))
    if keys:
        upto = counts.withColumn("_upto", F.sum("_k").over(Window.partitionBy(*keys).orderBy(value)))
        return upto.join(counts.groupBy(*keys).agg(F.sum("_k").alias("n")), keys).where(F.col("_upto") >= rank).groupBy(*keys).agg(F.min(value).alias(name))
    down = running_totals(counts, value, ["_k"])  # from the highest value on
    return down.join(F.broadcast(counts.agg(F.sum("_k").alias("n")))).where(F.col("total__k") > F.col("n") - rank).agg(F.max(value).alias(name))  # one row


def quantile_higher(df: DataFrame, keys: list[str], value: str, p: float, name: str) -> DataFrame:
    """One row a group: the smallest value with at least the share p of ranks below or at it."""
    return at_rank(df, keys, value, F.ceil(F.lit(p) * (F.col("n") - 1)) + 1, name)


def intraclass(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: mean within-group variance, variance of group means, and the share of the latter (ICC 1).

    Groups of one row have no variance and stay out of the mean within.
    """
    each = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.var_samp(value).alias("v"), F.avg(value).alias("m"))
    return each.agg(F.avg(F.when(~F.isnan("v"), F.col("v"))).alias("within"), F.var_samp("m").alias("between")).withColumn("icc", F.try_divide(F.col("between"), F.col("between") + F.col("within")))


def spine_counts(df: DataFrame, bucket: Column, low: int, high: int, group: str) -> DataFrame:
    """Counts for every group and every bucket from low to high, zeros included."""
    groups = df.select(group).distinct()
    spine = groups.withColumn("bucket", F.explode(F.sequence(F.lit(low), F.lit(high))))
    counts = df.withColumn("bucket", bucket.cast("int")).groupBy(group, "bucket").agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counts, [group, "bucket"], "left").select(group, "bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def binary_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: precision, recall and F1 of 0/1 columns."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    counts = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    precision, recall = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select("tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def forecast_errors(df: DataFrame, actual: str, middle: str, low: str, high: str) -> DataFrame:
    """One row: mean absolute error, the same in percent, and the share of actual values within the interval."""
    a, m = F.col(actual), F.col(middle)
    return df.agg(F.avg(F.abs(a - m)).alias("mae"), (100 * F.avg(F.abs(a - m) / F.nullif(F.abs(a), F.lit(0.0)))).alias("mape"), F.avg(((a >= F.col(low)) & (a <= F.col(high))).cast("double")).alias("coverage"))


def average_precision(df: DataFrame, truth: str, score: str) -> DataFrame:
    """One row: area under precision and recall by steps; equal scores are one step.

    Counts by distinct score come first, so the running sums go over distinct scores only.
    """
    from .windows import running_totals

    each = df.groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(F.col(truth).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    steps = running_totals(each, "score", ["pos", "n"]).withColumnsRenamed({"total_pos": "tp", "total_n": "seen"})
    return steps.agg(F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("seen")), F.sum("pos")).alias("average_precision"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: adjusted Rand index of two labellings."""
    pairs = lambda n: n * (n - 1) / 2
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("cells"), F.sum("n").alias("total"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("rows"))
    columns = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("columns"))
    one = both.join(F.broadcast(rows)).join(F.broadcast(columns))  # a row each
    expected = F.col("rows") * F.col("columns") / pairs(F.col("total"))
    return one.select(F.try_divide(F.col("cells") - expected, (F.col("rows") + F.col("columns")) / 2 - expected).alias("ari"))
