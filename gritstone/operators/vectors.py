"""Vector distance and exact top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, NULL where a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def match_vectors(vectors: DataFrame, key: str, vector: str, query: list[float], k: int = 4, least: float = 0.3) -> DataFrame:
    """The k nearest rows to one query by cosine, at least `least` similar; ties by key."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.select(key, cosine(F.col(vector), q).alias("similarity")).where(F.col("similarity") >= least)
    return scored.orderBy(F.desc("similarity"), key).limit(k)


#: Queries that may travel to every task.
MOST_QUERIES = 1000


def top_k_per_query(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """For a bounded set of queries: query, the k nearest other rows and ranks.

    Queries travel as one array to every row, so more than `MOST_QUERIES` are refused; scoring and the
    k best of a task need no shuffle of the vectors.
    """
    if queries.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries: deal them out in parts")
    held = queries.select(F.struct(F.col(key).alias("q"), F.col(vector).alias("v")).alias("q")).agg(F.collect_list("q").alias("qs"))
    scored = vectors.join(F.broadcast(held)).select(key, vector, F.explode("qs").alias("one")).where(F.col("one.q") != F.col(key))
    scored = scored.select(F.col("one.q").alias("query_id"), key, cosine(F.col(vector), F.col("one.v")).alias("similarity"))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def within_distance(rows: DataFrame, vector: str, centres: list[list[float]], radius: float) -> Column:
    """Whether any of a few fixed centres is within a radius (a row that none is near to is noise)."""
    from functools import reduce

    tests = [F.sqrt(F.aggregate(F.zip_with(_double(F.col(vector)), F.array(*(F.lit(float(x)) for x in c)), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)) <= radius for c in centres]
    return reduce(lambda a, b: a | b, tests)
