"""Where query modules put their queries and SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name; `sql` is the same query for DuckDB."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = wraps(f)(lambda spark, sf_dir: naive(f(spark, sf_dir)))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table with only the columns a query needs; times without zone become UTC times."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def naive(df: DataFrame) -> DataFrame:
    """Times without zone again, as the tables have them; days are their midnight."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in df.dtypes if kind in ("timestamp", "date")})


def events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The event stream with its time in microseconds as `us`."""
    wanted = columns or ("event_id", "ts", "user_id", "event_type", "value")
    return table(spark, sf_dir, "events", *dict.fromkeys([*wanted, "ts"])).withColumn("us", F.unix_micros("ts"))
