"""Reading and writing tables: CSV and parquet with declared schemas, paging, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.text import brace_literal, read_brace_literal
from .schemas import schema


def read_csv(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A fleet table from CSV with a header; arrays are brace literals, empty fields are null."""
    wanted = schema(name)
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return raw.select(*(_typed(F.col(f.name), f.dataType).alias(f.name) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted.fields))


def _typed(x: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        return read_brace_literal(x).cast(kind)
    if isinstance(kind, T.StructType):
        return F.from_json(x, kind)
    if isinstance(kind, T.DoubleType):
        return F.nullif(x.try_cast("double"), F.lit("NaN").cast("double"))
    return x.try_cast(kind.simpleString())


def write_csv(df: DataFrame, path: str, name: str, scales: dict[str, int] | None = None) -> None:
    """In the table's column order, half-even rounded, arrays as brace literals."""

    def shown(f: T.StructField) -> Column:
        x = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType):
            return brace_literal(x.cast("array<string>"))
        if isinstance(f.dataType, T.StructType):
            return F.to_json(x)
        return F.bround(x, scales[f.name]) if scales and f.name in scales else x

    df.select(*(shown(f).alias(f.name) for f in schema(name).fields if f.name in df.columns)).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_parquet(spark: SparkSession, path: str, *columns: str, where: Column | None = None) -> DataFrame:
    """Only the named columns and rows; both reach the scan."""
    df = spark.read.parquet(path)
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, *partitions: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "zstd").partitionBy(*partitions).parquet(path)


def first_of(spark: SparkSession, table: str, path: str) -> DataFrame:
    """A catalog table if it is there, else the files."""
    try:
        return spark.table(table)
    except AnalysisException:
        return spark.read.parquet(path)


def page(df: DataFrame, key: str, value: object, ts: str, after: object, until: object = None, n: int = 1000) -> DataFrame:
    """The next rows of a key after a time, oldest first."""
    got = df.where((F.col(key) == F.lit(value)) & (F.col(ts) > F.lit(after)))
    return (got.where(F.col(ts) <= F.lit(until)) if until is not None else got).orderBy(ts).limit(n)


def key_range(df: DataFrame, key: str, values: list, ts: str, start: object, end: object) -> DataFrame:
    """Rows of some keys in [start, end)."""
    return df.where(F.col(key).isin(*values) & (F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)))


def normalise(df: DataFrame, name: str) -> DataFrame:
    """Columns of any type as the table's types: what can't be read is null, NaN is null, other columns go."""
    out = []
    for f in schema(name).fields:
        x = F.col(f.name) if f.name in df.columns else F.lit(None)
        x = x.try_cast(f.dataType.simpleString()) if not isinstance(f.dataType, T.ArrayType | T.StructType) else x.cast(f.dataType)
        out.append((F.when(~F.isnan(x), x) if isinstance(f.dataType, T.DoubleType) else x).alias(f.name))
    return df.select(*out)


def markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of markdown files."""
    return spark.read.option("wholetext", True).option("pathGlobFilter", "*.md").text(folder).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def last_dates(df: DataFrame, column: str, days: int) -> DataFrame:
    """Rows of the last so many dates that occur, counted back from the newest."""
    newest = df.agg(F.max(column).alias("_newest"))  # one row
    return df.join(F.broadcast(newest)).where(F.col(column) > F.date_sub("_newest", days)).drop("_newest")


def null_orphans(df: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """References that the target lacks become null."""
    known = target.select(F.col(key).alias("_known")).distinct()
    return df.join(known, F.col(column) == F.col("_known"), "left").withColumn(column, F.col("_known")).drop("_known").select(*df.columns)
