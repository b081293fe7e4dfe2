"""Frames that several others read, written once to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_path_of: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, one of this machine if all of Spark runs on it; else this fails."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written_once(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a table and read back, which ends its lineage; a lost executor costs a re-read.

    The table goes with `remove`, and at the latest when the application ends.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


def remove(*frames: DataFrame) -> None:
    """Remove the tables of frames that nothing reads any more; frames without one are left."""
    for df in frames:
        if path := _path_of.pop(df, None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
