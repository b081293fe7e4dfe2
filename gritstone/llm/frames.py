"""Small helpers that the operators of this package share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps
from weakref import WeakKeyDictionary

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which the cluster names in spark.checkpoint.dir.

    Where it is unset, a folder of this machine serves if all of Spark runs on it, as in tests; else this fails.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gritstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Where the tables lie that frames were read back from.
_path_of: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


class Scratch:
    """Tables that a block of code, and blocks inside it, have written to the shared folder."""

    def __init__(self) -> None:
        self.written: list[str] = []
        self.passed: list[str] = []
        self.kept: list[str] = []

    def keep(self, *frames: DataFrame) -> None:
        """Tables of these frames, as `cut` returned them, outlive the block."""
        self.kept += [_path_of[x] for x in frames]

    def keep_passed(self) -> None:
        """So do the tables that blocks inside have kept."""
        self.kept += self.passed


_block: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Tables cut inside go at the block's end or failure. Those kept pass to the block around it, if any.

    Each thread of the driver has its own blocks, so runs side by side leave each other's tables alone.
    """
    own, outer = Scratch(), _block.get()
    token = _block.set(own)
    kept: list[str] = []
    try:
        yield own
        kept = own.kept
    finally:
        _block.reset(token)
        for path in {*own.written, *own.passed} - {*kept}:
            _remove(spark, path)
        if outer is not None:
            outer.passed += kept


def scratched(operator: Callable) -> Callable:
    """Runs an operator in a block of its own; it names what its result still reads by `keep`."""

    @wraps(operator)
    def run(df: DataFrame, *args, **kwargs):
        with scratch(df.sparkSession):
            return operator(df, *args, **kwargs)

    return run


def keep(*frames: DataFrame) -> None:
    """In an operator's block: tables of these frames outlive it."""
    _block.get().keep(*frames)


def discard(df: DataFrame) -> None:
    """Remove the table that a frame was read back from, once nothing reads it any more; other frames have none."""
    if path := _path_of.pop(df, None):
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back, which ends its lineage.

    A lost executor later costs a re-read of files and not a re-run of what made them. The files go with the
    `scratch` block they were made in; those of a lazy result stay for its readers and go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if (own := _block.get()) is not None:
        own.written.append(path)  # first, as the write may fail half-way
    df.write.parquet(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


#: A key with more than one in HEAVY of all rows is heavy, so there are fewer than HEAVY; its rows are dealt over SALTS tasks.
HEAVY, SALTS = 1000, 64


def heavy_keys(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Of the keys and their row counts, the heavy ones: fewer than HEAVY rows, so they may be broadcast."""
    return cut(counts.where(F.col(n) > total / HEAVY).select(key, F.lit(True).alias("heavy")), "heavy")


def dealt(rows: DataFrame, heavy: DataFrame, key: str, by: str) -> DataFrame:
    """`rows` with a salt, from column `by`, for heavy keys; 0 for others."""
    marked = rows.join(F.broadcast(heavy), key, "left")  # fewer than HEAVY rows
    return marked.withColumn("salt", F.when(F.col("heavy"), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0)).drop("heavy")


def spread(rows: DataFrame, heavy: DataFrame, key: str) -> DataFrame:
    """`rows`, one a key, with one copy for each salt of a heavy key: the other side of a join on key and salt."""
    marked = rows.join(F.broadcast(heavy), key, "left")  # fewer than HEAVY rows
    return marked.withColumn("salt", F.explode(F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("heavy")


def join_dealt(rows: DataFrame, one_a_key: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join of a written table with rows that are one a key, heavy keys dealt over tasks."""
    heavy = heavy_keys(rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows")), key, "rows", rows.count())
    return dealt(rows, heavy, key, by).join(spread(one_a_key, heavy, key), [key, "salt"]).drop("salt")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the data folder with only the named columns."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def quoted(name: str) -> str:
    """A column's name where Spark parses it: dots and quotes are part of the name."""
    return "`" + name.replace("`", "``") + "`"


def documents(df: DataFrame, *others: str) -> DataFrame:
    """doc_id and text of any frame that has them; whatever else it has stays out of the plan."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *others)


_held: dict = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """What `make()` gives, kept in a worker process for its next tasks, until an operator with another key runs in it.

    Workers serve one operator after another, so what all of them keep would add up.
    """
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def pieces(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text each, at least one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_text(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, column: str = "text") -> DataFrame:
    """Run `make()` once per task and its result on bounded slices of Arrow batches.

    The function gets a slice and returns columns by name; they are cast to `schema`.
    """
    struct = T._parse_datatype_string(schema)
    fields = [(f.name, f.dataType.simpleString()) for f in struct.fields]

    def run(batches):
        step = make()
        types = arrow_schema(fields)
        for batch in batches:
            for part in pieces(batch, column):
                got = step(part)
                yield pa.RecordBatch.from_arrays([x if isinstance(x := got[f.name], pa.Array) else pa.array(x, f.type) for f in types], schema=types)

    return df.mapInArrow(run, struct)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], column: str = "text") -> DataFrame:
    """Like `map_text` for functions that return rows of `df`'s own schema; the text column becomes a string.

    Names that Spark can't pass to a Python function as they are, such as those with dots, are replaced meanwhile.
    """
    names = df.columns
    plain = [n if n.isidentifier() else f"_column_{i}_{uuid.uuid4().hex}" for i, n in enumerate(names)]
    typed = df.toDF(*plain).withColumn(column, F.col(column).cast("string"))

    def run(batches):
        step = make()
        for batch in batches:
            for part in pieces(batch, column):
                yield step(part)

    return typed.mapInArrow(run, typed.schema).toDF(*names)


def arrow_schema(fields: list[tuple[str, str]]) -> pa.Schema:
    """Arrow's types for the few Spark types that these operators return."""
    plain = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}

    def of(kind: str) -> pa.DataType:
        if kind.startswith("array<struct<"):
            return pa.list_(pa.struct([(k, of(v)) for k, v in (x.split(":") for x in kind[13:-2].split(","))]))
        return pa.list_(of(kind[6:-1])) if kind.startswith("array<") else plain[kind]

    return pa.schema([(name, of(kind)) for name, kind in fields])
