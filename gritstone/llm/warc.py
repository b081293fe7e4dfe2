"""Operator 11: WARC archives as a Python data source of Spark, read and written.

`spark.read.format("warc")` plans partitions from files: small files share one, large ones are cut at record
boundaries that the writer has noted in the folder's list of files. A reader inflates the head of a record first and
holds it against the pushed filters (record type, and any header that is a column of the schema). The payload of a record that
fails, or whose payload is no column of the schema, is stepped over: by Content-Length in plain files, by the member lengths ("sl" extra
field) in compressed ones; foreign compressed files without that field are inflated without being kept.

`archive` writes a record for each page: a `response`, or a `revisit` without payload where another page has the
same payload of at least `LEAST` bytes and a larger page_id. `read_back` reads both kinds again.

Edge cases: a null html is an empty payload; a page without page_id is a response unless a page with an id has its payload, and is
read back with a null page_id; a null url is stood for by an URN; pages that share payload and largest page_id are all
responses, so repeated rows stay as many as they are; payloads are whole, of any length that a row can hold; an empty table
gives archives without pages; columns besides page_id, url and html are not read. Files that are not WARC raise an error.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .frames import SALTS, cut, dealt, heavy_keys, keep, scratched, shared_dir, spread

#: Bytes of equal payloads from which on only one is kept.
LEAST = 1000
#: Bytes of files in a read partition, of records between two noted boundaries, and of a file that the writer ends.
SPLIT, MARK, ROLL = 64 << 20, 16 << 20, 1 << 30
#: The list of a folder's files, their sizes and boundaries. Files that it doesn't name are left from failed tasks.
LIST = "_files.json"
CHUNK = 1 << 20
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4096

#: Columns with names of their own and the headers they hold; of other string columns, `a_b` is header A-B.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
SCHEMA = "record_type string, record_id string, target_uri string, date string, content_type string, payload_digest string, refers_to string, content_length long, payload_length long, headers map<string,string>, payload binary"
#: Columns that are no header.
OTHERS = {"content_length", "payload_length", "headers", "payload"}


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed down to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def files_of(path: str) -> tuple[pafs.FileSystem, str]:
    """A shared file system (file:, hdfs:, s3: and others that Arrow knows) and the place in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (pafs.LocalFileSystem(), path)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], self.options.get("date") or now(), self.options.get("compress", "true") == "true")


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


class Stretches(InputPartition):
    """(file, first byte, end) of some stretches of files; each begins at a record."""


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.columns, self.filters = path, [f.name for f in schema], []
        self.schema = schema

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps filters on headers; Spark evaluates the others."""
        for f in filters:
            if _pushable(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Stretches of files, joined to partitions of about SPLIT bytes."""
        fs, root = files_of(self.path)
        todo, size, out = [], 0, []
        for name, length, marks in listed(fs, root):
            bounds = [0, *marks, length]
            start = 0
            for end in bounds[1:]:
                if end - start >= SPLIT or end == length:
                    if size and size + end - start > SPLIT:
                        out.append(Stretches(todo))
                        todo, size = [], 0
                    todo, size = [*todo, (name, start, end)], size + end - start
                    start = end
        return [*out, Stretches(todo)] if todo or not out else out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, _ = files_of(self.path)
        types = pa.schema([(f.name, pa.map_(pa.string(), pa.string()) if f.name == "headers" else pa.binary() if f.name == "payload" else pa.int64() if f.name in OTHERS else pa.string()) for f in self.schema])
        http = "payload" in self.columns or "payload_length" in self.columns
        rows, size = [], 0
        for name, start, end in partition.value:
            for head, length, body in records(fs, name, start, end, self.wanted):
                block = body(None if "payload" in self.columns else 64 << 10) if http else b""
                rows.append(self.row(head, length, block))
                size += len(block) + 200
                if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield _batch(rows, types)
                    rows, size = [], 0
        if rows:
            yield _batch(rows, types)

    def wanted(self, head: dict[str, str]) -> bool:
        return all(_holds(f, head) for f in self.filters)

    def row(self, head: dict[str, str], length: int, block: bytes) -> tuple:
        is_http = head.get("content-type", "").replace(" ", "").lower().startswith("application/http")
        top = block.find(b"\r\n\r\n") if is_http else -1
        of = {"content_length": length, "headers": list(head.items()), "payload": block[top + 4 :] if top >= 0 else block}
        if "payload_length" in self.columns:
            told = re.search(rb"(?im)^content-length:[ \t]*(\d+)", block[: max(top, 0)])
            of["payload_length"] = int(told[1]) if told else length - (top + 4 if top >= 0 else 0)
        return tuple(of[c] if c in OTHERS else head.get(_header(c)) for c in self.columns)


def _batch(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for f, x in zip(types, zip(*rows, strict=True), strict=True)], schema=types)


def _header(column: str) -> str:
    return HEADERS.get(column, column.replace("_", "-").lower())


def _pushable(f: Filter) -> bool:
    if isinstance(f, Not):
        return _pushable(f.child)
    kinds = (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, StringStartsWith, StringEndsWith, StringContains)
    return isinstance(f, kinds) and len(f.attribute) == 1 and f.attribute[0] not in OTHERS


def _truth(f: Filter, head: dict[str, str]) -> bool | None:
    """What a filter says of a record's head; None if a header that it needs is missing."""
    if isinstance(f, Not):
        said = _truth(f.child, head)
        return None if said is None else not said
    x = head.get(_header(f.attribute[0]))
    if isinstance(f, IsNull | IsNotNull):
        return (x is None) == isinstance(f, IsNull)
    if isinstance(f, EqualNullSafe):
        return x == f.value
    if x is None or (not isinstance(f, In) and f.value is None):
        return None
    if isinstance(f, In):
        return True if x in f.value else None if None in f.value else False
    tests = {EqualTo: x.__eq__, StringStartsWith: x.startswith, StringEndsWith: x.endswith, StringContains: x.__contains__}
    return tests[type(f)](f.value)


def _holds(f: Filter, head: dict[str, str]) -> bool:
    return _truth(f, head) is True


def listed(fs: pafs.FileSystem, root: str) -> list[tuple[str, int, list[int]]]:
    """Files of a folder (or one file) with sizes and noted boundaries."""
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [(root, info.size, [])]
    if fs.get_file_info(f"{root}/{LIST}").type == pafs.FileType.File:
        with fs.open_input_stream(f"{root}/{LIST}") as f:
            return [(f"{root}/{name}", size, marks) for name, size, marks in json.loads(f.read())]
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
    return sorted((x.path, x.size, []) for x in found if x.type == pafs.FileType.File and not x.base_name.startswith(("_", ".")))


def records(fs: pafs.FileSystem, name: str, start: int, end: int, wanted=lambda head: True):
    """(head, content length, read) of the wanted records; read(n) gives the first n bytes of a block, all for None."""
    with fs.open_input_file(name) as f:
        at = start
        while at < end:
            f.seek(at)
            first = f.read(64 << 10)
            squeezed = first[:2] == b"\x1f\x8b"
            source = _Inflated(f, at, first) if squeezed else _Plain(f, at, first)
            raw = source.until(b"\r\n\r\n")
            if not raw.strip() or not squeezed and at + source.blank >= end:  # only blank lines are left before the end
                return
            head = parse_head(raw, name, at)
            length = int(head.get("content-length", 0))
            if wanted(head):
                yield head, length, lambda n, s=source, length=length: s.take(length if n is None else min(n, length))
            at = source.past(length)


def parse_head(raw: bytes, name: str, at: int) -> dict[str, str]:
    """Headers by lower-case name; of repeated ones the first. A folded line goes on the one before."""
    version, *lines = raw.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record at byte {at} of {name}")
    head: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (" ", "\t") and last:
            head[last] += " " + line.strip()
        elif ":" in line:
            key, _, value = line.partition(":")
            last = key.strip().lower()
            head.setdefault(last, value.strip())
    return head


class _Plain:
    """A record of a plain file."""

    def __init__(self, f, at: int, first: bytes) -> None:
        self.f, self.at, self.buffer, self.top, self.blank = f, at, first, 0, 0

    def until(self, sign: bytes) -> bytes:
        """What stands before `sign`, or all that is left of the file; steps past it. Blank lines that come first are skipped."""
        while (i := self.buffer.find(sign, self.skipped())) < 0:
            more = self.more()
            if not more:
                self.top = len(self.buffer)
                return self.buffer
            self.buffer += more
        self.top = i + len(sign)
        return self.buffer[self.blank : i]

    def skipped(self) -> int:
        self.blank = len(self.buffer) - len(self.buffer.lstrip(b"\r\n"))
        return self.blank

    def more(self) -> bytes:
        return self.f.read(CHUNK)

    def take(self, n: int) -> bytes:
        parts, have = [self.buffer[self.top :]], len(self.buffer) - self.top
        while have < n and (more := self.more()):
            parts.append(more)
            have += len(more)
        out = b"".join(parts)[:n]
        if len(out) < n:
            raise ValueError("the archive ends inside of a record")
        return out

    def past(self, length: int) -> int:
        """Where the next record begins, at the blank lines before it or after them."""
        return self.at + self.top + length


class _Inflated(_Plain):
    """A record that is a member of a compressed file."""

    def __init__(self, f, at: int, first: bytes) -> None:
        self.skip = member_length(first)
        self.z, self.fed, self.rest = zlib.decompressobj(31), 0, first
        super().__init__(f, at, b"")

    def more(self) -> bytes:
        while not self.z.eof:
            self.rest = self.rest or self.f.read(CHUNK)
            if not self.rest:
                raise ValueError("the archive ends inside of a compressed record")
            before = len(self.rest)
            out = self.z.decompress(self.rest, CHUNK if self.buffer else 4 << 10)
            left = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            self.fed += before - len(left)
            self.rest = left
            if out:
                return out
        return b""

    def past(self, length: int) -> int:
        if self.skip:
            return self.at + self.skip
        while self.more():  # a foreign file: its members tell no length
            pass
        return self.at + self.fed


def member_length(first: bytes) -> int:
    """Bytes of a compressed member by its "sl" extra field, 0 if it has none."""
    if len(first) < 24 or not first[3] & 4:
        return 0
    size, at = struct.unpack_from("<H", first, 10)[0], 12
    stop = min(12 + size, len(first))
    while at + 4 <= stop:
        field, n = first[at : at + 2], struct.unpack_from("<H", first, at + 2)[0]
        if field == b"sl" and n == 8 and at + 12 <= stop:
            return struct.unpack_from("<I", first, at + 4)[0]
        at += 4 + n
    return 0


def member(record: bytes, level: int = 4) -> bytes:
    """A record as a member of a gzip file that tells its lengths; 0 stands for lengths that don't fit."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    size = 24 + len(body) + 8
    lengths = struct.pack("<II", *(n if n < 1 << 32 else 0 for n in (size, len(record))))
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<H", 8) + lengths + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def http_block(payload: bytes, length: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length + payload


def record(headers: dict[str, str | None], block: bytes) -> bytes:
    """A record with its blank lines; headers without a value are left out, line ends in values become blanks."""
    lines = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in headers.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, int, list[int]]]) -> None:
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Rows with record_type, record_id, target_uri, payload, payload_digest, payload_length and refers_to become records.

    Each task writes files under names of its own; the commit lists those of the tasks that counted, so what a lost or repeated task
    left behind is never read.
    """

    def __init__(self, path: str, date: str, compress: bool) -> None:
        self.path, self.date, self.compress = path, date, compress

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = files_of(self.path)
        fs.create_dir(root, recursive=True)
        done, out = [], None
        try:
            for batch in iterator:
                for row in _rows(batch):
                    if out is None:
                        out = _File(fs, root, self.compress, self.date)
                    out.add(page_record(row, self.date))
                    if out.at >= ROLL:
                        done.append(out.close())
                        out = None
            return Written([*done, out.close()] if out else done)
        except BaseException:
            if out:
                done.append(out.close())
            for name, *_ in done:
                fs.delete_file(f"{root}/{name}")
            raise

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = files_of(self.path)
        fs.create_dir(root, recursive=True)
        files = listed_names(fs, root) + [f for m in messages if m for f in m.files]
        with fs.open_output_stream(f"{root}/{LIST}") as f:
            f.write(json.dumps(files).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = files_of(self.path)
        for m in filter(None, messages):
            for name, *_ in m.files:
                fs.delete_file(f"{root}/{name}")


def listed_names(fs: pafs.FileSystem, root: str) -> list:
    """What a folder's list has so far, for appending writes."""
    if fs.get_file_info(f"{root}/{LIST}").type != pafs.FileType.File:
        return []
    with fs.open_input_stream(f"{root}/{LIST}") as f:
        return json.loads(f.read())


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    columns = [batch.column(i) for i in range(batch.num_columns)]
    for i in range(batch.num_rows):
        yield {n: c[i].as_py() for n, c in zip(batch.schema.names, columns, strict=True)}


class _File:
    def __init__(self, fs: pafs.FileSystem, root: str, compress: bool, date: str) -> None:
        self.name = f"part-{uuid.uuid4().hex}.warc" + (".gz" if compress else "")
        self.f, self.compress, self.at, self.marks = fs.open_output_stream(f"{root}/{self.name}", compression=None), compress, 0, []
        info = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<{uuid.uuid4().urn}>", "WARC-Date": date, "WARC-Filename": self.name, "Content-Type": "application/warc-fields"}
        self.add(record(info, b"software: gritstone\r\nformat: WARC File Format 1.1\r\n"))

    def add(self, raw: bytes) -> None:
        if self.at - (self.marks[-1] if self.marks else 0) >= MARK:
            self.marks.append(self.at)
        raw = member(raw) if self.compress else raw
        self.f.write(raw)
        self.at += len(raw)

    def close(self) -> tuple[str, int, list[int]]:
        self.f.close()
        return self.name, self.at, self.marks


def page_record(row: dict, date: str) -> bytes:
    """A response, or a revisit, which has the HTTP head of its payload only."""
    revisit = row["record_type"] == "revisit"
    headers = {
        "WARC-Type": row["record_type"], "WARC-Record-ID": f"<{row['record_id']}>", "WARC-Date": date, "WARC-Target-URI": row["target_uri"], "WARC-Payload-Digest": row["payload_digest"],
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None, "WARC-Refers-To": f"<{row['refers_to']}>" if row.get("refers_to") else None, "Content-Type": "application/http; msgtype=response",
    }
    return record(headers, http_block(b"" if revisit else row["payload"] or b"", row["payload_length"]))


# What follows is the operator on pages.


def page_urn(page_id) -> F.Column:
    """The record id of a page, which its id can be read from; the digest keeps ids of repeated page_ids apart."""
    return F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(":"), F.col("digest"))


def id_of(urn) -> F.Column:
    """The page_id in a record id, null if the page had none."""
    return F.regexp_extract(urn, "urn:page:(-?[0-9]+):", 1).try_cast("long")


def _uri(url: pa.Array, ids: pa.Array) -> list[str]:
    return [quote(u, safe="%:/?#[]@!$&'()*+,;=-._~") if u else f"urn:page:{i}" for u, i in zip(url.to_pylist(), ids.to_pylist(), strict=True)]


def planned(pages: DataFrame) -> DataFrame:
    """Each page with its payload, digest and kind of record.

    A first pass keeps, for payloads found more than once, their largest page_id: one short row a payload. A second deals the pages by
    digest; frequent payloads are known to all tasks, are dropped where they'd be a revisit's, and are dealt over several tasks.
    """
    raw = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), raw.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "bytes": F.length("payload").cast("long")})
    counts = cut(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("last"), F.max("bytes").alias("size")).where("n > 1"), "payloads")
    total = pages.select(F.count(F.lit(1))).first()[0]
    heavy = heavy_keys(counts, "digest", "n", total)  # fewer than HEAVY rows
    last = counts.where(F.col("size") >= LEAST).select("digest", "last")
    known = cut(last.join(F.broadcast(heavy.select("digest")), "digest"), "heavy-last")  # fewer than HEAVY rows
    slim = rows.join(F.broadcast(known.withColumnRenamed("last", "soon")), "digest", "left")
    kind = lambda c: F.coalesce(F.col("page_id") < F.col(c), F.col("page_id").isNull() & F.col(c).isNotNull())
    slim = slim.withColumn("payload", F.when(~kind("soon"), F.col("payload"))).drop("soon").withColumn("order", F.monotonically_increasing_id())
    joined = dealt(slim, heavy, "digest", "order").join(spread(last, heavy, "digest"), ["digest", "salt"], "left")
    return joined.withColumn("revisit", kind("last")).select("page_id", "url", "payload", "digest", "bytes", "revisit", F.when(kind("last"), F.col("last")).alias("last"))


@scratched
def archive(pages: DataFrame, path: str, compress: bool = True) -> None:
    """Write the pages (page_id, url, html) to `path` as WARC files."""
    spark = pages.sparkSession
    register(spark)
    kind = F.when(F.col("revisit"), "revisit").otherwise("response")
    named = planned(pages).select(
        kind.alias("record_type"), page_urn(F.col("page_id")).alias("record_id"), F.col("url"), F.col("page_id"), F.when(~F.col("revisit"), F.col("payload")).alias("payload"), F.col("digest"), F.col("bytes").alias("payload_length"),
        F.when(F.col("revisit"), page_urn(F.col("last"))).alias("refers_to"),
    )

    def headed(batches):
        for b in batches:
            digests = [f"sha1:{base64.b32encode(bytes.fromhex(x)).decode()}" for x in b.column("digest").to_pylist()]
            kept = {n: b.column(n) for n in ("record_type", "record_id", "payload", "payload_length", "refers_to")}
            yield pa.RecordBatch.from_pydict({**kept, "target_uri": pa.array(_uri(b.column("url"), b.column("page_id")), pa.string()), "payload_digest": pa.array(digests, pa.string())})

    out = named.mapInArrow(headed, "record_type string, record_id string, payload binary, payload_length long, refers_to string, target_uri string, payload_digest string")
    out.write.format("warc").mode("append").option("compress", str(compress).lower()).option("date", now()).save(path)


def read(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """Records of an archive; only the columns named in `schema` are made, and payloads only if it names them."""
    register(spark)
    return spark.read.format("warc").schema(schema).load(path)


def _plain_digests(batches):
    for b in batches:
        found = [base64.b32decode(x.removeprefix("sha1:")).hex() for x in b.column("payload_digest").to_pylist()]
        yield b.set_column(b.schema.get_field_index("payload_digest"), "payload_digest", pa.array(found, pa.string()))


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page in an archive.

    Payloads of responses are read and hashed anew; of revisits only heads are read, which tell length and digest of the full payload.
    """
    whole = read(spark, path, "record_type string, record_id string, payload binary").where("record_type = 'response'")
    full = whole.select("record_id", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("string").alias("refers_to"))
    heads = read(spark, path, "record_type string, record_id string, payload_digest string, payload_length long, refers_to string").where("record_type = 'revisit'")
    short = heads.select("record_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    both = full.unionByName(short.mapInArrow(_plain_digests, short.schema))
    return both.select(id_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", id_of(F.col("refers_to")).alias("refers_to"))


@scratched
def round_trip(pages: DataFrame) -> DataFrame:
    """Archive the pages in the shared folder, read them back, and remove the archive."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    store.deleteOnExit(where)
    try:
        archive(pages, path)
        out = cut(read_back(spark, path), "warc-back")
    finally:
        store.delete(where, True)
    keep(out)
    return out


def round_trip_sql() -> str:
    """The same rows from the table alone."""
    return f"""with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as d from pages),
w as (select *, max(page_id) over (partition by d) as last from p)
select page_id, n::bigint as payload_bytes, d as payload_digest, case when n >= {LEAST} and page_id < last then 'revisit' else 'response' end as record_type, case when n >= {LEAST} and page_id < last then last end as refers_to from w"""
