import gzip
import hashlib
import random
import re

import pyarrow as pa
import pytest

from gritstone.llm import warc

PAGES = "page_id long, url string, html string, payload string, digest int, `a.b` string"


def brute(rows):
    raw = [(i, (html or "").encode()) for i, html in rows]
    last = {}
    for i, x in raw:
        if i is not None:
            last[x] = max(last.get(x, i), i)
    out = []
    for i, x in raw:
        again = len(x) >= warc.LEAST and x in last and (i is None or i < last[x])
        out.append((i, len(x), hashlib.sha1(x).hexdigest(), "revisit" if again else "response", last[x] if again else None))
    return sorted(out, key=str)


def test_round_trip_equals_brute_force(spark):
    """Hot copies, nulls in every column, short copies, a very long page, repeated rows, text like record ends, odd urls."""
    rng = random.Random(4)
    trap = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(i, f"<p>{rng.random()} {'é' * rng.randrange(900)}</p>") for i in range(300)]
    rows += [(1000 + i, "x" * 1200) for i in range(400)] + [(2000 + i, "short" * 30) for i in range(50)] + [(2100 + i, None) for i in range(20)]
    rows += [(3000, "y" * 5_000_000), (3001, "y" * 5_000_000), (3002, trap * 40), (3003, trap * 40), (None, "x" * 1200), (None, "z" * 2000), (None, "z" * 2000), (None, None)]
    rows += [(3004, "w" * 999), (3005, "w" * 999), (3006, "w" * 1000), (3007, "w" * 1000), (-5, "w" * 1000), (4000, "v" * 1000), (4000, "v" * 1000), (3999, "v" * 1000)]
    urls = [None, "", "http://a.example/é ?q=1\r\nWARC-Type: resource", "http://b.example/"]
    df = spark.createDataFrame([(i, urls[k % 4], h, "p", k, None) for k, (i, h) in enumerate(rows)], PAGES)
    assert sorted(map(tuple, warc.round_trip(df).collect()), key=str) == brute(rows)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_query_equals_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{small}/pages.parquet'")
    got = warc.round_trip(spark.read.parquet(f"{small}/pages.parquet"))
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(warc.round_trip_sql()).fetchall())


def batch(*rows):
    names = ["record_type", "record_id", "target_uri", "payload", "payload_digest", "payload_length", "refers_to"]
    return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])


def test_filters_and_columns_reach_the_source(spark, tmp_path):
    """Types and headers are judged before payloads are read: a payload that can't be inflated harms no reader who doesn't want it."""
    kind = lambda t, n: {"WARC-Type": t, "WARC-Record-ID": f"<urn:{n}>", "WARC-IP-Address": f"10.0.0.{n}", "Content-Type": "application/http; msgtype=response"}
    good = [warc.member(warc.record(kind("response", n), warc.http_block(b"body %d" % n, 6))) for n in (1, 2)]
    bad = bytearray(warc.member(warc.record(kind("resource", 3), random.Random(1).randbytes(300_000))))
    bad[20_000:290_000] = b"\xff" * 270_000
    foreign = gzip.compress(warc.record(kind("metadata", 4), b"k: v"))
    (tmp_path / "a.warc.gz").write_bytes(good[0] + bytes(bad) + good[1])
    (tmp_path / "b.warc.gz").write_bytes(foreign + gzip.compress(warc.record(kind("response", 5), warc.http_block(b"body 5", 6))))
    (tmp_path / "c.warc").write_bytes(b"\r\n" + warc.record(kind("response", 6), warc.http_block(b"body 6", 6)) + warc.record(kind("request", 7), b"GET"))
    (tmp_path / "_ignored").write_bytes(b"no archive")
    all_ = warc.read(spark, str(tmp_path), "record_id string, record_type string, warc_ip_address string, payload binary")
    rows = all_.where("record_type = 'response' and warc_ip_address in ('10.0.0.1', '10.0.0.2', '10.0.0.5', '10.0.0.6')")
    assert sorted((r.record_id, bytes(r.payload)) for r in rows.collect()) == [(f"<urn:{n}>", b"body %d" % n) for n in (1, 2, 5, 6)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter\b", plan)
    heads = warc.read(spark, str(tmp_path), "record_type string, content_length long").collect()
    assert sorted(r.record_type for r in heads) == ["metadata", "request", "resource"] + ["response"] * 4
    odd = all_.where("record_type not in ('response', 'resource') and warc_ip_address like '10.0.0.%' and warc_ip_address is not null").select("record_type", "payload")
    assert sorted((r.record_type, bytes(r.payload)) for r in odd.collect()) == [("metadata", b"k: v"), ("request", b"GET")]
    assert warc.read(spark, str(tmp_path), "record_type string, no_such string").where("no_such = 'x'").count() == 0


def test_filter_truth_has_three_values():
    F = __import__("pyspark.sql.datasource", fromlist=["x"])
    head = {"warc-type": "response"}
    assert warc._holds(F.Not(F.EqualTo(("record_type",), "revisit")), head)
    assert not warc._holds(F.Not(F.EqualTo(("refers_to",), "x")), head)
    assert warc._holds(F.IsNull(("refers_to",)), head) and not warc._holds(F.Not(F.In(("record_type",), ("a", None))), head)
    assert warc._holds(F.EqualNullSafe(("refers_to",), None), head) and not warc._holds(F.EqualTo(("record_type",), None), head)


@pytest.mark.parametrize("compress", [True, False])
def test_large_files_are_cut_at_records(tmp_path, monkeypatch, compress):
    monkeypatch.setattr(warc, "SPLIT", 40_000)
    monkeypatch.setattr(warc, "MARK", 10_000)
    monkeypatch.setattr(warc, "ROLL", 300_000)
    rng = random.Random(2)
    rows = [("response", f"urn:{i}", "http://a", rng.randbytes(rng.randrange(6000)), "sha1:x", 0, None) for i in range(200)]
    writer = warc.WarcWriter(str(tmp_path), "2020-01-01T00:00:00Z", compress)
    writer.write(iter([batch(*rows[:5])]))  # a task that never counted
    writer.commit([writer.write(iter([batch(*rows[:80]), batch(*rows[80:])])), None])
    from pyspark.sql.types import StructType

    reader = warc.WarcReader(str(tmp_path), StructType.fromDDL("record_type string, record_id string, payload binary"))
    parts = reader.partitions()
    got = [r for p in parts for b in reader.read(p) for r in b.to_pylist() if r["record_type"] == "response"]
    assert len(parts) > 8 and sorted((r["record_id"], r["payload"]) for r in got) == sorted((f"<{r[1]}>", r[3]) for r in rows)


def test_what_is_no_archive_fails(tmp_path):
    (tmp_path / "a.warc").write_bytes(b"hello\r\n\r\n")
    fs, root = warc.files_of(str(tmp_path))
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.records(fs, f"{root}/a.warc", 0, 9))
    whole = warc.member(warc.record({"WARC-Type": "response"}, b"x" * 1000))
    (tmp_path / "b.warc.gz").write_bytes(whole[:-400] if len(whole) > 500 else whole[:-20])
    with pytest.raises(ValueError, match="ends inside"):
        [read(None) for _, _, read in warc.records(fs, f"{root}/b.warc.gz", 0, len(whole))]
