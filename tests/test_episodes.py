"""Episodes and renewed lookups: streams against tables, odd rows, busy keys in stretches."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_lookback import streamed

from gritstone.streaming import episodes, renewed

T0 = datetime(2024, 3, 1)
ROWS = "machine_id string, ts timestamp, code string, severity string"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def seen(spark):
    rows = [("m1", at(0), "NEAR", "warning"), ("m1", at(1), "NEAR", "info"), ("m1", at(2), "CLOSE", "critical"), ("m1", at(4), "HIT", "critical"), ("m1", at(30), "NEAR", "warning")]
    rows += [("m2", at(3), "SOS", "emergency"), ("m2", at(40), "SOS", "emergency"), ("m3", at(5), None, None), ("m3", at(5), "B", "warning"), ("m3", at(5), "A", "warning"), ("m3", at(9), "A", "info")]
    return spark.createDataFrame(rows + [("end", at(500), "X", "info")], ROWS)


def plain(df):
    return sorted(((r.machine_id, r.ts, r.reason, r.code, r.severity, r.n, r.start_ts) for r in df.collect()), key=lambda x: x[:3])


def told(spark, stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.table(name)


def test_severity_only_rises_and_codes_follow(spark):
    got = plain(episodes.changes(seen(spark), "machine_id", "ts", "code", "severity", 300))
    m1 = [x[1:6] for x in got if x[0] == "m1"]
    assert m1 == [(at(0), "open", "NEAR", "warning", 1), (at(2), "rise", "CLOSE", "critical", 3), (at(9), "resolve", "CLOSE", "critical", 4), (at(30), "open", "NEAR", "warning", 1), (at(35), "resolve", "NEAR", "warning", 1)]
    assert [x[2] for x in got if x[0] == "m2"] == ["open", "open"]
    assert [x[1:6] for x in got if x[0] == "m3"] == [(at(5), "open", "A", "warning", 3), (at(14), "resolve", "A", "warning", 4)]


def test_stretches_and_now(spark):
    df = seen(spark)
    whole = plain(episodes.changes(df, "machine_id", "ts", "code", "severity", 300))
    assert plain(episodes.changes(df, "machine_id", "ts", "code", "severity", 300, chunk=120)) == whole
    early = plain(episodes.changes(df, "machine_id", "ts", "code", "severity", 300, now=F.lit(at(20))))
    assert set(whole) - set(early) == {x for x in whole if x[2] == "resolve" and x[1] >= at(20)}


def test_stream_equals_table_and_ends_without_new_rows(spark, tmp_path):
    df = seen(spark)
    files = streamed(spark, df, tmp_path, "seen", [at(m) for m in (0, 2, 5, 35, 100, 1000)])
    got = plain(told(spark, episodes.changes_stream(files, "machine_id", "ts", "code", "severity", 300, "1 minute"), "episodes", tmp_path))
    assert got == plain(episodes.changes(df, "machine_id", "ts", "code", "severity", 300, now=F.lit(at(499))))
    assert ("m1", at(35), "resolve", "NEAR", "warning", 1, at(30)) in got  # the machine itself has no later row


def test_rows_before_the_open_episode_are_told(spark, tmp_path):
    df = spark.createDataFrame([("m", at(60), "A", "info"), ("m", at(10), "B", "critical"), ("m", at(61), "C", "warning")], ROWS)
    for i, minute in enumerate((60, 10, 61)):
        df.where(F.col("ts") == at(minute)).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "in"))
    got = plain(told(spark, episodes.changes_stream(stream, "machine_id", "ts", "code", "severity", 300, "2 hours"), "late_rows", tmp_path))
    assert [(x[1], x[2]) for x in sorted(got, key=lambda x: x[1])] == [(at(10), "late"), (at(60), "open"), (at(61), "rise")]


def test_odd_rows_of_episodes(spark):
    df = spark.createDataFrame([(None, at(0), "A", "info"), ("m", None, "A", "info"), ("m", at(1), None, "odd")], ROWS).withColumns({"n": F.lit("mine"), "us": F.lit("mine")})
    got = plain(episodes.changes(df, "machine_id", "ts", "code", "severity", 300))
    assert [x[2:6] for x in got] == [("open", None, "info", 1), ("resolve", None, "info", 1)]
    assert episodes.changes(df.limit(0), "machine_id", "ts", "code", "severity", 300).count() == 0


@pytest.mark.parametrize("chunk", [None, 3600.0])
def test_lookups_are_kept_for_a_while(spark, chunk):
    rows = spark.createDataFrame([(i, "m", at(10 * i)) for i in range(15)] + [(99, "n", at(3)), (100, None, at(3)), (101, "m", None)], "id long, machine_id string, ts timestamp")
    table = spark.createDataFrame([("m", at(-5), "a"), ("m", at(15), "b"), ("m", at(60), "c"), ("m", at(61), "d")], "machine_id string, at timestamp, found string")
    got = {r.id: (r.checked_at, r.found) for r in renewed.renewed(rows, table, "machine_id", "ts", "at", ["found"], 3600, chunk).collect()}
    assert {i: got[i][1] for i in range(15)} == {i: "a" if i < 6 else "c" if i < 12 else "d" for i in range(15)}
    assert got[99] == (at(3), None) and got[100] == (None, None) and got[101] == (None, None) and got[7][0] == at(60)


def test_stream_sees_versions_that_come_while_it_runs(spark, tmp_path):
    rows = spark.createDataFrame([(i, m, at(10 * i)) for i in range(24) for m in ("m", "n")], "id long, machine_id string, ts timestamp")
    versions = [("m", at(0), "a", 1), ("n", at(0), "x", 1), ("m", at(100), "b", 2), ("m", at(125), "c", 2), ("n", at(190), "y", 2)]
    table = spark.createDataFrame(versions, "machine_id string, at timestamp, found string, version int")
    where, out = str(tmp_path / "table"), str(tmp_path / "out")
    table.where("version = 1").drop("version").write.parquet(where)
    done = []

    def sink(batch, number):
        batch.write.parquet(f"{out}/{number}")
        done.append(number)
        if len(done) == 1:  # the table is renewed between two micro-batches
            table.where("version = 2").drop("version").write.mode("append").parquet(where)

    stream = streamed(spark, rows, tmp_path, "rows", [at(m) for m in (0, 100, 10_000)])
    q = renewed.write_renewed(stream, lambda s: s.read.parquet(where), "machine_id", "ts", "at", ["found"], 3600, sink, forget_ms=None).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None and len(done) == 2
    got = spark.read.option("recursiveFileLookup", True).parquet(out)
    want = renewed.renewed(rows, table.drop("version"), "machine_id", "ts", "at", ["found"], 3600)
    key = lambda df: sorted(map(tuple, df.select("id", "machine_id", "checked_at", "found").collect()), key=str)
    assert key(got) == key(want)
    assert {r.found for r in got.where("machine_id = 'm'").collect()} == {"a", "b", "c"}
