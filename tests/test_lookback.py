"""The stream of a machine's rules against the table."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from test_rules import T0, odd_telemetry

from gritstone.streaming import lookback, rules


@pytest.fixture
def telemetry(spark):
    lookback.use_state_store(spark)
    yield odd_telemetry(spark, 150, seed=11)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, df, tmp_path, name, cuts, per_batch=1):
    """The rows in files by time, read as a stream."""
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        df.where((F.col("ts") >= a) & (F.col("ts") < b)).coalesce(1).write.parquet(str(tmp_path / name / f"b{i}"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / name))


def told(spark, stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return sorted((tuple(r) for r in spark.table(name).collect()), key=str)


def test_stream_equals_table_with_rules_that_look_back(spark, telemetry, tmp_path):
    acks = telemetry.where("minute(ts) % 9 = 0").select("machine_id", (F.col("ts") + F.expr("interval 1 second")).alias("ts"), F.explode(F.array(F.lit("COOLANT_CRITICAL"), F.lit("HYD_PRESSURE_DROP"))).alias("rule"))
    table = sorted((tuple(r) for r in rules.alerts(rules.readings(telemetry).unionByName(rules.acknowledgements(acks))).collect()), key=str)
    assert {r for _, r, *_ in table} >= {"HYD_PRESSURE_DROP", "EXCESS_IDLE", "COOLANT_CRITICAL", "SEATBELT"}
    cuts = [T0 + timedelta(minutes=m) for m in (0, 50, 51, 1000)]
    flat = telemetry.select("*", F.lit(None).cast("string").alias("rule")).unionByName(acks, allowMissingColumns=True)
    both = streamed(spark, flat, tmp_path, "both", cuts)
    got = told(spark, lookback.machine_alerts(both.where("rule is null"), both.where("rule is not null"), None), "looking", tmp_path)
    assert got == table


def test_late_rows_are_told(spark, telemetry, tmp_path):
    one = telemetry.where("machine_id = 'M01'").orderBy("ts")
    cut = T0 + timedelta(minutes=60)
    one.where(F.col("ts") >= cut).coalesce(1).write.parquet(str(tmp_path / "in" / "b0"))
    one.where(F.col("ts") < cut).coalesce(1).write.parquet(str(tmp_path / "in" / "b1"))
    stream = spark.readStream.schema(one.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "in"))
    got = told(spark, lookback.machine_alerts(stream, None, None), "late_rows", tmp_path)
    assert sum(r[3] == lookback.LATE for r in got) == one.where(F.col("ts") < cut).count()
    assert {r for r in got if r[3] != lookback.LATE} == {tuple(r) for r in rules.alerts(rules.readings(one.where(F.col("ts") >= cut))).collect()}


def test_silent_machines_are_forgotten(spark, telemetry, tmp_path):
    """A machine whose timer has run out begins anew: its open alert is opened again."""
    df = spark.createDataFrame([("M01", T0, 110.0), ("M01", T0 + timedelta(minutes=1), 110.0)], "machine_id string, ts timestamp, coolant_temp_c double")
    whole = telemetry.limit(0).unionByName(df, allowMissingColumns=True)
    opened = {}
    for name, forget in (("kept", None), ("forgotten", 1)):
        stream = streamed(spark, whole, tmp_path, name, [T0, T0 + timedelta(seconds=30), T0 + timedelta(minutes=5)])
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
        opened[name] = [r for r in told(spark, lookback.machine_alerts(stream, None, forget), name, tmp_path) if r[1] == "COOLANT_CRITICAL" and r[3] == "open"]
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert len(opened["kept"]) == 1 and len(opened["forgotten"]) == 2
