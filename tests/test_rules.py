"""Golden timelines of alerts, and streams that give what a table gives."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gritstone.streaming import rules, sessions

T0 = datetime(2026, 8, 20, 2)
NORMAL = {"engine_rpm": 1800.0, "engine_load_pct": 70.0, "coolant_temp_c": 88.0, "oil_pressure_kpa": 350.0, "hydraulic_pressure_bar": 240.0, "hydraulic_oil_temp_c": 70.0, "battery_voltage": 27.8, "ground_speed_kmh": 1.0, "pitch_deg": 0.0, "roll_deg": 0.0, "seatbelt_fastened": True, "is_idle": False}
SCHEMA = "machine_id string, ts timestamp, " + ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'double'}" for k, v in NORMAL.items())


def frame(spark, change, minutes=40, step=1.0):
    n = int(minutes / step)
    return spark.createDataFrame([("M01", T0 + timedelta(minutes=i * step), *{**NORMAL, **change(i * step)}.values()) for i in range(n)], SCHEMA)


def timeline(spark, rule, change, **kw):
    rows = rules.alerts(rules.readings(frame(spark, change, **kw)).where(F.col("rule") == rule)).collect()
    return [(r.reason, r.severity, r.stage, (r.ts - T0).total_seconds() / 60) for r in sorted(rows, key=lambda r: (r.ts, rules.STAGES.index(r.stage) if r.stage in rules.STAGES else 9))]


def test_graded_stages(spark):
    """Critical from minute 5 to 15: warn at once, then two, five and seven minutes later; resolved after two calm minutes."""
    got = timeline(spark, "COOLANT_CRITICAL", lambda m: {"coolant_temp_c": 110.0} if 5 <= m < 15 else {})
    assert [(s, t) for _, _, s, t in got] == [("warn", 5), ("derate", 7), ("recommend_shutdown", 10), ("escalated", 12), ("resolved", 16)]


def test_rising_value_skips_ahead(spark):
    got = timeline(spark, "COOLANT_CRITICAL", lambda m: {"coolant_temp_c": 104.0 + 1.2 * (m - 4)} if 5 <= m < 14 else {})
    assert [(s, t) for _, _, s, t in got][:4] == [("warn", 5), ("derate", 7), ("recommend_shutdown", 8), ("escalated", 10)]


def test_rising_value_at_one_second(spark):
    """The look-back goes by time: the same stages at one row a second as at one a minute."""
    got = timeline(spark, "COOLANT_CRITICAL", lambda m: {"coolant_temp_c": 104.0 + 1.2 * (m - 4)} if 5 <= m < 14 else {}, minutes=15, step=1 / 60)
    assert [(s, round(t)) for _, _, s, t in got][:4] == [("warn", 5), ("derate", 7), ("recommend_shutdown", 8), ("escalated", 10)]


def test_warm_up_raises_nothing(spark):
    """Rows before the start fill the windows of minutes and open no alert."""
    change = lambda m: {"coolant_temp_c": 101.0} if m < 6 else {"hydraulic_pressure_bar": 120.0} if m >= 10 else {}
    df = frame(spark, change, minutes=20)
    since = T0 + timedelta(minutes=8)
    opened = lambda d, *more: {r.rule: r.ts for r in rules.alerts(rules.readings(d, *more)).where("reason = 'open'").collect()}
    warm, cold = opened(df, since), opened(df.where(F.col("ts") >= since))
    assert "COOLANT_HIGH" in opened(df) and "COOLANT_HIGH" not in warm and warm["HYD_PRESSURE_DROP"] < cold["HYD_PRESSURE_DROP"]


def test_critical_time_pauses(spark):
    """Back under the limit but not calm: the time spent critical goes on later."""
    got = timeline(spark, "COOLANT_CRITICAL", lambda m: {"coolant_temp_c": 107.0 if m in (5, 6, 10, 11, 12) else 103.0} if 5 <= m < 13 else {})
    assert [(s, t) for _, _, s, t in got] == [("warn", 5), ("derate", 11), ("resolved", 14)]


def test_hold_and_hysteresis(spark):
    hot = timeline(spark, "COOLANT_HIGH", lambda m: {"coolant_temp_c": 101.0} if 5 <= m < 9 else {"coolant_temp_c": 97.0} if 9 <= m < 20 else {})
    assert [(s, t) for _, _, s, t in hot] == [("warn", 6), ("resolved", 21)]  # 97 is not 5 % inside


def test_seatbelt_escalates(spark):
    got = timeline(spark, "SEATBELT", lambda m: {"seatbelt_fastened": False} if 1 <= m < 6 else {}, minutes=10, step=1 / 12)
    assert got[0][2:] == ("warn", 1.0) and ("stage", "critical", "escalated") in [g[:3] for g in got] and got[-1][2] == "resolved"


def test_tilt_and_idle_and_gate(spark):
    tilt = timeline(spark, "TIP_RISK", lambda m: {"roll_deg": -20.0} if 2 <= m < 4 else {"roll_deg": 26.0} if 4 <= m < 8 else {})
    assert [(r, s, t) for r, s, _, t in tilt][:3] == [("open", "warning", 2), ("severity", "critical", 4), ("stage", "critical", 6)]
    idle = timeline(spark, "EXCESS_IDLE", lambda m: {"is_idle": True, "engine_rpm": 1400.0} if m >= 5 else {})
    assert [(r, s, t) for r, s, _, t in idle] == [("open", "info", 15), ("severity", "warning", 25)]
    assert timeline(spark, "OIL_PRESSURE_LOW", lambda m: {"oil_pressure_kpa": 50.0, "engine_rpm": 900.0}) == []


def test_pressure_drop_latches(spark):
    got = timeline(spark, "HYD_PRESSURE_DROP", lambda m: {"hydraulic_pressure_bar": 120.0} if 10 <= m < 25 else {})
    stages = [(s, t) for _, _, s, t in got]
    assert stages[0][0] == "warn" and stages[0][1] in (10, 11) and stages[-1][0] == "resolved" and stages[-1][1] >= 25
    assert [s for s, _ in stages] == ["warn", "derate", "recommend_shutdown", "escalated", "resolved"]


def test_codes_verdicts_and_acknowledgement(spark):
    """Codes open and resolve one by one; verdicts do as well; an acknowledged alert waits for its full time."""
    rows = [("M01", T0 + timedelta(minutes=i), "E-110" if 2 <= i < 5 else "X-9" if 4 < i < 8 else None, "machine_fault" if i in (3, 4) else "normal", 0.9) for i in range(15)]
    df = spark.createDataFrame(rows, "machine_id string, ts timestamp, fault_code string, kind string, score double")
    found = rules.code_readings(df).unionByName(rules.verdict_readings(df))
    got = {(r.rule, r.reason): (r.severity, (r.ts - T0).total_seconds() / 60) for r in rules.alerts(found).collect()}
    assert got == {("FAULT_CODE:E-110", "open"): ("warning", 2), ("FAULT_CODE:E-110", "resolve"): ("warning", 6), ("FAULT_CODE:X-9", "open"): ("warning", 5), ("FAULT_CODE:X-9", "resolve"): ("warning", 9), ("UNUSUAL_BEHAVIOUR", "open"): ("warning", 3), ("UNUSUAL_BEHAVIOUR", "resolve"): ("warning", 6)}
    rising = rules.readings(frame(spark, lambda m: {"coolant_temp_c": 104.0 + 1.2 * (m - 4)} if 5 <= m < 14 else {}))
    ack = rules.acknowledgements(spark.createDataFrame([("M01", T0 + timedelta(minutes=8.5), "COOLANT_CRITICAL")], "machine_id string, ts timestamp, rule string"))
    stages = {r.stage: (r.ts - T0).total_seconds() / 60 for r in rules.alerts(rising.unionByName(ack).where("rule = 'COOLANT_CRITICAL'")).collect()}
    assert stages["recommend_shutdown"] == 8 and stages["escalated"] == 12


@pytest.mark.parametrize("per_batch", [1, 4])
def test_stream_equals_table(spark, tmp_path, per_batch):
    """The same events whichever way the rows are cut into micro-batches."""
    rng = random.Random(5)
    level = [0.0]

    def change(m):
        level[0] += rng.uniform(-2, 2) - 0.1 * level[0]
        return {"coolant_temp_c": 103.0 + 2 * level[0], "roll_deg": 15 + 6 * level[0], "hydraulic_pressure_bar": 240.0 if m % 60 < 40 else 120.0, "hydraulic_oil_temp_c": 92.0 + level[0], "seatbelt_fastened": level[0] < 1}

    acks = spark.createDataFrame([("M01", T0 + timedelta(minutes=m), rule) for m in range(0, 200, 7) for rule in ("COOLANT_CRITICAL", "HYD_OIL_HIGH")], "machine_id string, ts timestamp, rule string")
    found = rules.readings(frame(spark, change, minutes=200)).unionByName(rules.acknowledgements(acks)).cache()
    table = {tuple(r) for r in rules.alerts(found).collect()}
    assert {r for _, r, *_ in table} >= {"COOLANT_CRITICAL", "COOLANT_HIGH", "TIP_RISK", "HYD_OIL_HIGH", "SEATBELT", "HYD_PRESSURE_DROP"} and {s for *_, s in table} == {*rules.STAGES, "resolved"}
    for i in range(5):
        at = [T0 + timedelta(minutes=40 * k) for k in (i, i + 1)]
        found.where((F.col("ts") >= at[0]) & (F.col("ts") < at[1])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema(found.schema).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "in"))
    q = rules.alerts_stream(stream).writeStream.format("memory").queryName(f"alerts{per_batch}").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None and {tuple(r) for r in spark.table(f"alerts{per_batch}").collect()} == table


def test_session_stream(spark, tmp_path):
    """Events exactly 30 seconds apart are one session, later ones another."""
    rows = [("a", T0 + timedelta(seconds=s), float(s)) for s in (0, 30, 60, 91, 400)] + [("z", T0 + timedelta(seconds=4000), 0.0)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, d double")
    table = {tuple(r) for r in sessions.coalesce_events(df, "ts", "30 seconds", ["key"], least=F.min("d")).collect()}
    assert {(r[0], r[3]) for r in table} == {("a", 3), ("a", 1), ("z", 1)} and len(table) == 4
    for i in range(3):
        df.orderBy("ts").limit(100).where(F.col("d") % 3 == i).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "in"))
    got = sessions.coalesce_events(stream, "ts", "30 seconds", ["key"], "1 minute", least=F.min("d"))
    q = got.writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("sessions").collect()} <= table and q.exception() is None


def test_hysteresis():
    level = 0
    got = []
    for x in (10, 31, 25, 21, 19, 61, 55, 49, 10):
        level = sessions.step_level(level, x, [30.0, 60.0], 10.0)
        got.append(level)
    assert got == [0, 1, 1, 1, 0, 2, 2, 1, 0]


def odd_telemetry(spark, minutes=400, seed=9):
    """Two machines with gaps, nulls, runs of idling, drops of pressure, long criticals."""
    rng = random.Random(seed)
    rows = []
    for m in ("M01", "M02"):
        at, level, low = T0, 0.0, 0
        for _ in range(minutes):
            at += timedelta(seconds=rng.choice([60, 60, 60, 20, 90, 400 if rng.random() < 0.1 else 60]))
            level += rng.uniform(-2, 2) - 0.03 * level
            low = low - 1 if low else (rng.randrange(5, 30) if rng.random() < 0.02 else 0)
            idle = rng.random() < 0.995 if level < 0 else False
            change = {
                "coolant_temp_c": None if rng.random() < 0.03 else 103.0 + 2 * level, "roll_deg": 15 + 6 * level, "hydraulic_oil_temp_c": 92.0 + level, "seatbelt_fastened": None if rng.random() < 0.02 else level < 1, "engine_rpm": None if rng.random() < 0.004 else 1350.0 if idle else 1400.0 + 60 * level,
                "hydraulic_pressure_bar": None if rng.random() < 0.02 else (110.0 if low else 240.0) + rng.uniform(-15, 15), "is_idle": idle, "battery_voltage": 24.2 + 0.3 * level, "oil_pressure_kpa": 105 + 10 * level, "ground_speed_kmh": None if rng.random() < 0.02 else max(0.0, level),
            }
            rows.append((m, at, *{**NORMAL, **change}.values(), "excavator"))
    return spark.createDataFrame(rows, SCHEMA + ", machine_type string").cache()


def test_stretches_equal_whole_keys(spark):
    """Cut into stretches of time, readings and alerts are those of whole keys."""
    df = odd_telemetry(spark)
    whole = rules.readings(df).cache()
    assert sorted(map(str, (r for r in rules.readings(df, chunk=900.0).where("rule <> 'EXCESS_IDLE'").collect()))) == sorted(map(str, whole.where("rule <> 'EXCESS_IDLE'").collect()))
    idle = lambda d: {(r.machine_id, r.us, *r.levels, r.clear, r.value) for r in d.where("rule = 'EXCESS_IDLE'").collect()}
    assert idle(rules.readings(df, chunk=900.0)) == idle(whole)
    acks = df.where("second(ts) = 0 and minute(ts) % 7 = 0").select("machine_id", "ts", F.explode(F.array(F.lit("COOLANT_CRITICAL"), F.lit("HYD_OIL_HIGH"), F.lit("HYD_PRESSURE_DROP"))).alias("rule"))
    found = whole.unionByName(rules.acknowledgements(acks)).cache()
    table = sorted(tuple(r) for r in rules.alerts(found).collect())
    assert {r for _, r, *_ in table} >= {"COOLANT_CRITICAL", "COOLANT_HIGH", "TIP_RISK", "HYD_OIL_HIGH", "SEATBELT", "HYD_PRESSURE_DROP", "EXCESS_IDLE", "BATTERY_LOW"}
    for chunk in (1000.0, 5000.0):
        assert sorted(tuple(r) for r in rules.alerts(found, chunk=chunk).collect()) == table


def test_acknowledgement_at_the_opening_counts_nowhere(spark, tmp_path):
    """An alert must be open before it can be acknowledged: the table says what the stream says."""
    found = rules.readings(frame(spark, lambda m: {"coolant_temp_c": 106.0 + 2 * m})).where("rule = 'COOLANT_CRITICAL'")
    ack = rules.acknowledgements(spark.createDataFrame([("M01", T0, "COOLANT_CRITICAL")], "machine_id string, ts timestamp, rule string"))
    both = found.unionByName(ack)
    table = {tuple(r) for r in rules.alerts(both).collect()}
    assert {(s, (t - T0).total_seconds() / 60) for *_, t, _, _, s in [(r[0], r[1], r[2], r[3], r[4], r[5]) for r in table]} >= {("escalated", 5)}
    both.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(both.schema).parquet(str(tmp_path / "in"))
    q = rules.alerts_stream(stream).writeStream.format("memory").queryName("acked_at_open").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("acked_at_open").collect()} == table


def test_more_rows_take_more_tasks(spark, monkeypatch):
    """A task's share of readings doesn't grow with the table, and the alerts are the same."""
    hot = lambda m: {"coolant_temp_c": 110.0 if m % 20 < 9 else 88.0, "hydraulic_pressure_bar": 120.0 if m % 30 > 20 else 240.0}
    df = frame(spark, hot, minutes=90).withColumn("machine_id", F.explode(F.array(*(F.lit(f"M{i:02}") for i in range(8)))))
    few = sorted(map(tuple, rules.alerts(rules.readings(df)).collect()))
    assert few
    monkeypatch.setattr(rules, "TASK_ROWS", 100)
    read, found = rules.readings(df), rules.alerts(rules.readings(df))
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (read, found)]
    assert ", 8), REPARTITION_BY_NUM" in plans[0] and ", 72), REPARTITION_BY_NUM" in plans[1]  # 8 machines of 90 minutes, ten rules
    assert sorted(map(tuple, found.collect())) == few
