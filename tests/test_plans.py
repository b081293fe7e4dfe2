"""Fleet analytics on hand-written rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gritstone.functions import text
from gritstone.operators import merge, vectors
from gritstone.plans import fleet, health, maintenance, recommend, replan
from gritstone.sources import schemas, tables

T0 = datetime(2026, 6, 1)


def at(h):
    return T0 + timedelta(hours=h)


def test_engine_hours_cut_at_failure(spark):
    """A shift cut by a failure counts to the failure; the last ends at the machine's total."""
    shifts = spark.createDataFrame([("A", "M1", at(0.5), at(8.5)), ("B", "M1", at(12), at(20))], "shift_id string, machine_id string, start_time timestamp, end_time timestamp")
    log = spark.createDataFrame([("M1", at(2.5), 90.0, "engine", "failure"), ("M1", at(6), 90.0, "engine", "repair")], "machine_id string, event_date timestamp, engine_hours_at_event double, component string, event_type string")
    machines = spark.createDataFrame([("M1", 100.0)], "machine_id string, total_engine_hours double")
    got = {r.shift_id: (r.eh_start, r.eh_end) for r in maintenance.shift_engine_hours(shifts, machines, log).collect()}
    assert got["A"] == pytest.approx((90, 92)) and got["B"] == pytest.approx((92, 100))
    features = spark.createDataFrame([("M1", at(1), 90.5), ("M1", at(4), 92.0), ("M1", at(13), 93.0)], "machine_id string, ts timestamp, engine_h double")
    end = spark.createDataFrame([("M1", 100.0)], "machine_id string, end_eh double")
    rows = {r.engine_h: (r.label, r.keep) for r in maintenance.labels(features, log, end).collect()}
    assert rows == {90.5: (0, True), 92.0: (0, False), 93.0: (0, False)}


def test_hourly_features(spark):
    rows = [("M1", "S", at(i / 60), 70.0 + (i // 60), 300.0, 200.0 + i % 2, 60.0, 27.0, 0.5, 3.0, 85.0 if i % 2 else 10.0, "E-110" if 30 <= i < 33 else None, 0.1, "machine_fault" if i in (5, 6, 90) else "normal", i / 60) for i in range(240)]
    minutes = spark.createDataFrame(rows, "machine_id string, shift_id string, ts timestamp, coolant_temp_c double, oil_pressure_kpa double, hydraulic_pressure_bar double, hydraulic_oil_temp_c double, battery_voltage double, vibration_rms_g double, ground_speed_kmh double, engine_load_pct double, fault_code string, anomaly_score double, kind string, engine_h double")
    h = maintenance.hourly(minutes).orderBy("bin").collect()
    assert [r.n_min for r in h] == [60] * 4 and [r.anomaly_count for r in h] == [1, 1, 0, 0] and [r.fault_code_count for r in h] == [1, 0, 0, 0]
    assert h[0].hydraulic_pressure_bar_std == pytest.approx(0.5) and h[0].high_load_min == 30
    machines = spark.createDataFrame([("M1", "dozer", 250.0, 2020)], "machine_id string, machine_type string, service_interval_hours double, year int")
    log = spark.createDataFrame([("M1", at(2), 1.0, "x", "scheduled_service")], "machine_id string, event_date timestamp, engine_hours_at_event double, component string, event_type string")
    f = maintenance.hourly_features(maintenance.hourly(minutes), machines, log).orderBy("bin").collect()
    assert f[3].coolant_temp_c_slope24 == pytest.approx(1) and f[1].coolant_temp_c_slope24 is None and f[3].coolant_temp_c_mean24 == pytest.approx(71.5)
    assert f[0].hours_since_service is None and f[3].hours_since_service == pytest.approx(239 / 60 - 1) and f[3].high_load_hours_since_service == pytest.approx(1.0)
    scored = maintenance.baseline_probability(maintenance.add_scores(maintenance.hourly_features(maintenance.hourly(minutes), machines, log), maintenance.fit_scales(maintenance.hourly_features(maintenance.hourly(minutes), machines, log))))
    assert all(0 <= r.p_baseline <= 1 for r in scored.collect())


def test_health(spark):
    machines = spark.createDataFrame([("M1",), ("M2",)], "machine_id string")
    alerts = spark.createDataFrame([("M1", "COOLANT_CRITICAL", "critical", "warn", None), ("M1", "FAULT_CODE", "warning", "warn", "E-410"), ("M1", "HYD_OIL_HIGH", "critical", "resolved", None), ("M2", "SEATBELT", "critical", "warn", None)], "machine_id string, alert_code string, severity string, stage string, fault_code string")
    anomalies = spark.createDataFrame([("M1", 0.5, "machine_fault", ["vibration_rms_g_std5"], True), ("M2", 0.9, "normal", ["engine_rpm_mean5"], False)], "machine_id string, anomaly_score double, kind string, top array<string>, travelling boolean")
    predictions = spark.createDataFrame([("M2", 0.4, "hydraulics")], "machine_id string, failure_probability double, likely_component string")
    got = {r.machine_id: r for r in health.health(machines, health.alert_penalties(alerts), health.anomaly_penalties(anomalies), health.prediction_penalties(predictions)).collect()}
    m = got["M1"]
    assert (m.cooling_score, m.electrical_score, m.hydraulics_score, m.undercarriage_score, m.engine_score, m.overall_score, m.band) == (0.3, 0.7, 1.0, 0.7, 1.0, 0.3, "red")
    assert (got["M2"].overall_score, got["M2"].band) == (0.6, "orange")


def test_replan(spark):
    """The running task stays; what does not fit is passed over and a shorter one may follow."""
    tasks = spark.createDataFrame([("S", "t1", "in_progress", 1, 1, 60.0, at(0)), ("S", "t2", "scheduled", 1, 2, 300.0, None), ("S", "t3", "scheduled", 2, 3, 30.0, None), ("S", "t4", "scheduled", 2, 4, None, None), ("S", "t5", "completed", 1, 5, 10.0, None)], "shift_id string, task_id string, status string, priority int, sequence_no int, p50 double, actual_start timestamp")
    shifts = spark.createDataFrame([("S", at(0.5), at(2.5), True)], "shift_id string, now timestamp, end_time timestamp, fatigue_high boolean")
    plan = replan.re_evaluate(tasks, shifts)
    got = {r.task_id: (r.fits, r.place) for r in plan.collect()}
    assert got == {"t1": (True, 0), "t2": (False, 1), "t3": (True, 2), "t4": (False, 3)}
    after = {r.task_id: (r.new_sequence_no, r.moved) for r in replan.accept(tasks, plan).collect()}
    assert after["t5"] == (5, False) and after["t1"] == (6, False) and after["t3"] == (7, False) and after["t2"][1] and after["t4"][1]
    reasons = spark.range(1).select(replan.triggers(F.lit(True), F.lit(2.5), F.lit(0.6), F.lit("HIGH"), F.lit(None).cast("boolean")).alias("t")).first().t
    assert reasons == ["task_overrun", "rain", "fatigue_high"]


def test_renumbered_gathers_tasks_once(spark):
    """The same numbers as of a plan that is accepted, with one pass over the tasks; odd states, tasks without a shift and shifts without open tasks keep theirs."""
    rows = [(s, f"{s}-{i}", ("scheduled", "in_progress", "completed", "delayed", None)[(i * 7 + s) % 5 if i else 1], i % 3 or None, i, float(i * 13 % 60) if i % 4 else None, at(0)) for s in range(9) for i in range(s + 1)]
    rows += [(None, "x", "scheduled", 1, 4, 5.0, None), (8, "y", "completed", 1, None, 5.0, None)]
    tasks = spark.createDataFrame(rows, "shift_id long, task_id string, status string, priority int, sequence_no int, p50 double, actual_start timestamp")
    shifts = spark.createDataFrame([(s, at(0.1), at(s / 2), s % 2 == 0) for s in range(8)] + [(8, at(0.1), None, None)], "shift_id long, now timestamp, end_time timestamp, fatigue_high boolean")
    want = {r.task_id: (r.new_sequence_no, r.moved) for r in replan.accept(tasks, replan.re_evaluate(tasks, shifts)).collect()}
    got = replan.renumbered(tasks, shifts).collect()
    assert len(got) == len(rows) and {r.task_id: (r.new_sequence_no, r.moved) for r in got} == want
    from gritstone.plans.catalog import QUERIES

    plan = QUERIES["plan_order"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and plan.count("Exchange hashpartitioning") <= 2


def test_recommend(spark):
    events = spark.createDataFrame([("o1", at(1), "tip_risk"), ("o1", at(2), "blindspot_intrusion"), ("o1", at(3), "proximity_breach"), ("o1", at(-200), "tip_risk"), ("o2", at(1), "harsh_maneuver")], "operator_id string, ts timestamp, event_type string")
    counted = recommend.counts(events, "operator_id", F.lit(at(24)))
    none = lambda s: spark.createDataFrame([], s)
    ratios = spark.createDataFrame([("o1", "dig", 1.5, 3), ("o1", "haul", 1.9, 1)], "operator_id string, task_type string, ratio double, n int")
    idle = spark.createDataFrame([("o2", 40.0)], "operator_id string, idle_pct double")
    fired = recommend.fired(counted, "operator_id", none("operator_id string, cluster_label string"), ratios, idle)
    modules = spark.createDataFrame([(m,) for m in ("TM-SAFE-03", "TM-SAFE-01", "TM-EXC-01", "TM-FUEL-01", "TM-IDLE-01")], "module_id string")
    existing = spark.createDataFrame([("o1", "TM-SAFE-03", "done", at(20)), ("o2", "TM-IDLE-01", "pending", at(-900))], "operator_id string, module_id string, status string, created_at timestamp")
    got = sorted((r.operator_id, r.place, r.module_id) for r in recommend.recommend(fired, "operator_id", existing, modules, F.lit(at(24))).collect())
    assert got == [("o1", 0, "TM-SAFE-01"), ("o1", 1, "TM-EXC-01"), ("o2", 0, "TM-FUEL-01")]


def test_weekly_totals_rebuild(spark):
    """Sums over operators equal sums over machines."""
    from gritstone.plans.catalog import QUERIES

    rows = QUERIES["weekly_segments"](spark, "/root/testdata/sf0.001").groupBy("entity_type").agg(F.sum("productive_hours").alias("h"), F.sum("anomaly_count").alias("a")).collect()
    assert len({(round(r.h, 6), r.a) for r in rows}) == 1 and fleet.KEYS[0] == "entity_type"


def test_csv_round_trip(spark, tmp_path):
    rows = [("op1", "s", "A, B", 1.5, 2, ["en", "a b", 'q"x'], "day", 0.5)]
    df = spark.createDataFrame(rows, schemas.schema("operators"))
    tables.write_csv(df, str(tmp_path / "o"), "operators", {"experience_years": 0})
    back = tables.read_csv(spark, str(tmp_path / "o"), "operators").first()
    assert back.languages == ["en", "a b", 'q"x'] and back.experience_years == 2.0 and back.full_name == "A, B"
    bad = tables.normalise(spark.createDataFrame([("m", "x", "NaN")], "machine_id string, ts string, engine_rpm string"), "telemetry").first()
    assert bad.ts is None and bad.engine_rpm is None and schemas.required("sites") >= {"site_id", "lat"}


def test_merge_and_text(spark):
    t = spark.createDataFrame([(1, "a", "keep"), (2, "b", "keep")], "k int, v string, w string")
    c = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, seq int")
    assert sorted(map(tuple, merge.upsert(t, c.select("k", "v", "seq"), ["k"], F.col("seq")).collect())) == [(1, "a", "keep"), (2, "y", "keep"), (3, "z", None)]
    assert sorted(r.k for r in merge.insert_new(t, c.select("k", "v", F.lit("n").alias("w")), ["k"], F.desc("v")).collect()) == [1, 2, 3]
    md = spark.createDataFrame([("d", "intro\n# One\ntext\n\nmore\n## Two\nlast\nSOURCES: 2, 1, 2")], "id string, body string")
    assert [(r.heading, r.body) for r in text.markdown_sections(md, "id", "body").orderBy("section").collect()][:2] == [("", "intro"), ("One", "text\n\nmore")]
    assert md.select(text.sources(F.col("body")).alias("s")).first().s == [2, 1]
    long = spark.createDataFrame([("d", "\n\n".join(f"p{i} " + "x" * 900 for i in range(6)))], "id string, body string")
    chunks = text.chunks(long, "id", "body").collect()
    assert all(len(r.content) <= 2400 for r in chunks) and "p5" in chunks[-1].content
    assert vectors.match_vectors(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "k int, v array<float>"), "k", "v", [1.0, 0.1], 4, 0.3).orderBy("k").collect()[0].k == 1


def test_health_query_keeps_values_beyond_one(spark, tmp_path):
    """As in its SQL: a purchase of 560 is a probability of 1.12 and a score of -0.12; the operator caps unless told otherwise."""
    import duckdb

    from gritstone.plans.catalog import ORACLE, QUERIES

    rows = [(0, at(0), 1, "purchase", 560.2), (1, at(1), 1, "purchase", 250.0), (8, at(1), 2, "purchase", 501.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    df = QUERIES["health_scores"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"select {', '.join(df.columns)} from ({ORACLE['health_scores']})").fetchall())
    predictions = spark.createDataFrame([("M", 1.5, "engine")], "machine_id string, failure_probability double, likely_component string")
    assert health.prediction_penalties(predictions).first().penalty == 1.0
