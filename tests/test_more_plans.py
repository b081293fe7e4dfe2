"""Minute features, task features, clusters, proximity."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gritstone.functions import text
from gritstone.operators import recurrence, vectors
from gritstone.operators import windows as W
from gritstone.plans import anomaly, clusters, recommend, task_time
from gritstone.streaming import proximity

T0 = datetime(2026, 6, 1)
BASE = {"engine_rpm": 1800.0, "engine_load_pct": 70.0, "coolant_temp_c": 88.0, "oil_pressure_kpa": 350.0, "hydraulic_pressure_bar": 240.0, "hydraulic_oil_temp_c": 70.0, "fuel_rate_lph": 20.0, "battery_voltage": 27.8, "vibration_rms_g": 0.4, "pitch_deg": 0.0, "roll_deg": 0.0, "ground_speed_kmh": 1.0}


def test_minute_features(spark):
    rows = [("M1", T0 + timedelta(minutes=i), i < 10, *{**BASE, "coolant_temp_c": 150.0 if i == 20 else 80.0 + i}.values()) for i in range(30)]
    f = anomaly.features(spark.createDataFrame(rows, "machine_id string, ts timestamp, is_idle boolean, " + ", ".join(f"{k} double" for k in BASE))).orderBy("ts").collect()
    assert f[5].state == "idle" and f[5].state_age_min == 5 and f[10].state_age_min == 0 and f[12].state == "working"
    assert f[20].glitch == "coolant_temp_c" and f[20].coolant_temp_c_mean5 == pytest.approx((96 + 97 + 98 + 99 + 99) / 5)
    assert f[15].coolant_temp_c_slope15 == pytest.approx(1.0) and f[19].idle_pct30 == pytest.approx(50.0)
    flagged = spark.createDataFrame([("M1", T0 + timedelta(minutes=i), i * 60_000_000, 9.0 if i > 2 else 1.0, None if i != 8 else "x", i not in (5,)) for i in range(12)], "machine_id string, ts timestamp, us long, state_age_min double, glitch string, flagged boolean")
    kinds = [r.kind for r in anomaly.classify(flagged).orderBy("us").collect()]
    assert kinds == ["normal"] * 8 + ["sensor_glitch"] + ["machine_fault"] * 3


def test_task_features(spark):
    at = lambda h: T0 + timedelta(hours=h)
    tasks = spark.createDataFrame(
        [("t1", "S", "A", "M1", "o1", T0.date(), "dig", "rock", 10.0, "m3", 0.0, None, at(1), at(2), 60.0, "completed"), ("t2", "S", "A", "M1", "o1", T0.date(), "dig", "rock", 10.0, "m3", 0.0, None, at(4.5), None, None, "scheduled")],
        "task_id string, site_id string, shift_id string, machine_id string, operator_id string, task_date date, task_type string, material_type string, quantity double, unit string, terrain_slope_deg double, haul_distance_m double, scheduled_start timestamp, actual_end timestamp, actual_duration_min double, status string",
    )
    weather = spark.createDataFrame([("S", at(h), float(h), 0.0, 1.0, 1.0, 1.0) for h in range(6)], "site_id string, ts timestamp, temp_c double, rain_mm double, wind_kmh double, visibility_m double, dust_index double")
    operators = spark.createDataFrame([("o1", 0.5, 3.0, 2)], "operator_id string, skill_score double, experience_years double, certification_level int")
    machines = spark.createDataFrame([("M1", "dozer", 100.0, 250.0)], "machine_id string, machine_type string, total_engine_hours double, service_interval_hours double")
    shifts = spark.createDataFrame([("A", "M1", "day", at(0), at(8))], "shift_id string, machine_id string, shift_type string, start_time timestamp, end_time timestamp")
    fatigue = spark.createDataFrame([(at(1), "o1", "A", 0.2)], "ts timestamp, operator_id string, shift_id string, fatigue_score double")
    log = spark.createDataFrame([("M1", at(-5), 67.0, "x", "scheduled_service")], "machine_id string, event_date timestamp, engine_hours_at_event double, component string, event_type string")
    reference = task_time.baseline(tasks, task_time.work(), "per_unit").withColumn("per_unit", F.lit(5.0))
    got = {r.task_id: r for r in task_time.features(tasks, weather, operators, machines, shifts, fatigue, log, reference).collect()}
    assert got["t2"].temp_c == 4.0 and got["t2"].operator_avg_time_ratio == pytest.approx(60 / 50) and got["t1"].operator_avg_time_ratio is None
    assert got["t1"].health_score == pytest.approx(1 - 0.2 * 25 / 250) and got["t2"].hours_into_shift == 4.5 and got["t2"].day_of_week == 0
    q = spark.range(1).select(task_time.calibrate(F.lit(12.0), F.lit(10.0), F.lit(8.0), 0.1).alias("q")).first().q
    assert tuple(q) == (7.0, 10.0, 13.0)


def test_clusters(spark):
    rows = [(float(10 * c + i % 3), float(-10 * c + i % 2)) for c in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, "a double, b double")
    scaler, kmeans, plane, scores = clusters.fit(df, ["a", "b"], (2, 3, 4))
    assert max(scores, key=scores.get) == 3
    out = clusters.assign(df, scaler, kmeans, plane)
    assert out.select("cluster_id").distinct().count() == 3 and {"plane_x", "plane_y"} <= set(out.columns)
    far = spark.createDataFrame([([0.0, 0.0],), ([5.0, 5.0],)], "x array<double>")
    assert [r[0] for r in far.select(clusters.noise("x", [[0.1, 0.0]], 1.0, far)).collect()] == [False, True]


def test_cluster_names():
    flat = dict.fromkeys(clusters.TRAITS, 0.0)
    centroids = {0: {**flat, "idle_pct": 1.2, "safety_per_10h": 0.9}, 1: {**flat, "idle_pct": 0.8}, 2: {**flat, "time_ratio": -1.0}, 3: {**flat, "productivity_per_hour": -0.7}, 4: flat, 5: flat}
    assert clusters.cluster_names(centroids) == {0: "needs safety coaching", 1: "idle-heavy", 2: "efficient", 3: "low output", 4: "average", 5: "average 2"}


def test_recurrences(spark):
    """A carried value over several batches of a key; nulls keep it."""
    values = [4.0, None, 8.0, 0.0, 100.0]
    df = spark.createDataFrame([(k, i, x) for k in ("a", "b", None) for i, x in enumerate(values)], "k string, i int, x double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    got = {}
    for r in recurrence.follow(df, "k", ["i"], "x", 0.5, "level").collect():
        got.setdefault(r.k, {})[r.i] = r.level
    walk = [r.y for r in recurrence.bounded_walk(df.where("k = 'a'").withColumn("d", F.col("x") / 10), "k", ["i"], "d", "y").orderBy("i").collect()]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == dict.fromkeys(("a", "b", None), {0: 4.0, 1: 4.0, 2: 6.0, 3: 3.0, 4: 51.5})
    assert walk == [0.5, 0.5, 1.0, 1.0, 1.0]


def test_proximity(spark):
    """Entry at the limit, exit beyond the slack, repeats while red, a fresh start after two unseen seconds."""
    ds = [8.0, 7.0, 7.2, 7.4, 6.0, 2.9, 3.2, 3.2, 3.2, 3.4]
    rows = [("k", int(i * 1e6), d, False, False) for i, d in enumerate(ds)] + [("k", int(20e6), 7.1, False, False)]
    got = proximity.zones(spark.createDataFrame(rows, "track string, us long, distance_m double, approaching boolean, wide boolean"), "track").orderBy("us").collect()
    assert [r.zone for r in got] == ["clear", "orange", "orange", "clear", "orange", "red", "red", "red", "red", "orange", "clear"]
    assert [r.post for r in got] == [False, True, False, False, True, True, False, True, False, True, False]
    near = spark.createDataFrame([("k", int(i * 5e5), 10.0 - i, ) for i in range(5)], "track string, us long, distance_m double")
    assert [r.closing_mps for r in proximity.closing(near, "track").orderBy("us").collect()] == [None, None, 2.0, 2.0, 2.0]
    one = spark.range(1).select(proximity.distance(F.lit(170.0), F.lit("person"), F.lit(1000.0), F.lit(None).cast("double")).alias("d"), proximity.fatigue_score(F.lit(0.3), F.lit(3), F.lit(0), F.lit(5.0), F.lit(True)).alias("f")).first()
    assert one.d == pytest.approx(10.0) and one.f == pytest.approx(0.45 + 0.15 + 0.075 + 0.1)
    assert W.DAY == 86400


def test_question_keys(spark):
    """Wide letters, capitals and codes come to one key; marks of other scripts stay."""
    rows = spark.createDataFrame([("What is E 365?!",), ("what is  ｅ３６５",), ("WHAT IS e-365",), ("தமிழ் का?",), (None,)], "q string")
    assert [r[0] for r in rows.select(text.question_key(F.col("q"))).collect()] == ["what is e-365"] * 3 + ["தமிழ் का", None]


def test_too_many_queries_are_refused(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MOST_QUERIES", 3)
    df = spark.range(5).selectExpr("id", "array(cast(id as double), 1.0) as v")
    with pytest.raises(ValueError):
        vectors.top_k_per_query(df, df, "id", "v", 1)


def test_open_alerts_of_a_handover(spark):
    """Open at a shift's end: raised by then and not resolved; alerts raised at the very end count, those resolved then do not."""
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    shifts = spark.createDataFrame([("s1", "m", at(0), at(8), 90.0, 50.0), ("s2", "m", at(8), at(16), 90.0, 60.0), ("s3", "x", at(0), at(8), None, 1.0)], "shift_id string, machine_id string, start_time timestamp, end_time timestamp, fuel_start_pct double, fuel_end_pct double")
    alerts = spark.createDataFrame([("m", at(1), at(8), "A"), ("m", at(8), None, "B"), ("m", at(2), at(20), "C"), ("m", at(17), None, "D"), ("m", at(9), at(10), "E")], "machine_id string, ts timestamp, resolved_at timestamp, alert_code string")
    none = lambda schema: spark.createDataFrame([], schema)
    got = recommend.handover_facts(shifts, alerts, none("machine_id string, ts timestamp, event_type string"), none("shift_id string, status string"), none("machine_id string, predicted_at timestamp, failure_probability double")).collect()
    assert {r.shift_id: r.open_alerts for r in got} == {"s1": ["B", "C"], "s2": ["B", "C"], "s3": None}
