"""Schemas of the fleet tables, and checks that give violations as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the fleet tables. A type with ! may not be null.
TABLES = {
    "sites": "site_id string!, name string!, site_type string!, lat double!, lon double!, timezone string!",
    "operators": "operator_id string!, site_id string!, full_name string!, experience_years double!, certification_level short!, languages array<string>!, preferred_shift string!, skill_score double!",
    "machines": "machine_id string!, site_id string!, machine_type string!, model string!, serial_no string, year short, total_engine_hours double!, hours_since_service double!, service_interval_hours double!, status string!, health_score double!",
    "geofences": "id long, site_id string!, name string!, zone_type string!, polygon struct<type:string,coordinates:array<array<array<double>>>>!, speed_limit_kmh double, active boolean!",
    "shifts": "shift_id string!, site_id string!, operator_id string!, machine_id string!, shift_type string!, shift_date date!, start_time timestamp!, end_time timestamp!, fuel_start_pct double, fuel_end_pct double, handover_notes string, issues_reported array<string>, handover_summary string, handover_generated_at timestamp",
    "weather": "id long, site_id string!, ts timestamp!, temp_c double, humidity_pct double, rain_mm double, wind_kmh double, visibility_m double, dust_index double",
    "tasks": "task_id string!, site_id string!, shift_id string!, machine_id string!, operator_id string!, sequence_no short!, task_date date!, task_type string!, material_type string!, quantity double!, unit string!, terrain_slope_deg double!, haul_distance_m double, priority short!, scheduled_start timestamp, predicted_p10_min double, predicted_p50_min double, predicted_p90_min double, prediction_factors string, actual_start timestamp, actual_end timestamp, actual_duration_min double, status string!, delay_reason string",
    "telemetry": "id long, ts timestamp!, machine_id string!, operator_id string, shift_id string, engine_rpm double, engine_load_pct double, coolant_temp_c double, engine_oil_temp_c double, oil_pressure_kpa double, hydraulic_pressure_bar double, hydraulic_oil_temp_c double, fuel_rate_lph double, fuel_level_pct double, battery_voltage double, vibration_rms_g double, ground_speed_kmh double, pitch_deg double, roll_deg double, gps_lat double, gps_lon double, seatbelt_fastened boolean, is_idle boolean, fault_code string",
    "machine_health_snapshots": "id long, machine_id string!, ts timestamp!, overall_score double!, engine_score double, hydraulics_score double, cooling_score double, electrical_score double, undercarriage_score double, anomaly_score double, details string",
    "alerts": "id long, ts timestamp!, site_id string!, machine_id string, operator_id string, source string!, category string!, alert_code string!, title string!, message string!, recommended_action string, severity string!, stage string!, anomaly_score double, evidence string, acknowledged_by string, acknowledged_at timestamp, resolved_at timestamp",
    "safety_events": "id long, ts timestamp!, site_id string!, machine_id string, operator_id string, event_type string!, severity string!, distance_m double, sector string, approaching boolean, details string, alert_id long, resolved boolean!",
    "fatigue_log": "id long, ts timestamp!, operator_id string!, shift_id string, ear_avg double, perclos_60s double, yawn_count short, head_down_events short, phone_detected boolean, fatigue_score double, fatigue_level string!",
    "incidents": "id long, client_id string!, ts timestamp!, site_id string!, machine_id string, operator_id string, incident_type string!, severity string!, description string!, injury boolean!, damage_description string, root_cause string, reported_via string!, media_paths array<string>!, status string!, created_at timestamp!",
    "maintenance_log": "id long, machine_id string!, event_date timestamp!, engine_hours_at_event double!, component string!, event_type string!, downtime_hours double, cost_inr double, notes string",
    "maintenance_predictions": "id long, machine_id string!, predicted_at timestamp!, horizon_hours short!, failure_probability double!, likely_component string, top_factors string, model_version string!",
    "fleet_metrics_weekly": "entity_type string!, entity_id string!, site_id string!, week_start date!, productive_hours double, fuel_per_productive_hour double, idle_pct double, productivity_per_hour double, time_ratio double, anomaly_count int, safety_event_count int, efficiency_index double, cluster_id short, cluster_label string, is_outlier boolean, outlier_reason string, rank_in_site short, verified_by string, verified_at timestamp",
    "document_chunks": "id long, document_id string!, chunk_index int!, content string!, embedding array<float>, metadata string",
}


def schema(name: str) -> T.StructType:
    """The schema of a fleet table, to read files with and never to infer."""
    return T.StructType([T.StructField(f.name, f.dataType, f.name not in required(name)) for f in T._parse_datatype_string(TABLES[name].replace("!", "")).fields])


def required(name: str) -> set[str]:
    return {column.split()[0] for column in TABLES[name].replace("array<array<", "").split(", ") if column.endswith("!")}


def null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """column and number of rows where it is null, for columns that may not be."""
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns))).alias("x")).select("x.*").where("n > 0")


def value_violations(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Values outside an enumeration, of a column or the items of an array column."""
    values = df.select(F.explode(column).alias("value")) if df.schema[column].dataType.typeName() == "array" else df.select(F.col(column).alias("value"))
    return values.where(~F.col("value").isin(*allowed)).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def missing_references(df: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """rule, id, n: values of a reference that its target lacks."""
    lost = df.select(F.col(column).alias("id")).where("id is not null").join(target.select(F.col(key).alias("id")), "id", "left_anti")
    return lost.groupBy("id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(column).alias("rule"), "id", "n")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def first_error(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that does not hold (a NULL condition doesn't); NULL if all do."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules))
