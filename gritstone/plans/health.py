"""Subsystem health from open alerts, anomalies and failure predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import bands
from ..operators import clean
from ..operators import windows as W

SUBSYSTEMS = ["engine", "hydraulics", "cooling", "electrical", "undercarriage"]
#: What each alert, fault code, severity and signal means for health.
ALERTS = {"COOLANT_HIGH": "cooling", "COOLANT_CRITICAL": "cooling", "HYD_OIL_HIGH": "hydraulics", "HYD_PRESSURE_DROP": "hydraulics", "OIL_PRESSURE_LOW": "engine", "BATTERY_LOW": "electrical"}
CODES = {"E-110": "cooling", "E-215": "engine", "E-360": "hydraulics", "E-365": "hydraulics", "E-410": "electrical"}
PENALTY = {"info": 0.0, "warning": 0.3, "critical": 0.7, "emergency": 0.7}
SIGNALS = {"engine_rpm": ["engine"], "oil_pressure_kpa": ["engine"], "engine_oil_temp_c": ["engine"], "vibration_rms_g": ["engine"], "rpm_per_load": ["engine"], "coolant_temp_c": ["cooling"], "hydraulic_pressure_bar": ["hydraulics"], "hydraulic_oil_temp_c": ["hydraulics"], "coolant_minus_hyd_oil_c": ["cooling", "hydraulics"], "battery_voltage": ["electrical"]}
ANOMALY_WEIGHT = 0.6
BANDS = [(0.75, "green"), (0.5, "orange")]
RANGES = {"engine_rpm": (0, 3000), "engine_load_pct": (-10, 110), "coolant_temp_c": (10, 130), "oil_pressure_kpa": (20, 800), "hydraulic_pressure_bar": (-10, 1000), "hydraulic_oil_temp_c": (10, 120), "fuel_rate_lph": (0, 80), "battery_voltage": (18, 32), "vibration_rms_g": (0, 5)}


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def alert_penalties(alerts: DataFrame) -> DataFrame:
    """machine_id, subsystem, penalty of open alerts (alert_code, severity, stage, fault_code)."""
    code = F.when(F.col("alert_code") == "FAULT_CODE", F.col("fault_code")).otherwise(F.col("alert_code"))
    subsystem = _map({**ALERTS, **CODES})[code]
    return alerts.where(F.coalesce(F.col("stage") != "resolved", F.lit(True))).select("machine_id", subsystem.alias("subsystem"), _map(PENALTY)[F.lower("severity")].alias("penalty")).where("subsystem is not null and penalty > 0")


def anomaly_penalties(anomalies: DataFrame) -> DataFrame:
    """Of faults only: the score counts for the subsystems of its top signals (top: array of feature names)."""
    signal = F.explode(F.transform("top", lambda f: F.regexp_replace(f, "_(mean5|std5|slope15)$", "")))
    each = anomalies.where("kind = 'machine_fault'").select("machine_id", "anomaly_score", F.coalesce("travelling", F.lit(False)).alias("travelling"), signal.alias("signal"))
    table = F.create_map(*(x for k, v in SIGNALS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    subsystems = F.when((F.col("signal") == "vibration_rms_g") & F.col("travelling"), F.array(F.lit("undercarriage"))).otherwise(table[F.col("signal")])
    return each.select("machine_id", F.explode(subsystems).alias("subsystem"), F.least(ANOMALY_WEIGHT * F.col("anomaly_score"), F.lit(1.0)).alias("penalty")).where("penalty > 0")


def prediction_penalties(predictions: DataFrame, capped: bool = True) -> DataFrame:
    """The failure probability counts for the likely component, 1 at most if it is capped."""
    p = F.col("failure_probability").cast("double")
    return predictions.where(F.col("likely_component").isin(*SUBSYSTEMS)).select("machine_id", F.col("likely_component").alias("subsystem"), (F.least(p, F.lit(1.0)) if capped else p).alias("penalty")).where("penalty > 0")


def health(machines: DataFrame, *penalties: DataFrame) -> DataFrame:
    """Scores of the subsystems (1 less the worst penalty), the lowest of them, and its band."""
    found = penalties[0]
    for p in penalties[1:]:
        found = found.unionByName(p)
    worst = found.groupBy("machine_id").agg(*(F.max(F.when(F.col("subsystem") == s, F.col("penalty"))).alias(s) for s in SUBSYSTEMS))
    rows = machines.select("machine_id").join(worst, "machine_id", "left")
    scores = {f"{s}_score": F.bround(1 - F.coalesce(s, F.lit(0.0)), 3) for s in SUBSYSTEMS}
    scored = rows.withColumns(scores).drop(*SUBSYSTEMS)
    return scored.withColumn("overall_score", F.least(*scores)).withColumn("band", bands(F.col("overall_score"), BANDS, "red"))


def rule_states(telemetry: DataFrame, live: bool = False) -> DataFrame:
    """machine_id, ts, states (map of code to severity) of each reading, after glitch repair.

    live: a hold counts only if the window is covered; else a lone reading after a gap is enough.
    """
    df = telemetry.withColumn("us", W.micros("ts"))
    c = clean.repair_glitches(df, "machine_id", RANGES, 120, {"oil_pressure_kpa": F.col("engine_rpm") > 500})

    def held(cond: Column, minutes: float) -> Column:
        lasting = W.held_for(F.coalesce(cond, F.lit(False)), "machine_id", 60 * minutes)
        covered = F.count(F.lit(1)).over(W.trailing("machine_id", 60 * minutes)) >= int(minutes)
        return lasting & covered if live else lasting

    cool, oil = F.col("coolant_temp_c"), F.col("hydraulic_oil_temp_c")
    levels = {
        "COOLANT_CRITICAL": F.when(cool > 105, "critical"), "COOLANT_HIGH": F.when(held(cool > 100, 2) & (cool <= 105), "warning"), "HYD_OIL_HIGH": F.when(oil > 95, "critical").when(oil > 90, "warning"),
        "OIL_PRESSURE_LOW": F.when((F.col("oil_pressure_kpa") < 100) & (F.col("engine_rpm") > 1200), "critical"), "BATTERY_LOW": F.when(held(F.col("battery_voltage") < 24, 5), "warning"),
    }
    items = [F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in levels.items()]
    items.append(F.struct(F.col("fault_code").alias("k"), F.when(F.col("fault_code").isin(*CODES), "warning").alias("v")))
    return c.select("machine_id", "ts", F.map_from_entries(F.filter(F.array(*items), lambda x: x["v"].isNotNull())).alias("states"))
