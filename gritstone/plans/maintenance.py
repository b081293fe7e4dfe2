"""Engine hours, hourly features, failure labels and component scores."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import aggregates, asof, boosting, scoring
from ..operators import windows as W
from ..operators.islands import run_starts

#: Fixed values of the failure model.
HORIZON_H, WINDOWS, BASELINE, HIGH_LOAD_PCT, TRAVEL_KMH = 48.0, (24, 72), (336, 72), 80.0, 2.0
SIGNALS = {"coolant_temp_c": 1, "oil_pressure_kpa": -1, "hydraulic_oil_temp_c": 1, "hydraulic_pressure_bar_std": 1, "vibration_rms_g": 1, "battery_voltage": -1, "vibration_travel_g": 1}
COMPONENTS = {"engine": ["oil_pressure_kpa", "vibration_rms_g"], "cooling": ["coolant_temp_c"], "hydraulics": ["hydraulic_oil_temp_c", "hydraulic_pressure_bar_std"], "electrical": ["battery_voltage"], "undercarriage": ["vibration_travel_g"]}
FLOOR_Z, FLOOR_P = 6.0, 0.35
RISK = [(0.6, "high"), (0.3, "medium")]


def failures(log: DataFrame) -> DataFrame:
    """Failures with the first repair of the machine at or after each."""
    f = log.where("event_type = 'failure'").select("machine_id", F.col("event_date").alias("failure_ts"), "component", "engine_hours_at_event")
    r = log.where("event_type = 'repair'").select("machine_id", F.col("event_date").alias("repair_ts"))
    return asof.asof_join(f, r, "machine_id", "failure_ts", "repair_ts", ["repair_ts"], "forward")


def shift_engine_hours(shifts: DataFrame, machines: DataFrame, log: DataFrame) -> DataFrame:
    """eh_start and eh_end of each shift, anchored at the machine's total after its last shift.

    A shift counts in full, up to the first failure inside it.
    """
    cut = asof.cut_by_first(shifts.select("shift_id", "machine_id", "start_time", "end_time"), failures(log), "machine_id", "start_time", "end_time", "failure_ts", "stop")
    hours = (F.unix_micros("stop") - F.unix_micros("start_time")) / 3.6e9
    rows = cut.withColumn("hours", hours).join(machines.select("machine_id", "total_engine_hours"), "machine_id", "left")
    from_here = W.reverse_total(F.col("hours"), W.by("machine_id", "start_time"))
    start = F.col("total_engine_hours") - from_here
    return rows.select("shift_id", "machine_id", "start_time", start.alias("eh_start"), (start + F.col("hours")).alias("eh_end"))


def minute_engine_hours(telemetry: DataFrame, shift_hours: DataFrame) -> DataFrame:
    """Telemetry with engine_h: the shift's start and the time since."""
    s = shift_hours.select("shift_id", F.col("start_time").alias("_start"), "eh_start")
    joined = telemetry.join(s, "shift_id", "left")
    return joined.withColumn("engine_h", F.col("eh_start") + (F.unix_micros("ts") - F.unix_micros("_start")) / 3.6e9).drop("_start", "eh_start")


def hourly(minutes: DataFrame) -> DataFrame:
    """One row a machine and engine hour: last time, minutes, means, starts of fault runs and codes."""
    m = minutes.withColumns({"us": W.micros("ts"), "bin": F.floor("engine_h")})
    m = m.withColumns({"fault_start": run_starts(F.col("kind") == "machine_fault", "machine_id", 120), "code_start": run_starts(F.col("fault_code").isNotNull(), "machine_id", 120, "fault_code")})
    mean = {c: F.avg(c) for c in ("coolant_temp_c", "oil_pressure_kpa", "hydraulic_oil_temp_c", "vibration_rms_g", "battery_voltage")}
    extra = {"hydraulic_pressure_bar_std": F.stddev_pop("hydraulic_pressure_bar"), "vibration_travel_g": F.avg(F.when(F.col("ground_speed_kmh") > TRAVEL_KMH, F.col("vibration_rms_g")))}
    counts = {"anomaly_score_sum": F.sum("anomaly_score"), "anomaly_count": F.count_if("fault_start"), "fault_code_count": F.count_if("code_start"), "high_load_min": F.count_if(F.col("engine_load_pct") > HIGH_LOAD_PCT)}
    return m.groupBy("machine_id", "bin").agg(F.max("ts").alias("ts"), F.max_by("engine_h", "ts").alias("engine_h"), F.count(F.lit(1)).alias("n_min"), *(c.alias(n) for n, c in {**mean, **extra, **counts}.items()))


def hourly_features(hours: DataFrame, machines: DataFrame, log: DataFrame) -> DataFrame:
    """Trailing means, slopes and deviations by engine hour, and the time since service.

    All windows share one partitioning by machine.
    """
    first = Window.partitionBy("machine_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    h = hours.withColumns({"us": W.micros("ts"), "_t": (F.col("bin") - F.first("bin").over(first)).cast("double")})
    new = {}
    for w in WINDOWS:
        frame = W.by("machine_id", "bin").rangeBetween(-(w - 1), 0)
        for s in SIGNALS:
            new[f"{s}_mean{w}"] = W.weighted_trailing_mean(F.col(s), F.col("n_min"), frame)
            new[f"{s}_slope{w}"] = W.slope(F.col("_t"), F.col(s), frame, null_aware=True)
    day = W.by("machine_id", "bin").rangeBetween(-23, 0)
    new |= {"anomaly_count24": F.sum("anomaly_count").over(day), "fault_code_count24": F.sum("fault_code_count").over(day), "anomaly_score_mean24": F.sum("anomaly_score_sum").over(day) / F.sum("n_min").over(day)}
    new["fault_code_count7d"] = F.sum("fault_code_count").over(W.trailing("machine_id", 7 * W.DAY))
    far, near = BASELINE
    new |= {f"_base_{s}": W.lagged_mean(F.col(s), F.col("n_min"), "machine_id", "bin", far, near, 60) for s in SIGNALS}
    f = h.withColumns(new)
    f = f.withColumns({f"{s}_dev24": F.col(f"{s}_mean24") - F.col(f"_base_{s}") for s in SIGNALS}).drop(*(f"_base_{s}" for s in SIGNALS), "_t")
    services = log.where("event_type = 'scheduled_service'").select("machine_id", F.col("event_date").alias("service_ts"), F.col("engine_hours_at_event").alias("service_eh"))
    f = asof.asof_join(f, services, "machine_id", "ts", "service_ts", ["service_ts", "service_eh"])
    own = machines.select("machine_id", "machine_type", "service_interval_hours", "year")
    f = f.join(own, "machine_id", "left")
    since = F.when(F.col("service_eh").isNotNull(), F.greatest(F.col("engine_h") - F.col("service_eh"), F.lit(0.0)))
    load = F.sum("high_load_min").over(Window.partitionBy("machine_id", "service_ts").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / 60
    built = F.make_date(F.col("year"), F.lit(1), F.lit(1))
    out = f.withColumns({"hours_since_service": since, "service_ratio": since / F.col("service_interval_hours"), "high_load_hours_since_service": load, "age_years": F.datediff(F.to_date("ts"), built) / 365.25})
    return out.drop("us", "service_eh", "service_ts", "service_interval_hours", "year")


def labels(features: DataFrame, log: DataFrame, run_end: DataFrame, horizon: float = HORIZON_H) -> DataFrame:
    """Hours to the next failure, the label, and whether the row can be used.

    Not usable: between a failure and its repair, and too near the end of the data (`run_end`:
    machine_id, end_eh) with no failure ahead.
    """
    f = failures(log)
    d = asof.asof_join(features, f.select("machine_id", F.col("failure_ts").alias("next_failure_ts"), F.col("component").alias("next_component"), F.col("engine_hours_at_event").alias("_eh")), "machine_id", "ts", "next_failure_ts", ["next_failure_ts", "next_component", "_eh"], "forward", exact=False)
    d = asof.asof_join(d, f.select("machine_id", F.col("failure_ts").alias("_failed"), F.col("repair_ts").alias("_repaired")), "machine_id", "ts", "_failed", ["_failed", "_repaired"])
    d = d.join(run_end, "machine_id", "left")
    left = F.col("_eh") - F.col("engine_h")
    down = F.coalesce((F.col("ts") >= F.col("_failed")) & (F.col("ts") <= F.col("_repaired")), F.lit(False))
    censored = F.col("next_failure_ts").isNull() & F.coalesce(F.col("end_eh") - F.col("engine_h") < horizon, F.lit(False))
    hit = F.coalesce((left > 0) & (left <= horizon), F.lit(False))
    return d.withColumns({"hours_to_failure": left, "label": hit.cast("int"), "keep": ~down & ~censored}).drop("_eh", "_failed", "_repaired", "end_eh")


def folds(features: DataFrame, bounds: list[datetime], horizon: float = HORIZON_H) -> DataFrame:
    """Rows with fold (from 1) and part: each fold tests on the time between two bounds and trains on all before.

    Training rows whose label looks into the tested time are purged: those less than `horizon` engine hours before
    the machine's first row in it.
    """
    out = []
    for k, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False), 1):
        lo_, hi_ = F.lit(lo), F.lit(hi)
        begins = features.where(F.col("ts") >= lo_).groupBy("machine_id").agg(F.min("engine_h").alias("_begins"))
        d = features.where(F.col("ts") < hi_).join(begins, "machine_id", "left")
        fits = F.coalesce(F.col("engine_h") <= F.col("_begins") - horizon, F.lit(True))
        part = F.when(F.col("ts") >= lo_, "test").when(fits, "train")
        out.append(d.withColumns({"fold": F.lit(k), "part": part}).where("part is not null").drop("_begins"))
    return reduce(DataFrame.unionByName, out)


def fit_scales(rows: DataFrame) -> DataFrame:
    """Means and sample deviations of trends and deviations by machine type, from more than ten rows."""
    return scoring.fit_scales(rows, ["machine_type"], [f"{s}_{k}" for s in SIGNALS for k in ("slope72", "dev24")], population=False, least=10)


def add_scores(features: DataFrame, scales: DataFrame) -> DataFrame:
    """Signed scores of each signal, the worst of them, component scores and the likely component."""
    signs = {f"{s}_{k}": float(sign) for s, sign in SIGNALS.items() for k in ("slope72", "dev24")}
    z = scoring.z_scores(features, scales, ["machine_type"], signs)
    move = {s: F.greatest(f"z_{s}_dev24", f"z_{s}_slope72") for s in SIGNALS}
    # vibration everywhere is engine wear; only what travel adds to it is the undercarriage's
    move["vibration_travel_g"] = move["vibration_travel_g"] - F.greatest(F.coalesce(move["vibration_rms_g"], F.lit(0.0)), F.lit(0.0))
    score = {c: F.greatest(*(move[s] for s in own)) if len(own) > 1 else move[own[0]] for c, own in COMPONENTS.items()}
    trends = [f"z_{s}_slope72" for s in SIGNALS if s != "vibration_travel_g"]
    return z.withColumns({**{f"score_{c}": x for c, x in score.items()}, "likely_component": aggregates.row_max(score)[1], "worst_dev_z24": F.greatest(*(f"z_{s}_dev24" for s in SIGNALS)), "worst_trend_z72": F.greatest(*trends)})


def baseline_probability(scored: DataFrame) -> DataFrame:
    """Adds p_baseline: the worst trend over 6, at least a half if service is overdue; and p_floor for large deviations."""
    p = F.least(F.greatest(F.coalesce("worst_trend_z72", F.lit(0.0)) / 6, F.lit(0.0)), F.lit(1.0))
    overdue = F.coalesce(F.col("service_ratio") >= 1, F.lit(False))
    floor = F.when(F.col("worst_dev_z24") >= FLOOR_Z, FLOOR_P).otherwise(0.0)
    return scored.withColumns({"p_baseline": F.when(overdue, F.greatest(p, F.lit(0.5))).otherwise(p), "p_floor": floor})


def apply_floor(df: DataFrame, probability: str) -> DataFrame:
    """The probability raised to the floor, with its risk band."""
    from ..functions.predicates import bands

    return df.withColumn(probability, F.greatest(probability, "p_floor")).withColumn("risk_band", bands(F.col(probability), RISK, "low"))


def failure_forecast(rows: DataFrame, nodes: DataFrame, features: list[str], floor_signal: str, n: int = 3) -> DataFrame:
    """Adds p, risk_band and top_factors: what pushes the log-odds up most, or, if nothing does, what moves them most; to a thousandth.

    floor_signal: a column with the feature that lies so far off that the probability has a floor (`FLOOR_P`), else NULL; that feature is named first. One that the model doesn't
    know is named with a NULL share.
    """
    parts = {c: F.col("_parts")[i] for i, c in enumerate(features)}
    got = boosting.contributions(boosting.predict(rows, nodes, features, [boosting.LOGIT], "_p"), nodes, features, boosting.LOGIT, "_parts", "_base")
    got = got.withColumns({"p": F.col("_p")[0], "p_floor": F.when(F.col(floor_signal).isNotNull(), FLOOR_P).otherwise(0.0)})
    own = F.struct(F.col(floor_signal).alias("name"), F.map_from_arrays(F.array(*map(F.lit, features)), F.col("_parts"))[F.col(floor_signal)].alias("value"))
    top = scoring.top_contributions(parts, n)
    others = F.filter(top, lambda x: x["name"] != F.col(floor_signal))
    named = F.when(F.col(floor_signal).isNotNull(), F.concat(F.array(own), F.slice(others, 1, n - 1))).otherwise(top)
    rounded = F.transform(named, lambda x: F.struct(x["name"].alias("feature"), F.round(x["value"], 3).alias("shap")))
    return apply_floor(got.withColumn("top_factors", rounded), "p").drop("_p", "_parts", "_base", "p_floor")
