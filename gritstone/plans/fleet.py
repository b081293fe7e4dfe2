"""Weekly metrics of operators and machines, their scores and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import monday
from ..operators import aggregates, asof, islands, scoring
from ..operators.windows import micros

KEYS = ["entity_type", "entity_id", "site_id", "week_start"]
#: Weights of the efficiency index on standardised features.
WEIGHTS = {"z_productivity_per_hour": 0.35, "z_fuel_per_productive_hour": -0.25, "z_idle_pct": -0.20, "z_time_ratio": -0.20}
FEATURES = ["fuel_per_productive_hour", "idle_pct", "productivity_per_hour", "time_ratio", "anomaly_per_10h", "safety_per_10h"]


def fault_starts(minutes: DataFrame, gap_seconds: float = 120) -> DataFrame:
    """machine_id and ts of the first minute of each run of minutes of kind machine_fault."""
    marked = minutes.withColumn("us", micros("ts"))
    start = islands.run_starts(F.col("kind") == "machine_fault", "machine_id", gap_seconds)
    return marked.withColumn("_start", start).where("_start").select("machine_id", "ts")


def weekly_segments(telemetry: DataFrame, tasks: DataFrame, shifts: DataFrame, machines: DataFrame, safety_events: DataFrame, faults: DataFrame, p50: str = "fleet_p50_min", excluded: tuple[str, ...] = ("fatigue_high",), chunk: float | None = None) -> DataFrame:
    """Metrics of each entity, week and machine type, for operators and machines.

    Each source is brought to one row a shift before anything is joined, so only shift-sized
    rows are shuffled twice. A shift without any source row drops out. `chunk` seconds cut a hot
    machine's events into stretches that are sorted apart.
    """
    t = telemetry.groupBy("shift_id").agg(F.count(F.lit(1)).cast("double").alias("engine_min"), F.sum(F.col("is_idle").cast("double")).alias("idle_min"), (F.sum("fuel_rate_lph") / 60).alias("fuel_l"))
    done = tasks.where((F.col("status") == "completed") & F.col("actual_duration_min").isNotNull())
    timed = F.col(p50).isNotNull()
    k = done.groupBy("shift_id").agg(F.sum("quantity").alias("quantity"), F.sum(F.when(timed, F.col("actual_duration_min"))).alias("actual_min"), F.sum(F.when(timed, F.col(p50))).alias("p50_min"))
    events = safety_events.where(~F.col("event_type").isin(*excluded)).select("machine_id", "ts", F.lit("safety_n").alias("what")).unionByName(faults.select("machine_id", "ts", F.lit("anomaly_n").alias("what")))
    placed = asof.point_in_interval(events, shifts.select("machine_id", "shift_id", "start_time", "end_time"), "machine_id", "ts", "start_time", "end_time", ["shift_id"], chunk)
    e = placed.where("shift_id is not null").groupBy("shift_id").agg(F.count_if(F.col("what") == "safety_n").cast("double").alias("safety_n"), F.count_if(F.col("what") == "anomaly_n").cast("double").alias("anomaly_n"))
    sums = ["engine_min", "idle_min", "fuel_l", "quantity", "actual_min", "p50_min", "safety_n", "anomaly_n"]
    per = t.join(k, "shift_id", "full").join(e, "shift_id", "full").fillna(0.0, sums)
    sh = shifts.select("shift_id", "site_id", "operator_id", "machine_id", monday(F.col("shift_date")).alias("week_start")).join(machines.select("machine_id", "machine_type"), "machine_id", "left")
    rows = sh.join(per, "shift_id")
    entity = F.explode(F.array(F.struct(F.lit("operator").alias("entity_type"), F.col("operator_id").alias("entity_id")), F.struct(F.lit("machine").alias("entity_type"), F.col("machine_id").alias("entity_id"))))
    both = rows.withColumn("_e", entity).select("_e.*", "site_id", "week_start", "machine_type", *sums)
    return metrics(both.groupBy(*KEYS, "machine_type").agg(*(F.sum(c).alias(c) for c in sums)))


def metrics(a: DataFrame) -> DataFrame:
    """Ratios from the sums of an entity's week; without productive time there is no rate."""
    hours = (F.col("engine_min") - F.col("idle_min")) / 60
    per_hour = lambda x: F.when(hours > 0, x / hours)
    return a.where("engine_min > 0").select(
        *KEYS, "machine_type", hours.alias("productive_hours"), per_hour(F.col("fuel_l")).alias("fuel_per_productive_hour"), (100 * F.col("idle_min") / F.col("engine_min")).alias("idle_pct"),
        per_hour(F.col("quantity")).alias("productivity_per_hour"), F.when(F.col("p50_min") > 0, F.col("actual_min") / F.col("p50_min")).alias("time_ratio"), F.col("anomaly_n").cast("long").alias("anomaly_count"), F.col("safety_n").cast("long").alias("safety_event_count"),
    )


def features(segments: DataFrame) -> DataFrame:
    """Adds rates of events for ten engine hours."""
    engine_h = _engine_hours()
    rate = lambda c: F.when(engine_h > 0, 10 * F.col(c) / engine_h)
    return segments.withColumns({"anomaly_per_10h": rate("anomaly_count"), "safety_per_10h": rate("safety_event_count")})


def _engine_hours() -> Column:
    return F.col("productive_hours") / F.greatest(1 - F.col("idle_pct") / 100, F.lit(1e-6))


def fit_scales(segments: DataFrame, least_hours: float = 4.0) -> DataFrame:
    """Mean and deviation of each feature by entity and machine type, from segments long enough."""
    return scoring.fit_scales(features(segments).where(F.col("productive_hours") >= least_hours), ["entity_type", "machine_type"], FEATURES)


def entity_weeks(segments: DataFrame, scales: DataFrame) -> DataFrame:
    """One row an entity and week: re-derived metrics, hours-weighted standard scores, the machine type driven most."""
    z = scoring.z_scores(features(segments), scales, ["entity_type", "machine_type"], dict.fromkeys(FEATURES, 1.0))
    h, e = F.col("productive_hours"), _engine_hours()
    total = F.sum("productive_hours")
    rate = lambda c: F.when(total > 0, F.sum(F.col(c) * h) / total)
    out = z.groupBy(*KEYS).agg(
        aggregates.most(F.col("machine_type"), h).alias("machine_type"), F.count_distinct("machine_type").alias("n_machine_types"), total.alias("productive_hours"), rate("fuel_per_productive_hour").alias("fuel_per_productive_hour"),
        F.when(F.sum(e) > 0, 100 * (1 - total / F.sum(e))).alias("idle_pct"), rate("productivity_per_hour").alias("productivity_per_hour"), aggregates.weighted_mean(F.col("time_ratio"), h).alias("time_ratio"),
        F.sum("anomaly_count").alias("anomaly_count"), F.sum("safety_event_count").alias("safety_event_count"), *(aggregates.weighted_mean(F.col(f"z_{c}"), h).alias(f"z_{c}") for c in FEATURES),
    )
    return out.withColumn("efficiency_index", scoring.index(WEIGHTS)).withColumn("rank_in_site", scoring.rank_desc(["site_id", "week_start", "entity_type"], "efficiency_index"))
