"""Minute features of telemetry, and what a detector's flags mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import clean, islands
from ..operators import windows as W
from .health import RANGES

#: Signals with features, and the settling and persistence of flags.
SIGNALS = [*RANGES, "pitch_deg", "roll_deg", "ground_speed_kmh"]
GAP_S, SETTLE_MIN, PERSIST = 120, 5, 3


def features(telemetry: DataFrame) -> DataFrame:
    """One row a minute: means, deviations and slopes of each signal, shares and ratios, state and its age, the glitched signal.

    All windows are over one machine in time order, so one shuffle serves them.
    """
    df = telemetry.withColumn("us", W.micros("ts"))
    idle = F.coalesce(F.col("is_idle"), F.lit(False))
    df = clean.repair_glitches(df.withColumn("_idle", idle), "machine_id", RANGES, GAP_S, {"oil_pressure_kpa": F.col("engine_rpm") > 500})
    df = islands.runs(df, "machine_id", GAP_S, "_idle")
    first = F.first("us").over(Window.partitionBy("machine_id").orderBy("us").rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_t", (F.col("us") - first) / 6e7)
    m5, m15, m30 = (W.trailing("machine_id", 60 * m) for m in (5, 15, 30))
    new: dict[str, Column] = {}
    for s in SIGNALS:
        x = F.col(s).cast("double")
        new |= {f"{s}_mean5": F.coalesce(F.avg(x).over(m5), F.lit(0.0)), f"{s}_std5": F.coalesce(F.stddev_pop(x).over(m5), F.lit(0.0)), f"{s}_slope15": W.slope(F.col("_t"), x, m15)}
    load = F.greatest(F.col("engine_load_pct"), F.lit(0.0)) + 1
    new |= {"idle_pct30": 100 * F.avg(F.col("_idle").cast("double")).over(m30), "rpm_per_load": F.coalesce(F.col("engine_rpm") / load, F.lit(0.0)), "fuel_per_load": F.coalesce(F.col("fuel_rate_lph") / load, F.lit(0.0)), "coolant_minus_hyd_oil_c": F.coalesce(F.col("coolant_temp_c") - F.col("hydraulic_oil_temp_c"), F.lit(0.0))}
    state = F.when(F.col("_idle"), "idle").otherwise("working")
    return df.select("machine_id", "ts", "us", state.alias("state"), ((F.col("us") - F.col("run_start")) / 6e7).alias("state_age_min"), "glitch", *(c.alias(n) for n, c in new.items()))


def classify(scored: DataFrame, flagged: str = "flagged") -> DataFrame:
    """Adds kind: a glitch at once; a fault from the third counting flag in a row; else normal.

    A flag counts once the machine has been long enough in its state.
    """
    w = W.by("machine_id")
    counts = F.coalesce(F.col(flagged), F.lit(False)) & (F.col("state_age_min") >= SETTLE_MIN)
    new = ~counts | F.lag("us").over(w).isNull() | (F.col("us") - F.lag("us").over(w) > GAP_S * 1_000_000)
    run = F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = scored.withColumns({"_counts": counts}).withColumn("_run", run)
    n = F.sum(F.col("_counts").cast("int")).over(W.by(["machine_id", "_run"]).rowsBetween(Window.unboundedPreceding, 0))
    kind = F.when(F.col("glitch").isNotNull(), "sensor_glitch").when(F.col("_counts") & (n >= PERSIST), "machine_fault").otherwise("normal")
    return rows.withColumn("kind", kind).drop("_counts", "_run")


def robust_score(features_: DataFrame, scales: DataFrame, columns: list[str], limit: float = 4.0) -> DataFrame:
    """A stand-in for a trained detector: the largest standardised feature of the row's type and state.

    scales: machine_type, state, mean_c and std_c (see `scoring.fit_scales`). Adds score, 0 to 1, and flagged.
    """
    from ..operators.scoring import z_scores

    z = z_scores(features_, scales, ["machine_type", "state"], dict.fromkeys(columns, 1.0))
    top = F.greatest(*(F.abs(f"z_{c}") for c in columns), F.lit(0.0))
    return z.withColumns({"score": F.least(top / (2 * limit), F.lit(1.0)), "flagged": top > limit}).drop(*(f"z_{c}" for c in columns))
