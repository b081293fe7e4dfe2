"""How good a detector is by events and by failures rather than by rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import asof
from . import windows as W
from .islands import run_summary


def event_hits(events: DataFrame, minutes: DataFrame, key: str, tail_s: float) -> DataFrame:
    """events (key, start_ts, end_ts) with hit and delay_min: the first alerting minute from the start until `tail_s` after the end."""
    alerting = minutes.where("alert").select(key, F.col("ts").alias("_alert_ts"))
    found = asof.asof_join(events, alerting, key, "start_ts", "_alert_ts", ["_alert_ts"], "forward")
    hit = F.coalesce(F.unix_micros("_alert_ts") < F.unix_micros("end_ts") + round(tail_s * 1e6), F.lit(False))
    delay = F.when(hit, (F.unix_micros("_alert_ts") - F.unix_micros("start_ts")) / 6e7)
    return found.withColumns({"hit": hit, "delay_min": delay}).drop("_alert_ts")


def event_recall(hits: DataFrame, kind: str) -> DataFrame:
    """One row a kind of event: events, the share that was hit, the median delay of these."""
    return hits.groupBy(kind).agg(F.count(F.lit(1)).alias("events"), F.avg(F.col("hit").cast("double")).alias("event_recall"), F.median("delay_min").alias("median_delay_min"))


def false_alert_rate(minutes: DataFrame, key: str, gap_s: float) -> DataFrame:
    """One row: runs of alerting minutes that touch no event (`near`), hours without any, and such runs in 100 of them."""
    runs = run_summary(minutes.withColumn("us", W.micros("ts")), key, gap_s, "alert", touches=F.max("near")).where("alert and not touches")
    hours = minutes.agg((F.count_if(~F.col("near")) / 60).alias("normal_h"))
    return runs.agg(F.count(F.lit(1)).alias("false_alerts")).join(F.broadcast(hours)).select("false_alerts", "normal_h", (100 * F.try_divide(F.col("false_alerts").cast("double"), F.col("normal_h"))).alias("false_alerts_per_100_h"))  # a row each


def failure_leads(hours: DataFrame, key: str, alarm: float, high: float) -> DataFrame:
    """One row a failure: hours before it, the share that alarms, whether any does, the lead of the first high one (0: none), the highest.

    hours: key, ts, next_failure_ts, hours_to_failure, label, p.
    """
    before = hours.where("label = 1")
    p, lead = F.col("p"), F.min_by(F.when(F.col("p") >= high, F.col("hours_to_failure")), F.when(F.col("p") >= high, F.col("ts")))
    return before.groupBy(key, "next_failure_ts").agg(F.count(F.lit(1)).alias("hours"), F.avg((p >= alarm).cast("double")).alias("recall"), F.max(p >= alarm).alias("caught"), F.coalesce(lead, F.lit(0.0)).alias("lead_h"), F.max(p).alias("max_p"))


def false_alarm_rate(hours: DataFrame, key: str, alarm: float) -> DataFrame:
    """One row: runs of alarming rows that hold no labelled one, machine-weeks from first to last row, and such runs in one of them."""
    runs = run_summary(hours.withColumns({"us": W.micros("ts"), "_alarm": F.col("p") >= alarm}), key, float(1 << 40), "_alarm", hit=F.max("label")).where("_alarm and hit = 0")
    weeks = hours.agg((F.countDistinct(key) * (F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / (7 * W.DAY * 1e6)).alias("machine_weeks"))
    return runs.agg(F.count(F.lit(1)).alias("false_alarms")).join(F.broadcast(weeks)).select("false_alarms", "machine_weeks", F.try_divide(F.col("false_alarms").cast("double"), F.col("machine_weeks")).alias("per_machine_week"))  # a row each


def knee(df: DataFrame, value: str) -> DataFrame:
    """One row: the value at the knee of the sorted curve, the point furthest below the chord from the least to the greatest value.

    Equal values count as the last of their places. Places come from counts by value, summed in buckets.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_k"))
    ends = counts.agg(F.sum("_k").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    down = W.running_totals(counts, value, ["_k"]).join(F.broadcast(ends))  # one row
    place = F.try_divide((F.col("n") - F.col("total__k") + F.col("_k") - 1).cast("double"), (F.col("n") - 1).cast("double"))
    below = place - F.try_divide(F.col(value) - F.col("lo"), F.col("hi") - F.col("lo"))
    return down.agg(F.max_by(value, F.struct(below.alias("below"), (-F.col(value)).alias("v"))).alias("eps"))
