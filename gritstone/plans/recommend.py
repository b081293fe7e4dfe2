"""Training recommendations from a week's events, and the facts of a handover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plural
from ..operators import asof
from ..sources.shared import written_once

#: Event type, least count and module of the safety rules, in order of priority.
SAFETY = (("tip_risk", 1, "TM-SAFE-03"), ("seatbelt_unfastened", 1, "TM-SAFE-02"), ("proximity_breach", 2, "TM-SAFE-01"))
HARSH, TIME_RATIO, TIME_TASKS, IDLE_PCT, MOST_OPEN, WINDOW_DAYS = 3, 1.2, 2, 25.0, 2, 7


MODULES = [*(m for _, _, m in SAFETY), "TM-SMTH-01", "TM-SIM-01", "TM-EXC-01", "TM-CYC-01", "TM-IDLE-01", "TM-FUEL-01"]


def counts(events: DataFrame, key: str, as_of: Column) -> DataFrame:
    """Events of each kind in the week before an instant; blind-spot intrusions count as proximity."""
    kind = F.when(F.col("event_type") == "blindspot_intrusion", "proximity_breach").otherwise(F.col("event_type"))
    week = (F.col("ts") >= as_of - F.expr(f"interval {WINDOW_DAYS} days")) & (F.col("ts") < as_of)
    return events.where(week).groupBy(key, kind.alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))


def fired(counted: DataFrame, key: str, clusters: DataFrame, ratios: DataFrame, idle: DataFrame) -> DataFrame:
    """key, place (priority), metric, value, modules of every rule that fires.

    clusters: key, cluster_label. ratios: key, task_type, ratio, n. idle: key, idle_pct.
    """
    rules = [*((m, n, [module]) for m, n, module in SAFETY), ("harsh_maneuver", HARSH, ["TM-SMTH-01"])]
    place = {m: float(i if m != "harsh_maneuver" else 4) for i, (m, _, _) in enumerate(rules)}
    table = lambda i: F.create_map(*(x for r in rules for x in (F.lit(r[0]), i(r))))
    simple = counted.where(F.col("value") >= table(lambda r: F.lit(r[1]))[F.col("metric")]).select(key, table(lambda r: F.lit(place[r[0]]))[F.col("metric")].alias("place"), "metric", "value", table(lambda r: F.array(*map(F.lit, r[2])))[F.col("metric")].alias("modules"))
    safety = clusters.where("cluster_label = 'needs safety coaching'").select(key).distinct().select(key, F.lit(3.0).alias("place"), F.lit("cluster_label").alias("metric"), F.lit(1.0).alias("value"), F.array(F.lit("TM-SIM-01")).alias("modules"))
    slow = ratios.where((F.col("ratio") > TIME_RATIO) & (F.col("n") >= TIME_TASKS)).select(key, (5 + 1 / (1 + F.col("ratio"))).alias("place"), F.lit("time_ratio").alias("metric"), F.col("ratio").alias("value"), F.array(F.when(F.col("task_type").isin("dig", "trench"), "TM-EXC-01").otherwise("TM-CYC-01")).alias("modules"))
    idling = idle.where(F.col("idle_pct") > IDLE_PCT).select(key, F.lit(6.0).alias("place"), F.lit("idle_pct").alias("metric"), F.col("idle_pct").alias("value"), F.array(F.lit("TM-IDLE-01"), F.lit("TM-FUEL-01")).alias("modules"))
    return simple.unionByName(safety).unionByName(slow).unionByName(idling)


def recommend(rules: DataFrame, key: str, existing: DataFrame, modules: DataFrame, now: Column) -> DataFrame:
    """New recommendations: by priority the first module that is neither open, nor recent, nor just taken; at most two open.

    existing: key, module_id, status, created_at. A key has a handful of rules, so they fold in an array.
    """
    taken = existing.groupBy(key).agg(F.collect_set(F.when(F.col("status").isin("pending", "booked") | (F.col("created_at") >= now - F.expr(f"interval {WINDOW_DAYS} days")), F.col("module_id"))).alias("taken"), F.count_if(F.col("status").isin("pending", "booked")).alias("open"))
    known = modules.where(F.col("module_id").isin(*MODULES)).agg(F.collect_set("module_id").alias("known"))  # no more than the rules name
    held = rules.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "metric", "value", "modules"))).alias("rules")).join(taken, key, "left").join(F.broadcast(known))
    empty = F.array().cast("array<struct<module_id:string,metric:string,value:double>>")
    slots = F.greatest(F.lit(MOST_OPEN) - F.coalesce("open", F.lit(0)), F.lit(0))

    def step(acc: Column, r: Column) -> Column:
        blocked = F.concat(F.coalesce("taken", F.array().cast("array<string>")), F.transform(acc, lambda x: x["module_id"]))
        free = F.filter(r["modules"], lambda m: F.array_contains("known", m) & ~F.array_contains(blocked, m))
        new = F.array(F.struct(F.get(free, F.lit(0)).alias("module_id"), r["metric"].alias("metric"), r["value"].alias("value")))
        return F.when((F.size(acc) < slots) & (F.size(free) > 0), F.concat(acc, new)).otherwise(acc)

    return held.select(key, F.posexplode(F.aggregate("rules", empty, step)).alias("place", "x")).select(key, "place", "x.*")


def reason(metric: Column, value: Column) -> Column:
    """A short plain reason."""
    n = value.cast("int")
    return F.when(metric == "harsh_maneuver", F.concat(plural(n, "harsh movement"), F.lit(" in the last 7 days"))).when(metric == "idle_pct", F.concat(F.lit("Idle for "), F.bround(value).cast("int").cast("string"), F.lit("% of engine time"))).otherwise(F.concat(F.lit("Happened "), plural(n, "time"), F.lit(" in the last 7 days")))


def handover_facts(shifts: DataFrame, alerts: DataFrame, events: DataFrame, tasks: DataFrame, predictions: DataFrame, chunk: float | None = None) -> DataFrame:
    """Facts of each shift at its end: open alerts, events by kind, unfinished tasks, fuel used, the latest prediction.

    Each source meets the shifts by one sort or by time buckets, so rows grow with what is found and not with
    shifts times events. Shifts of a machine don't overlap. `chunk` seconds cut a hot machine's series (see `asof_join`).
    """
    s = written_once(shifts.select("shift_id", "machine_id", "start_time", "end_time", (F.col("fuel_start_pct") - F.col("fuel_end_pct")).alias("fuel_used_pct")), "shifts")
    ends = s.select("shift_id", "machine_id", F.col("end_time").alias("_at"))
    spans = alerts.select("machine_id", "ts", F.coalesce("resolved_at", F.lit("9999-01-01").cast("timestamp")).alias("_until"), "alert_code")
    open_ = _open_at(spans, ends).groupBy("shift_id").agg(F.array_sort(F.collect_list("alert_code")).alias("open_alerts"))
    seen = asof.point_in_interval(events.select("machine_id", "ts", "event_type"), s, "machine_id", "ts", "start_time", "end_time", ["shift_id"], chunk).where("shift_id is not null")
    seen = seen.groupBy("shift_id", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("shift_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("events"))
    undone = tasks.where("status <> 'completed'").groupBy("shift_id").agg(F.count(F.lit(1)).alias("unfinished"))
    last = asof.asof_join(s, predictions.select("machine_id", "predicted_at", "failure_probability"), "machine_id", "end_time", "predicted_at", ["failure_probability"], chunk=chunk)
    out = last
    for part in (open_, seen, undone):
        out = out.join(part, "shift_id", "left")
    return out.select("shift_id", "machine_id", "start_time", "end_time", "fuel_used_pct", "open_alerts", "events", F.coalesce("unfinished", F.lit(0)).alias("unfinished"), "failure_probability")


def _open_at(spans: DataFrame, ends: DataFrame) -> DataFrame:
    """shift_id and alert_code of alerts that are open at a shift's end: raised at or before it and not resolved by then.

    An alert meets the next end of a shift after it was raised, and with that the ones that follow until it is resolved: ends are numbered
    by machine, and an alert covers a stretch of numbers.
    """
    place = written_once(ends.withColumn("_n", F.row_number().over(Window.partitionBy("machine_id").orderBy("_at", "shift_id"))), "ends")
    first = asof.asof_join(spans, place.select("machine_id", "_at", F.col("_n").alias("_from")), "machine_id", "ts", "_at", ["_from"], "forward", tie="_from")
    both = asof.asof_join(first, place.select("machine_id", "_at", F.col("_n").alias("_to")), "machine_id", "_until", "_at", ["_to"], exact=False, tie="_to")
    covered = both.where("_from <= _to").select("machine_id", "alert_code", F.explode(F.sequence("_from", "_to")).alias("_n"))
    return covered.join(place.select("machine_id", "_n", "shift_id"), ["machine_id", "_n"]).select("shift_id", "alert_code")


def handover_candidates(shifts: DataFrame, failed: DataFrame, now: Column, lookback: str = "12 hours", retry: str = "10 minutes") -> DataFrame:
    """Shifts that ended within the lookback and have no summary, less those whose summary failed a short while ago (shift_id, failed_at)."""
    ended = (F.col("end_time") <= now) & (F.col("end_time") > now - F.expr(f"interval {lookback}")) & F.col("summary").isNull()
    return shifts.where(ended).join(failed.where(F.col("failed_at") > now - F.expr(f"interval {retry}")).select("shift_id").distinct(), "shift_id", "left_anti")


def latest(df: DataFrame, key: str, ts: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(ts))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
