"""Features of tasks at their planned start, and baselines of their duration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates, asof, boosting
from ..operators import windows as W
from .maintenance import shift_engine_hours

WEATHER = ["temp_c", "rain_mm", "wind_kmh", "visibility_m", "dust_index"]
LOOKBACK_DAYS = 30


def work() -> Column:
    """Amount of work: quantity, for hauls times the distance in km."""
    return F.when(F.col("task_type") == "haul", F.col("quantity") * F.col("haul_distance_m") / 1000).otherwise(F.col("quantity"))


def baseline(tasks: DataFrame, amount: Column, name: str) -> DataFrame:
    """Median minutes for a unit of work, by task type, of the given tasks alone."""
    per = F.col("actual_duration_min") / F.nullif(amount, F.lit(0.0))
    return tasks.where(F.col("actual_duration_min").isNotNull()).groupBy("task_type").agg(F.median(per).alias(name))


def time_ratio(tasks: DataFrame, history: DataFrame, reference: DataFrame) -> DataFrame:
    """tasks with operator_avg_time_ratio: actual over reference minutes of the operator's tasks of that type that ended in the month before.

    reference: task_type, per_unit (`baseline` with `work`).
    """
    h = history.where(F.col("actual_end").isNotNull() & F.col("actual_duration_min").isNotNull()).join(F.broadcast(reference), "task_type")  # a row a task type
    key = F.concat_ws("\u0001", "operator_id", "task_type")
    h = h.select(key.alias("_key"), "actual_end", (F.col("actual_duration_min") / (F.col("per_unit") * work())).alias("_ratio")).where("_ratio is not null")
    return W.lookback_mean(tasks.withColumn("_key", key), h, "_key", "scheduled_start", "actual_end", "_ratio", LOOKBACK_DAYS * W.DAY, "operator_avg_time_ratio").drop("_key")


def shift_health(shifts: DataFrame, machines: DataFrame, log: DataFrame) -> DataFrame:
    """shift_id and health_score at its start: it falls with the hours since service, from 1 to 0.3 at least."""
    hours = shift_engine_hours(shifts, machines, log)
    services = log.where("event_type = 'scheduled_service'").select("machine_id", F.col("event_date").alias("_at"), F.col("engine_hours_at_event").alias("_eh"))
    got = asof.asof_join(hours, services, "machine_id", "start_time", "_at", ["_eh"]).join(machines.select("machine_id", "service_interval_hours"), "machine_id", "left")
    since = F.greatest(F.col("eh_start") - F.col("_eh"), F.lit(0.0))
    score = F.least(F.greatest(1 - 0.2 * since / F.col("service_interval_hours"), F.lit(0.3)), F.lit(1.0))
    return got.select("shift_id", F.when(F.col("_eh").isNotNull(), score).alias("health_score"))


def fatigue_by_hour(log: DataFrame, shifts: DataFrame) -> DataFrame:
    """shift_id, hour_of_shift and the operator's mean fatigue at that hour in earlier shifts."""
    f = log.select("ts", "operator_id", "shift_id", "fatigue_score").join(shifts.select("shift_id", "start_time"), "shift_id")
    hour = F.floor((F.unix_micros("ts") - F.unix_micros("start_time")) / 3.6e9).cast("int")
    per = f.groupBy("operator_id", "shift_id", "start_time", hour.alias("hour_of_shift")).agg(F.sum("fatigue_score").alias("_s"), F.count("fatigue_score").alias("_n"))
    mean = W.prior_mean(F.col("_s"), F.col("_n"), W.by(["operator_id", "hour_of_shift"], "start_time"))
    return per.select("shift_id", "hour_of_shift", mean.alias("operator_fatigue_hour_avg"))


def features(tasks: DataFrame, weather: DataFrame, operators: DataFrame, machines: DataFrame, shifts: DataFrame, fatigue: DataFrame, log: DataFrame, reference: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row a task with what is known before it begins."""
    t = asof.asof_join(tasks, weather.select("site_id", F.col("ts").alias("_w"), *WEATHER), "site_id", "scheduled_start", "_w", WEATHER)
    t = t.join(operators.select("operator_id", "skill_score", "experience_years", "certification_level"), "operator_id", "left")
    t = t.join(machines.select("machine_id", "machine_type"), "machine_id", "left").join(shifts.select("shift_id", "shift_type", F.col("start_time").alias("_start")), "shift_id", "left")
    into = (F.unix_micros("scheduled_start") - F.unix_micros("_start")) / 3.6e9
    t = t.withColumns({"hours_into_shift": into, "day_of_week": F.weekday("task_date")}).withColumn("hour_of_shift", F.greatest(F.col("hours_into_shift"), F.lit(0.0)).cast("int"))
    t = t.join(shift_health(shifts, machines, log), "shift_id", "left").join(fatigue_by_hour(fatigue, shifts), ["shift_id", "hour_of_shift"], "left")
    done = (history if history is not None else tasks).where("status = 'completed'")
    return time_ratio(t, done, reference).drop("_start", "hour_of_shift")


def calibrate(low: Column, middle: Column, high: Column, offset: float) -> Column:
    """Three quantiles in order, the outer ones moved apart by an offset (a share of the middle)."""
    q = F.array_sort(F.array(low, middle, high))
    return F.struct((q[0] - offset * q[1]).alias("p10"), q[1].alias("p50"), (q[2] + offset * q[1]).alias("p90"))


def conformal_offset(df: DataFrame, actual: str, low: str, middle: str, high: str, share: float) -> DataFrame:
    """One row: the offset that makes the interval hold the given share of actual values."""
    miss = df.select((F.greatest(F.col(low) - F.col(actual), F.col(actual) - F.col(high)) / F.col(middle)).alias("miss"))
    return aggregates.at_rank(miss, [], "miss", F.least(F.ceil((F.col("n") + 1) * share), F.col("n")), "offset")


#: Percents of the forecast, and features that are a task's size and so no reason to be early or late.
PERCENTS, NO_FACTOR = [10, 50, 90], {"quantity", "unit"}


def fit_forecast(tasks: DataFrame, minutes: str, features: list[str], at: list[list[float]] | None = None, **size: int) -> DataFrame:
    """Nodes of three quantile models of log1p(minutes); `at` and `size` as in `boosting.fit`. Tasks without minutes, or with negative ones, aren't learned from."""
    known = tasks.select(*features, F.when(F.col(minutes) >= 0, F.log1p(minutes)).alias("_y"))
    return boosting.fit(known, "_y", features, at or boosting.cuts(known, features), PERCENTS, **size)


def quantiles(tasks: DataFrame, nodes: DataFrame, features: list[str]) -> DataFrame:
    """Adds _q: the three quantiles of log1p(minutes) in rising order."""
    return boosting.predict(tasks, nodes, features, PERCENTS, "_q").withColumn("_q", F.array_sort("_q"))


def widening(tasks: DataFrame, nodes: DataFrame, features: list[str], minutes: str, share: float = 0.8) -> DataFrame:
    """One row: the offset, in log1p space, that makes p10 to p90 hold a share of tasks that weren't learned from; 0 where the models are careful enough, or without tasks."""
    y = F.log1p(minutes)
    miss = quantiles(tasks.where(F.col(minutes) >= 0), nodes, features).select(F.greatest(F.col("_q")[0] - y, y - F.col("_q")[2]).alias("miss"))
    return aggregates.at_rank(miss, [], "miss", F.least(F.ceil((F.col("n") + 1) * share), F.col("n")), "offset").select(F.greatest("offset", F.lit(0.0)).alias("offset"))


def forecast(tasks: DataFrame, nodes: DataFrame, features: list[str], offset: float, k: int = 3) -> DataFrame:
    """Adds p10_min, p50_min and p90_min, the outer ones moved apart by the offset, and factors: the k features that move p50 most, in minutes.

    Features may be NULL or NaN, which goes below every cut; a task always gets a forecast.
    """
    q = boosting.contributions(quantiles(tasks, nodes, features), nodes, features, 50, "_parts", "_base")
    q = q.withColumns({"p10_min": F.expm1(F.col("_q")[0] - offset), "p50_min": F.expm1(F.col("_q")[1]), "p90_min": F.expm1(F.col("_q")[2] + offset)})
    parts = {c: F.col("_parts")[i] for i, c in enumerate(features) if c not in NO_FACTOR}
    return q.withColumn("factors", top_factors(F.col("p50_min"), parts, k)).drop("_q", "_parts", "_base")


def factor_minutes(p50: Column, contributions: Column) -> Column:
    """Minutes of each factor, from an array of its contributions in log1p space: p50 less what it would be without the factor."""
    return F.transform(contributions, lambda c: p50 - F.expm1(F.log1p(p50) - c))


def top_factors(p50: Column, contributions: dict[str, Column], k: int) -> Column:
    """The k factors of the largest absolute minutes, as an array of feature and impact_min (to a tenth); ties by feature."""
    each = F.array(*(F.struct((-F.abs(p50 - F.expm1(F.log1p(p50) - c))).alias("by"), F.lit(n).alias("feature"), F.bround(p50 - F.expm1(F.log1p(p50) - c), 1).alias("impact_min")) for n, c in contributions.items()))
    return F.transform(F.slice(F.array_sort(each), 1, k), lambda x: F.struct(x["feature"].alias("feature"), x["impact_min"].alias("impact_min")))
