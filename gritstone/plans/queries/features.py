"""Minute features of telemetry, and component scores, over signals that are made from the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...operators import windows as W
from .. import anomaly, maintenance, task_time
from ..registry import events, query
from .alerts import NUMBERED, numbered


@query(f"""with {NUMBERED}, t as (select machine_id, user_id, n, 1704067200000000 + n * 60000000 + pauses * 600000000 as us, 88 + 9 * sin(n / 7.0::double + user_id) as cool, case when n % 17 = 0 then 9.9 else 1 + 0.5 * sin(n / 3.0::double + user_id) end as raw, (3 + n % 5)::double as speed, n % 40 < 10 as idle from nb),
g as (select *, us - lag(us) over k as gap, lag(raw) over k as praw, lag(idle) over k as pidle, (us - min(us) over (partition by machine_id)) / 6e7 as m from t window k as (partition by machine_id order by us)),
v as (select *, coalesce(n % 17 = 0 and gap <= 120000000, false) as odd, case when n % 17 = 0 and gap <= 120000000 then praw else raw end as vib, sum((gap is null or gap > 120000000 or pidle <> idle)::int) over (partition by machine_id order by us rows unbounded preceding) as run from g)
select machine_id, make_timestamp(us) as ts, case when idle then 'idle' else 'working' end as state, (us - min(us) over (partition by machine_id, run)) / 6e7 as state_age_min, case when odd then 'vibration_rms_g' end as glitch,
  avg(vib) over a as vibration_rms_g_mean5, stddev_pop(vib) over a as vibration_rms_g_std5, avg(speed) over a as ground_speed_kmh_mean5,
  coalesce(case when count(m) over b * sum(m * m) over b - sum(m) over b * sum(m) over b > 1e-9 then (count(m) over b * sum(m * cool) over b - sum(m) over b * sum(cool) over b) / (count(m) over b * sum(m * m) over b - sum(m) over b * sum(m) over b) end, 0) as coolant_temp_c_slope15,
  100 * avg(idle::int) over c as idle_pct30, 1800 / 71.0::double as rpm_per_load
from v window a as (partition by machine_id order by us range between 299999999 preceding and current row), b as (partition by machine_id order by us range between 899999999 preceding and current row), c as (partition by machine_id order by us range between 1799999999 preceding and current row)""")
def minute_features(spark, sf_dir):
    """What the detector sees of a minute: means, deviations, slopes, state and its age, the signal that glitched."""
    df = numbered(spark, sf_dir).drop("us")
    us = F.lit(1704067200000000) + F.col("n").cast("long") * 60_000_000 + F.col("pauses") * 600_000_000
    swing = lambda mean, size, period: F.lit(mean) + F.lit(size) * F.sin(F.col("n") / F.lit(period) + F.col("user_id"))
    fixed = {"engine_rpm": 1800.0, "engine_load_pct": 70.0, "oil_pressure_kpa": 200.0, "hydraulic_pressure_bar": 240.0, "hydraulic_oil_temp_c": 60.0, "fuel_rate_lph": 20.0, "battery_voltage": 26.0, "pitch_deg": 1.0, "roll_deg": 1.0}
    telemetry = df.select("machine_id", F.timestamp_micros(us).alias("ts"), (F.col("n") % 40 < 10).alias("is_idle"), swing(88.0, 9.0, 7.0).alias("coolant_temp_c"), F.when(F.col("n") % 17 == 0, 9.9).otherwise(swing(1.0, 0.5, 3.0)).alias("vibration_rms_g"), (3 + F.col("n") % 5).cast("double").alias("ground_speed_kmh"), *(F.lit(x).alias(c) for c, x in fixed.items()))
    got = anomaly.features(telemetry)
    return got.select("machine_id", "ts", "state", "state_age_min", "glitch", "vibration_rms_g_mean5", "vibration_rms_g_std5", "ground_speed_kmh_mean5", "coolant_temp_c_slope15", "idle_pct30", "rpm_per_load")


_PARTS = {f"{s}_{k}": (i, j, sign) for i, (s, sign) in enumerate(maintenance.SIGNALS.items(), 1) for j, k in enumerate(("slope72", "dev24"), 1)}
_MOVE = {s: f"greatest(z_{s}_dev24, z_{s}_slope72)" for s in maintenance.SIGNALS}
_MOVE["vibration_travel_g"] += f" - greatest({_MOVE['vibration_rms_g']}, 0)"
_SCORE = {c: f"greatest({', '.join(_MOVE[s] for s in own)})" for c, own in maintenance.COMPONENTS.items()}


@query("with f as (select event_id, user_id % 3 as t, value, " + ", ".join(f"sin(event_id * {i} + {j}) as {c}" for c, (i, j, _) in _PARTS.items()) + " from events), k as (select t, " + ", ".join(f"avg({c}) as m_{c}, stddev_samp({c}) as s_{c}" for c in _PARTS) + " from f group by 1), "
       + "z as (select event_id, value, " + ", ".join(f"{sign} * ({c} - m_{c}) / s_{c} as z_{c}" for c, (_, _, sign) in _PARTS.items()) + " from f join k using (t)), s as (select *, " + ", ".join(f"{x} as score_{c}" for c, x in _SCORE.items()) + ", "
       + f"greatest({', '.join(f'z_{s}_dev24' for s in maintenance.SIGNALS)}) as worst_dev_z24, greatest({', '.join(f'z_{s}_slope72' for s in maintenance.SIGNALS if s != 'vibration_travel_g')}) as worst_trend_z72 from z), "
       + "b as (select *, case when event_id % 10 >= 8 then greatest(least(greatest(worst_trend_z72 / 6, 0), 1), 0.5) else least(greatest(worst_trend_z72 / 6, 0), 1) end as p_baseline, greatest(value / 500, case when worst_dev_z24 >= 6 then 0.35 else 0 end) as p from s) "
       + "select event_id, " + ", ".join(f"score_{c}" for c in _SCORE) + ", case " + " ".join(f"when score_{c} = greatest({', '.join(f'score_{x}' for x in _SCORE)}) then '{c}'" for c in _SCORE) + " end as likely_component, worst_dev_z24, worst_trend_z72, p_baseline, p, case when p >= 0.6 then 'high' when p >= 0.3 then 'medium' else 'low' end as risk_band from b")
def component_scores(spark, sf_dir):
    """Scores of components from trends and deviations, the likely one, the baseline's probability and the risk band."""
    df = events(spark, sf_dir, "event_id", "user_id", "value")
    parts = {c: F.sin(F.col("event_id") * i + j) for c, (i, j, _) in _PARTS.items()}
    rows = df.select("event_id", F.concat(F.lit("t"), F.col("user_id") % 3).alias("machine_type"), (F.col("value") / 500).alias("p"), (F.col("event_id") % 10 / 8).alias("service_ratio"), *(x.alias(c) for c, x in parts.items()))
    scored = maintenance.apply_floor(maintenance.baseline_probability(maintenance.add_scores(rows, maintenance.fit_scales(rows))), "p")
    return scored.select("event_id", *(f"score_{c}" for c in maintenance.COMPONENTS), "likely_component", "worst_dev_z24", "worst_trend_z72", "p_baseline", "p", "risk_band")


_SHIFTS = """with s as (select user_id, event_id as shift_id, ts as start_time, least(ts + interval '2 days', coalesce(lead(ts) over (partition by user_id order by ts), timestamp '9999-01-01')) as end_time from events where event_type = 'signup'),
c as (select s.*, coalesce(min(e.ts), any_value(end_time)) as stop from s left join events e on e.user_id = s.user_id and e.event_type = 'error' and e.ts >= start_time and e.ts < end_time group by all),
h as (select *, (epoch_us(stop) - epoch_us(start_time)) / 3.6e9 as hours from c), t as (select *, 1000 + user_id - sum(hours) over (partition by user_id order by start_time desc rows unbounded preceding) as eh_start from h)"""


def _shifts(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shifts from signups, machines by user, and a log in which errors are failures and purchases services."""
    df = events(spark, sf_dir, "event_id", "user_id", "event_type").withColumn("machine_id", F.col("user_id"))
    end = F.least(F.col("ts") + F.expr("interval 2 days"), F.coalesce(F.lead("ts").over(W.by("user_id")), F.lit("9999-01-01").cast("timestamp")))
    shifts = df.where("event_type = 'signup'").select(F.col("event_id").alias("shift_id"), "machine_id", F.col("ts").alias("start_time"), end.alias("end_time"))
    kind = F.when(F.col("event_type") == "error", "failure").otherwise("scheduled_service")
    log = df.where("event_type in ('error', 'purchase')").select("machine_id", kind.alias("event_type"), F.col("ts").alias("event_date"), F.lit("engine").alias("component"), (900.0 + F.col("event_id") % 100).alias("engine_hours_at_event"))
    machines = df.select("machine_id").distinct().select("machine_id", (1000.0 + F.col("machine_id")).alias("total_engine_hours"), (100.0 + F.col("machine_id") % 3 * 50).alias("service_interval_hours"))
    return shifts, machines, log


@query(_SHIFTS + """
select shift_id, eh_start, eh_start + hours as eh_end from t""")
def shift_hours(spark, sf_dir):
    """Engine hours at the start and end of shifts, counted back from the machine's total."""
    return maintenance.shift_engine_hours(*_shifts(spark, sf_dir)).select("shift_id", "eh_start", "eh_end")


@query(_SHIFTS + """,
v as (select user_id, ts as at, event_id from events where event_type = 'purchase')
select shift_id, case when v.event_id is not null then least(greatest(1 - 0.2::double * greatest(eh_start - (900 + v.event_id % 100), 0) / (100 + t.user_id % 3 * 50), 0.3), 1) end as health_score from t asof left join v on t.user_id = v.user_id and t.start_time >= v.at""")
def shift_start_health(spark, sf_dir):
    """A machine's health at the start of each shift, by the engine hours since its last service; none without a service."""
    return task_time.shift_health(*_shifts(spark, sf_dir))


@query(f"""with {NUMBERED}, h as (select *, n + pauses as bin, n + pauses + 0.5::double as eh, 30 + n % 31 as n_min, case when n % 9 <> 0 then 88 + 9 * sin(n / 7.0::double + user_id) end as x from nb),
t as (select *, (bin - min(bin) over (partition by user_id))::double as t, last_value(case when event_type = 'error' then eh end ignore nulls) over (partition by user_id order by bin rows unbounded preceding) as service from h),
f as (select *, sum(x * n_min) over a / sum(case when x is not null then n_min end) over a as mean24, case when sum(case when x is not null then n_min end) over p >= 60 then sum(x * n_min) over p / sum(case when x is not null then n_min end) over p end as base,
  count(x) over b as k, sum(case when x is not null then t end) over b as st, sum(case when x is not null then t * t end) over b as stt, sum(t * x) over b as stx, sum(x) over b as sx, sum((n % 7 = 0)::int) over a as anomaly_count24, sum((n % 11 = 0)::int) over d as fault_code_count7d,
  sum(n % 60) over (partition by user_id, service order by bin rows unbounded preceding) / 60 as high_load_hours_since_service
  from t window a as (partition by user_id order by bin range between 23 preceding and current row), b as (partition by user_id order by bin range between 71 preceding and current row), p as (partition by user_id order by bin range between 335 preceding and 72 preceding), d as (partition by user_id order by bin range between 167 preceding and current row))
select event_id, mean24 as coolant_temp_c_mean24, case when k >= 3 and k * stt - st * st > 1e-9 then (k * stx - st * sx) / (k * stt - st * st) end as coolant_temp_c_slope72, mean24 - base as coolant_temp_c_dev24, anomaly_count24::bigint as anomaly_count24, fault_code_count7d::bigint as fault_code_count7d,
  case when service is not null then greatest(eh - service, 0) end as hours_since_service, case when service is not null then greatest(eh - service, 0) end / 250 as service_ratio, high_load_hours_since_service, date_diff('day', date '2020-01-01', (timestamp '2024-01-01' + to_hours(bin::bigint))::date) / 365.25::double as age_years from f""")
def hourly_features(spark, sf_dir):
    """Trailing means, slopes, deviations and counts by engine hour, and what has run since the last service (error)."""
    df = numbered(spark, sf_dir, "event_id").drop("us")
    n, bin_ = F.col("n"), (F.col("n") + F.col("pauses")).cast("long")
    ts = F.timestamp_micros(F.lit(1704067200000000) + bin_ * 3_600_000_000)
    x = F.when(n % 9 != 0, 88 + 9 * F.sin(n / 7.0 + F.col("user_id")))
    none = F.lit(None).cast("double")
    hours = df.select("event_id", "machine_id", "event_type", bin_.alias("bin"), ts.alias("ts"), (bin_ + 0.5).alias("engine_h"), (30 + n % 31).alias("n_min"), x.alias("coolant_temp_c"), *(none.alias(s) for s in maintenance.SIGNALS if s != "coolant_temp_c"), (n % 5).cast("double").alias("anomaly_score_sum"), (n % 7 == 0).cast("int").alias("anomaly_count"), (n % 11 == 0).cast("int").alias("fault_code_count"), (n % 60).alias("high_load_min"))
    log = hours.where("event_type = 'error'").select("machine_id", F.lit("scheduled_service").alias("event_type"), F.col("ts").alias("event_date"), F.col("engine_h").alias("engine_hours_at_event"))
    machines = df.select("machine_id").distinct().select("machine_id", F.lit("dozer").alias("machine_type"), F.lit(250.0).alias("service_interval_hours"), F.lit(2020).alias("year"))
    got = maintenance.hourly_features(hours.drop("event_type"), machines, log)
    return got.select("event_id", "coolant_temp_c_mean24", "coolant_temp_c_slope72", "coolant_temp_c_dev24", "anomaly_count24", "fault_code_count7d", "hours_since_service", "service_ratio", "high_load_hours_since_service", "age_years")
