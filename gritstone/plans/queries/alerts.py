"""The alert engine, zones and fatigue factors over telemetry that is made from the event stream.

An event is a minute of its user's machine, a purchase a pause of ten minutes; signals swing with the number of the event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...operators import windows as W
from ...streaming import proximity, rules
from ..registry import events, query

NUMBERED = """nb as (select *, 'm' || user_id as machine_id, row_number() over (partition by user_id order by ts) as n,
  coalesce(count(*) filter (event_type = 'purchase') over (partition by user_id order by ts rows between unbounded preceding and 1 preceding), 0) as pauses from events)"""


def numbered(spark, sf_dir, *columns: str) -> DataFrame:
    """Events with machine_id, n (from 1 by machine) and the pauses before them."""
    w = W.by("user_id")
    before = w.rowsBetween(W.Window.unboundedPreceding, -1)
    df = events(spark, sf_dir, *dict.fromkeys(["user_id", "event_type", *columns]))
    df = rules.dealt(df, ["user_id"], df.count())
    return df.select("*", F.concat(F.lit("m"), F.col("user_id")).alias("machine_id"), F.row_number().over(w).alias("n"), F.coalesce(F.count_if(F.col("event_type") == "purchase").over(before), F.lit(0)).alias("pauses"))


def _telemetry(spark, sf_dir) -> DataFrame:
    df = numbered(spark, sf_dir)
    swing = lambda mean, size, period: F.lit(mean) + F.lit(size) * F.sin(F.col("n") / F.lit(period) + F.col("user_id"))
    us = F.lit(1704067200000000) + F.col("n").cast("long") * 60_000_000 + F.col("pauses") * 600_000_000
    return df.select(
        "machine_id", F.timestamp_micros(us).alias("ts"), F.lit(1800.0).alias("engine_rpm"), F.lit(70.0).alias("engine_load_pct"), swing(100.0, 9.0, 7.0).alias("coolant_temp_c"), swing(92.0, 5.0, 5.0).alias("hydraulic_oil_temp_c"),
        swing(100.0, 30.0, 6.0).alias("oil_pressure_kpa"), swing(24.0, 1.0, 11.0).alias("battery_voltage"), F.lit(240.0).alias("hydraulic_pressure_bar"), F.lit(3.0).alias("ground_speed_kmh"), F.lit(0.0).alias("pitch_deg"), swing(0.0, 27.0, 8.0).alias("roll_deg"),
        (F.col("n") % 20 < 14).alias("seatbelt_fastened"), F.lit(False).alias("is_idle"),
    )


#: What the engine tells of readings rd (w, c: lower and higher level; hw, hc: seconds they must hold; lo, hi: their ranks) and acknowledgements ak.
_ENGINE = """s1 as (select *, (us - lag(us) over k) / 1e6 as dt, lag(w) over k as pw, lag(c) over k as pc from rd window k as (partition by machine_id, rule order by us)),
s2 as (select * exclude (dt), case when dt > 0 and dt <= 120 then dt end as step from s1),
s3 as (select *, max(case when w and not (step is not null and pw) then us end) over k as w0, max(case when c and not (step is not null and pc) then us end) over k as c0 from s2 window k as (partition by machine_id, rule order by us rows unbounded preceding)),
s4 as (select *, case when c and (us - c0) / 1e6 + 60 >= hc then hi when w and (us - w0) / 1e6 + 60 >= hw then lo end as rank from s3),
s5 as (select *, rank is null and clear as q from s4),
s6 as (select *, lag(q) over k as pq, lag(rank) over k as prank from s5 window k as (partition by machine_id, rule order by us)),
s7 as (select *, max(case when q and not (step is not null and pq) then us end) over (partition by machine_id, rule order by us rows unbounded preceding) as q0 from s6),
s8 as (select *, case when rank is not null then 'a' when q and (us - q0) / 1e6 + 60 >= 120 then 'e' end as sign from s7),
s9 as (select *, last_value(sign ignore nulls) over (partition by machine_id, rule order by us rows between unbounded preceding and 1 preceding) as before from s8),
s10 as (select *, sum((sign = 'a' and before is distinct from 'a')::int) over (partition by machine_id, rule order by us rows unbounded preceding) as ep, coalesce(sign = 'a' and before is distinct from 'a', false) as opens, coalesce(sign = 'e' and before = 'a', false) as ends from s9),
e1 as (select *, max(rank) over r as top, sum(case when rank = 2 and prank = 2 then coalesce(step, 0) else 0 end) over r as spent,
  last_value(case when rank is not null then x end ignore nulls) over (partition by machine_id, rule, ep order by us range between 720000000 preceding and 180000000 preceding) as old
  from s10 where rank is not null or ends window r as (partition by machine_id, rule, ep order by us rows unbounded preceding)),
e2 as (select *, rule in ('COOLANT_CRITICAL', 'HYD_OIL_HIGH') and coalesce(x - old >= 3, false) as rising, min(us) filter (rank = 2 and resp = 'graded' and spent >= 120) over z as derate from e1 window z as (partition by machine_id, rule, ep)),
e3 as (select *, min(us) filter (rank = 2 and resp = 'graded' and (spent >= 300 or (us >= derate + 60000000 and rising))) over z as shut from e2 window z as (partition by machine_id, rule, ep)),
ac as (select e.machine_id, e.rule, e.ep, min(k.us) as ack from (select machine_id, rule, ep, min(us) as a, max(us) as b from e3 group by all) e join ak k on k.machine_id = e.machine_id and k.rule = e.rule and k.us > e.a and k.us <= e.b group by all),
e4 as (select e3.*, min(us) filter (rank = 2 and ((resp = 'graded' and (spent >= 420 or (us >= shut + 120000000 and not coalesce(ack <= us, false)))) or (resp = 'escalate' and spent >= 120))) over z as esc, lag(top) over (partition by machine_id, rule, ep order by us) as ptop from e3 left join ac using (machine_id, rule, ep) window z as (partition by machine_id, rule, ep)),
ev as (select machine_id, rule, us, 'open' as reason, top, 'warn' as stage from e4 where opens
  union all select machine_id, rule, us, 'severity', top, case when esc < us then 'escalated' when shut < us then 'recommend_shutdown' when derate < us then 'derate' else 'warn' end from e4 where not opens and top > ptop
  union all select machine_id, rule, us, 'stage', top, 'derate' from e4 where us = derate
  union all select machine_id, rule, us, 'stage', top, 'recommend_shutdown' from e4 where us = shut
  union all select machine_id, rule, us, 'stage', top, 'escalated' from e4 where us = esc
  union all select machine_id, rule, us, 'resolve', top, 'resolved' from e4 where ends)
select machine_id, rule, make_timestamp(us) as ts, reason, ['info', 'warning', 'critical'][top + 1] as severity, stage from ev"""
_NO_ACKS = "ak as (select '' as machine_id, '' as rule, 0 as us where false)"

_ALERTS = f"""with {NUMBERED},
t as (select machine_id, 1704067200000000 + n * 60000000 + pauses * 600000000 as us, 100 + 9 * sin(n / 7.0::double + user_id) as cool, 92 + 5 * sin(n / 5.0::double + user_id) as oil, 100 + 30 * sin(n / 6.0::double + user_id) as press,
  24 + sin(n / 11.0::double + user_id) as volt, abs(27 * sin(n / 8.0::double + user_id)) as tilt, n % 20 < 14 as belt from nb),
rd as (select machine_id, us, 'COOLANT_HIGH' as rule, cool > 100 as w, false as c, cool < 100 * 0.95 as clear, cool as x, 120 as hw, 0 as hc, 'none' as resp, 1 as lo, 2 as hi from t
  union all select machine_id, us, 'COOLANT_CRITICAL', false, cool > 105, cool < 105 * 0.95, cool, 0, 0, 'graded', 1, 2 from t
  union all select machine_id, us, 'HYD_OIL_HIGH', oil > 90, oil > 95, oil < 90 * 0.95, oil, 0, 0, 'graded', 1, 2 from t
  union all select machine_id, us, 'OIL_PRESSURE_LOW', false, press < 100, press > 105, press, 0, 0, 'graded', 1, 2 from t
  union all select machine_id, us, 'BATTERY_LOW', volt < 24, false, volt > 25.2, volt, 300, 0, 'none', 1, 2 from t
  union all select machine_id, us, 'TIP_RISK', tilt > 15, tilt > 25, tilt < 15 * 0.95, tilt, 0, 0, 'escalate', 1, 2 from t
  union all select machine_id, us, 'SEATBELT', not belt, not belt, belt, null, 5, 30, 'escalate', 1, 2 from t), {_NO_ACKS},
{_ENGINE}"""


@query(_ALERTS)
def alert_timeline(spark, sf_dir):
    """What the alert engine tells of seven rules: openings, rises, stages, resolutions."""
    found = rules.readings(_telemetry(spark, sf_dir)).where(F.col("rule").isin("COOLANT_HIGH", "COOLANT_CRITICAL", "HYD_OIL_HIGH", "OIL_PRESSURE_LOW", "BATTERY_LOW", "TIP_RISK", "SEATBELT"))
    return rules.alerts(found)


@query(f"""with {NUMBERED}, codes as (select distinct user_id, 'E-' || (110 + event_id % 4 * 105) as code from events where event_type = 'error'),
t as (select nb.user_id, nb.machine_id, n, 1704067200000000 + n * 60000000 + pauses * 600000000 as us, coalesce(event_type = 'error' and 'E-' || (110 + event_id % 4 * 105) = code, false) as here, code from nb join codes using (user_id)),
s as (select *, us - lag(us) over k as gap, lag(here) over k as ph from t window k as (partition by machine_id, code order by us)),
q as (select *, max(case when not here and not (gap <= 120000000 and not ph) or not here and ph is null then us end) over (partition by machine_id, code order by us rows unbounded preceding) as q0 from s),
g as (select *, case when here then 'a' when (us - q0) / 1e6 + 60 >= 120 then 'e' end as sign from q),
b as (select *, last_value(sign ignore nulls) over (partition by machine_id, code order by us rows between unbounded preceding and 1 preceding) as before from g)
select machine_id, 'FAULT_CODE:' || code as rule, make_timestamp(us) as ts, case when sign = 'a' then 'open' else 'resolve' end as reason, 'warning' as severity, case when sign = 'a' then 'warn' else 'resolved' end as stage
from b where (sign = 'a' and before is distinct from 'a') or (sign = 'e' and before = 'a')""")
def alert_fault_codes(spark, sf_dir):
    """Openings and resolutions of fault codes, one alert a code."""
    df = numbered(spark, sf_dir, "event_id")
    us = F.lit(1704067200000000) + F.col("n").cast("long") * 60_000_000 + F.col("pauses") * 600_000_000
    code = F.when(F.col("event_type") == "error", F.concat(F.lit("E-"), (110 + F.col("event_id") % 4 * 105).cast("string")))
    return rules.alerts(rules.code_readings(df.select("machine_id", F.timestamp_micros(us).alias("ts"), code.alias("fault_code"))))


_ZONES = f"""with recursive {NUMBERED},
d as (select event_id, user_id, n, n * 400000 + pauses * 5000000 as us, 5.5 + 4 * sin(n / 4.0::double + user_id) as d, event_type = 'click' as near, case when n % 50 >= 35 then 2.0 else 0.0 end as wider from nb),
r as (select *, sum((gap is null or gap > 2000000)::int) over (partition by user_id order by us rows unbounded preceding) as life from (select *, us - lag(us) over (partition by user_id order by us) as gap from d)),
z as (select *, coalesce(last_value(case when d < 3 + wider then true when d >= 3.3 + wider then false end ignore nulls) over k, false) as red, coalesce(last_value(case when d <= 7 + wider then true when d > 7.3 + wider then false end ignore nulls) over k, false) as orange from r window k as (partition by user_id, life order by us rows unbounded preceding)),
l as (select *, case when red then 'red' when orange then 'orange' else 'clear' end as zone, case when red then 2 when orange then least(1 + near::int, 2) end as level from z),
f as (select *, zone <> 'clear' and (zone <> lag(zone, 1, 'clear') over k or level > coalesce(lag(level) over k, -1)) as sure from l window k as (partition by user_id, life order by us)),
p as (select user_id, n, sure as post, case when sure then us end as last from f where n = 1
  union all select f.user_id, f.n, f.sure or (f.zone = 'red' and (p.last is null or f.us - p.last >= 2000000)), case when f.sure or (f.zone = 'red' and (p.last is null or f.us - p.last >= 2000000)) then f.us else p.last end from p join f on f.user_id = p.user_id and f.n = p.n + 1)
select event_id, f.user_id, zone, case level when 1 then 'warning' when 2 then 'critical' end as severity, post from f join p on f.user_id = p.user_id and f.n = p.n"""


@query(_ZONES)
def zone_posts(spark, sf_dir):
    """Zones of approaching objects, their severities, and which detections are posted."""
    df = numbered(spark, sf_dir, "event_id")
    us = F.col("n").cast("long") * 400_000 + F.col("pauses") * 5_000_000
    distance = 5.5 + 4 * F.sin(F.col("n") / 4.0 + F.col("user_id"))
    seen = df.select("event_id", "user_id", us.alias("us"), distance.alias("distance_m"), (F.col("event_type") == "click").alias("approaching"), (F.col("n") % 50 >= 35).alias("wide"))
    return proximity.zones(seen, "user_id").select("event_id", "user_id", "zone", "severity", "post")


_CLOSING = """dd as (select event_id, user_id, n, n * 400000 + pauses * 5000000 as us, 5.5 + 4 * sin(n / 4.0::double + user_id) as d, case when n % 50 >= 35 then 2.0 else 0.0 end as wider from nb),
dl as (select *, coalesce(last_value(us) over b, first_value(us) over i) as old_us, coalesce(last_value(d) over b, first_value(d) over i) as old_d from dd
  window b as (partition by user_id order by us range between unbounded preceding and 1000000 preceding), i as (partition by user_id order by us range between 999999 preceding and current row)),
ds as (select *, case when us - old_us >= 700000 then (old_d - d) * 1e6 / (us - old_us) end as speed from dl),
d as (select *, coalesce(speed > 0.5, false) as near from ds),
"""


@query(f"with {NUMBERED},\n{_CLOSING}" + _ZONES[_ZONES.index("r as (select") : _ZONES.index("f as (select")].rstrip().rstrip(",") + """
select event_id, user_id, speed as closing_mps, near as approaching, zone, case level when 1 then 'warning' when 2 then 'critical' end as severity from l""")
def closing_zones(spark, sf_dir):
    """How fast each object has come nearer over the last second, whether it approaches, and the zone and severity that follow."""
    df = numbered(spark, sf_dir, "event_id")
    us = F.col("n").cast("long") * 400_000 + F.col("pauses") * 5_000_000
    seen = df.select("event_id", "user_id", us.alias("us"), (5.5 + 4 * F.sin(F.col("n") / 4.0 + F.col("user_id"))).alias("distance_m"), (F.col("n") % 50 >= 35).alias("wide"))
    return proximity.zones(proximity.closing(seen, "user_id"), "user_id").select("event_id", "user_id", "closing_mps", "approaching", "zone", "severity")


@query("""with p as (select *, avg((value < 25)::int::double) over (partition by user_id order by ts range between interval '172799999999 microseconds' preceding and current row) as perclos from events)
select event_id, user_id, perclos, 0.45 * least(perclos / 0.3, 1.0) + 0.15 * least((event_id % 4) / 3.0, 1.0) + 0.15 * least((event_id % 5) / 3.0, 1.0) + 0.15 * least(greatest((event_id % 13) - 1, 0) / 10.0, 1.0) + 0.10 * (hour(ts) >= 22 or hour(ts) < 6)::int as score from p""")
def fatigue_scores(spark, sf_dir):
    """Closed-eye share over two days and the fatigue score from it."""
    df = proximity.closed_share(events(spark, sf_dir, "event_id", "user_id", "value").withColumnRenamed("value", "ear"), "user_id", 25, 2 * W.DAY)
    n = lambda k: (F.col("event_id") % k).cast("double")
    night = (F.hour("ts") >= 22) | (F.hour("ts") < 6)
    return df.select("event_id", "user_id", "perclos", proximity.fatigue_score(F.col("perclos"), n(4), n(5), n(13) - 1, night).alias("score"))


def _odd_telemetry(spark, sf_dir) -> DataFrame:
    """Minutes with missing signals, drops of pressure, idling and speeding, from the events' kinds and numbers."""
    df = numbered(spark, sf_dir, "event_id", "value")
    us = F.lit(1704067200000000) + F.col("n").cast("long") * 60_000_000 + F.col("pauses") * 600_000_000
    unless = lambda cond, x: F.when(~F.expr(cond), x)
    return df.select(
        "machine_id", F.timestamp_micros(us).alias("ts"), unless("event_id % 41 = 0", F.lit(1250.0) + F.col("n") % 7 * 10).alias("engine_rpm"), unless("event_id % 97 = 0", F.lit(70.0)).alias("engine_load_pct"), F.lit(None).cast("double").alias("coolant_temp_c"), F.lit(None).cast("double").alias("hydraulic_oil_temp_c"),
        F.lit(None).cast("double").alias("oil_pressure_kpa"), F.lit(None).cast("double").alias("battery_voltage"), unless("event_type = 'signup'", F.when(F.expr("n % 60 < 40"), 240.0).otherwise(120.0) + F.col("event_id") % 16).alias("hydraulic_pressure_bar"),
        unless("event_type = 'error'", F.when(F.expr("n % 90 < 70"), 0.5).otherwise(4.5 + F.col("event_id") % 4)).alias("ground_speed_kmh"), F.lit(None).cast("double").alias("pitch_deg"), F.lit(None).cast("double").alias("roll_deg"), F.lit(None).cast("boolean").alias("seatbelt_fastened"),
        unless("event_id % 53 = 0", F.expr("n % 70 < 45")).alias("is_idle"), F.when(F.expr("user_id % 3 <> 0"), "excavator").alias("machine_type"),
    )


@query(f"""with recursive {NUMBERED},
t as (select user_id, machine_id, n, 1704067200000000 + n * 60000000 + pauses * 600000000 as us, case when event_id % 41 <> 0 then 1250.0::double + n % 7 * 10 end as rpm, case when event_id % 97 <> 0 then 70.0::double end as ld, case when event_type <> 'signup' then (case when n % 60 < 40 then 240 else 120 end + event_id % 16)::double end as p,
  case when event_type <> 'error' then case when n % 90 < 70 then 0.5 else 4.5 + event_id % 4 end end::double as v, case when event_id % 53 <> 0 then n % 70 < 45 end as idle, case when user_id % 3 <> 0 then 5.5 end as lim from nb),
a as (select *, avg(p) over (partition by machine_id order by us range between 119999999 preceding and current row) as recent, avg(p) over (partition by machine_id order by us range between 359999999 preceding and 180000000 preceding) as base, avg(v) over (partition by machine_id order by us range between 179999999 preceding and current row) as still,
  min(coalesce(ld, 0)) over m > 40 and us - min(us) over m >= 300000000 as loaded, coalesce(idle, false) and rpm is not null as i from t window m as (partition by machine_id order by us range between 359999999 preceding and current row)),
f as (select *, coalesce(base > 100 and recent < 0.65 * base and loaded and still < 2, false) as found, i and not coalesce(us - lag(us) over k <= 120000000 and lag(i) over k, false) as begins from a window k as (partition by machine_id order by us)),
h as (select *, max(case when begins then us end) over (partition by machine_id order by us rows unbounded preceding) as since from f),
j as (select *, case when i then avg(case when i then rpm end) over (partition by machine_id, since order by us rows unbounded preceding) end as mean, case when i then (us - since) / 1e6 + 60 end as run from h),
l as (select user_id, n, case when found then base end as was, case when found and not recent >= 0.65 * (1 + 0.05) * base then base end as held from f where n = 1
  union all select f.user_id, f.n, case when l.held is not null then l.held when found then base end, case when l.held is null and not found then null when recent >= 0.65 * (1 + 0.05) * coalesce(l.held, base) then null else coalesce(l.held, base) end from l join f on f.user_id = l.user_id and f.n = l.n + 1),
rd as (select machine_id, us, 'HYD_PRESSURE_DROP' as rule, false as w, coalesce(recent < 0.65 * was, false) as c, was is null or coalesce(recent >= 0.65 * (1 + 0.05) * was, false) as clear, recent as x, 0 as hw, 0 as hc, 'graded' as resp, 1 as lo, 2 as hi from f join l using (user_id, n)
  union all select machine_id, us, 'EXCESS_IDLE', coalesce(mean > 1200 and run > 600, false), coalesce(mean > 1200 and run > 1200, false), not i or coalesce(mean < 1200 * 0.95, false), run, 0, 0, 'none', 0, 1 from j
  union all select machine_id, us, 'OVERSPEED', coalesce(v > lim, false), false, v is null or lim is null or v < lim * 0.95, v, 0, 0, 'none', 1, 2 from t), {_NO_ACKS},
{_ENGINE}""")
def alert_look_back(spark, sf_dir):
    """Pressure drops, idling and speeding of machines with missing signals."""
    found = rules.readings(_odd_telemetry(spark, sf_dir)).where(F.col("rule").isin("HYD_PRESSURE_DROP", "EXCESS_IDLE", "OVERSPEED"))
    return rules.alerts(found)


@query(f"""with {NUMBERED},
t as (select *, 1704067200000000 + n * 60000000 + pauses * 600000000 as us, case when event_type <> 'signup' then 104 + 6 * sin(n / 9.0::double + user_id) end as cool from nb),
rd as (select machine_id, us, 'COOLANT_CRITICAL' as rule, false as w, coalesce(cool > 105, false) as c, coalesce(cool < 105 * 0.95, false) as clear, cool as x, 0 as hw, 0 as hc, 'graded' as resp, 1 as lo, 2 as hi from t),
ak as (select machine_id, 'COOLANT_CRITICAL' as rule, us from t where event_type = 'view'),
{_ENGINE}""")
def alert_acknowledged(spark, sf_dir):
    """Graded alerts whose views acknowledge them; views at the opening count nothing. Missing temperatures are neither hot nor calm."""
    df = numbered(spark, sf_dir)
    us = F.lit(1704067200000000) + F.col("n").cast("long") * 60_000_000 + F.col("pauses") * 600_000_000
    signals = _telemetry(spark, sf_dir).select("machine_id", "ts", *(c for c in _telemetry(spark, sf_dir).columns if c not in ("machine_id", "ts", "coolant_temp_c")))
    seen = df.select("machine_id", F.timestamp_micros(us).alias("ts"), "event_type", F.when(F.col("event_type") != "signup", 104 + 6 * F.sin(F.col("n") / 9.0 + F.col("user_id"))).alias("coolant_temp_c"))
    found = rules.readings(signals.join(seen.drop("event_type"), ["machine_id", "ts"])).where("rule = 'COOLANT_CRITICAL'")
    acks = seen.where("event_type = 'view'").select("machine_id", "ts", F.lit("COOLANT_CRITICAL").alias("rule"))
    return rules.alerts(found.unionByName(rules.acknowledgements(acks)), chunk=7 * W.DAY)


@query(f"""with {NUMBERED},
t as (select machine_id, 1704067200000000 + n * 60000000 + pauses * 600000000 as us, case when event_type = 'error' then 'machine_fault' when event_type = 'purchase' then 'sensor_glitch' when event_type = 'click' then 'normal' end as kind, value from nb),
rd as (select machine_id, us, 'UNUSUAL_BEHAVIOUR' as rule, coalesce(kind = 'machine_fault', false) as w, false as c, not coalesce(kind = 'machine_fault', false) as clear, value as x, 0 as hw, 0 as hc, 'none' as resp, 1 as lo, 2 as hi from t
  union all select machine_id, us, 'SENSOR_GLITCH', coalesce(kind = 'sensor_glitch', false), false, not coalesce(kind = 'sensor_glitch', false), value, 0, 0, 'none', 0, 2 from t), {_NO_ACKS},
{_ENGINE}""")
def alert_verdicts(spark, sf_dir):
    """What a model's verdicts open and close."""
    df = numbered(spark, sf_dir, "value")
    us = F.lit(1704067200000000) + F.col("n").cast("long") * 60_000_000 + F.col("pauses") * 600_000_000
    kind = F.when(F.col("event_type") == "error", "machine_fault").when(F.col("event_type") == "purchase", "sensor_glitch").when(F.col("event_type") == "click", "normal")
    return rules.alerts(rules.verdict_readings(df.select("machine_id", F.timestamp_micros(us).alias("ts"), kind.alias("kind"), F.col("value").alias("score"))))
