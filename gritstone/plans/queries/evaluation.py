"""Detectors by events and failures, folds, and what is left to do after a restart."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ...operators import evaluation as E
from ...operators import windows as W
from ...streaming import proximity, sessions
from .. import maintenance, recommend
from ..registry import events, query
from .alerts import NUMBERED, numbered
from .analytics import LABELS, labelled


@query("""with v as (select event_id, user_id, event_id % 3 as kind, ts as s, ts + interval '6 hours' as e from events where event_type = 'error'), a as (select user_id, ts from events where event_type <> 'error' and value > 20),
f as (select v.event_id, kind, s, e, min(a.ts) as t from v left join a on a.user_id = v.user_id and a.ts >= v.s group by all),
h as (select kind, coalesce(t < e + interval '12 hours', false) as hit, case when t < e + interval '12 hours' then (epoch_us(t) - epoch_us(s)) / 6e7 end as delay from f)
select kind, count(*) as events, avg(hit::int) as event_recall, median(delay) as median_delay_min from h group by 1""")
def event_recall(spark, sf_dir):
    """Share of errors that a high value follows within a tail, and how late, by kind."""
    df = events(spark, sf_dir, "event_id", "user_id", "event_type", "value")
    found = df.where("event_type = 'error'").select("user_id", (F.col("event_id") % 3).alias("kind"), F.col("ts").alias("start_ts"), (F.col("ts") + F.expr("interval 6 hours")).alias("end_ts"))
    minutes = df.select("user_id", "ts", ((F.col("event_type") != "error") & (F.col("value") > 20)).alias("alert"))
    return E.event_recall(E.event_hits(found, minutes, "user_id", 12 * 3600), "kind")


@query("""with v as (select user_id, ts, value > 10 as alert, event_type = 'error' as near, lag(ts) over w as pt, lag(value > 10) over w as pa from events window w as (partition by user_id order by ts)),
r as (select *, sum((pt is null or ts - pt > interval '2 days' or pa <> alert)::int) over (partition by user_id order by ts rows unbounded preceding) as run from v),
g as (select user_id, run, max(near) as touches from r where alert group by 1, 2), h as (select count(*) filter (not near) / 60 as normal_h from v)
select (select count(*) from g where not touches) as false_alerts, normal_h, 100 * (select count(*) from g where not touches) / normal_h as false_alerts_per_100_h from h""")
def false_alert_rate(spark, sf_dir):
    """Runs of high values that hold no error, for 100 hours without errors."""
    df = events(spark, sf_dir, "user_id", "event_type", "value")
    return E.false_alert_rate(df.select("user_id", "ts", (F.col("value") > 10).alias("alert"), (F.col("event_type") == "error").alias("near")), "user_id", 2 * W.DAY)


@query(f"""with {LABELS}, s as (select d.*, l.label, l.hours_to_failure, least(v.value / 60, 1) as p from d join labelled l using (event_id) join events v using (event_id))
select m as machine_id, next_ts as next_failure_ts, count(*) as hours, avg((p >= 0.5)::int) as recall, max(p >= 0.5) as caught, coalesce(arg_min(hours_to_failure, ts) filter (p >= 0.6), 0) as lead_h, max(p) as max_p from s where label = 1 group by 1, 2""")
def failure_leads(spark, sf_dir):
    """How early and how steadily each failure is foreseen."""
    return E.failure_leads(_scored(spark, sf_dir), "machine_id", 0.5, 0.6)


@query(f"""with {LABELS}, s as (select d.m, d.ts, l.label, least(v.value / 60, 1) >= 0.5 as alarm from d join labelled l using (event_id) join events v using (event_id)),
q as (select *, sum((pa is null or pa <> alarm)::int) over (partition by m order by ts rows unbounded preceding) as run from (select *, lag(alarm) over (partition by m order by ts) as pa from s)),
g as (select m, run, max(label) as hit from q where alarm group by 1, 2), c as (select count(*) as k from g where hit = 0), w as (select count(distinct m) * (epoch_us(max(ts)) - epoch_us(min(ts))) / (7 * 86400 * 1e6) as weeks from s)
select k as false_alarms, weeks as machine_weeks, k / weeks as per_machine_week from c, w""")
def false_alarm_rate(spark, sf_dir):
    """Runs of alarms that no failure follows, for a machine-week."""
    return E.false_alarm_rate(_scored(spark, sf_dir), "machine_id", 0.5)


def _scored(spark, sf_dir):
    p = events(spark, sf_dir, "event_id", "value").select("event_id", F.least(F.col("value") / 60, F.lit(1.0)).alias("p"))
    return labelled(spark, sf_dir).join(p, "event_id")


@query("""with c as (select value, count(*) as k from events group by 1), s as (select value, sum(k) over (order by value) as n_le, sum(k) over () as n, min(value) over () as lo, max(value) over () as hi from c)
select arg_max(value, (n_le - 1)::double / (n - 1)::double - (value - lo) / (hi - lo)) as eps from s""")
def knee_point(spark, sf_dir):
    """The value at the knee of the sorted values."""
    return E.knee(events(spark, sf_dir, "value"), "value")


_BOUNDS = [datetime(2024, 1, 10), datetime(2024, 1, 17), datetime(2024, 1, 24), datetime(2024, 2, 1)]


@query("""with e as (select event_id, user_id, ts, (epoch_us(ts) - 1704067200000000) / 3.6e9 as h from events), b as (select * from (values (1, timestamp '2024-01-10', timestamp '2024-01-17'), (2, timestamp '2024-01-17', timestamp '2024-01-24'), (3, timestamp '2024-01-24', timestamp '2024-02-01')) as b(fold, lo, hi)),
m as (select fold, user_id, min(h) as begins from e join b on ts >= lo group by 1, 2), f as (select e.*, b.*, begins from e join b on ts < hi left join m on m.fold = b.fold and m.user_id = e.user_id)
select fold, case when ts >= lo then 'test' else 'train' end as part, count(*) as n, sum(event_id)::bigint as ids from f where ts >= lo or begins is null or h <= begins - 48 group by 1, 2""")
def purged_folds(spark, sf_dir):
    """Forward-chaining folds without training rows whose label looks into the tested time."""
    df = events(spark, sf_dir, "event_id", "user_id").select("event_id", F.col("user_id").alias("machine_id"), "ts", ((F.col("us") - 1704067200000000) / 3.6e9).alias("engine_h"))
    return maintenance.folds(df, _BOUNDS).groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(f"""with recursive {NUMBERED}, d as (select event_id, user_id, n, n * 500000 + pauses * 5000000 as us, value / 60 as score, n * 2.0 as span_s, n % 20 < 14 as closed, n % 90 < 80 as moving from nb),
l as (select *, coalesce(last_value(case when score >= 0.6 and span_s >= 30 then true when score < 0.55 then false end ignore nulls) over k, false) as high, closed and moving as shut from d window k as (partition by user_id order by us rows unbounded preceding)),
r as (select *, sum((ps is null or ps <> shut)::int) over (partition by user_id order by us rows unbounded preceding) as run from (select *, lag(shut) over (partition by user_id order by us) as ps, lag(high, 1, false) over (partition by user_id order by us) as ph from l)),
o as (select *, shut and us - min(us) over (partition by user_id, run) > 2000000 as over_ from r), f as (select *, over_ and not lag(over_, 1, false) over (partition by user_id order by us) as sure from o),
p as (select user_id, n, sure as post, case when sure then us end as last from f where n = 1
  union all select f.user_id, f.n, f.sure or (f.over_ and (p.last is null or f.us - p.last >= 2000000)), case when f.sure or (f.over_ and (p.last is null or f.us - p.last >= 2000000)) then f.us else p.last end from p join f on f.user_id = p.user_id and f.n = p.n + 1)
select event_id, 'score' as reason from f where high and not ph union all select event_id, 'eyes_closed' from f join p on f.user_id = p.user_id and f.n = p.n where post""")
def fatigue_alerts(spark, sf_dir):
    """When fatigue and closed eyes are told."""
    df = numbered(spark, sf_dir, "event_id", "value").drop("us")
    us = F.col("n").cast("long") * 500_000 + F.col("pauses") * 5_000_000
    seen = df.select("event_id", "user_id", us.alias("us"), (F.col("value") / 60).alias("score"), (F.col("n") * 2.0).alias("span_s"), (F.col("n") % 20 < 14).alias("closed"), (F.col("n") % 90 < 80).alias("moving"))
    return proximity.fatigue_alerts(seen, "user_id").select("event_id", "reason")


@query("""with s as (select event_id as shift_id, ts + interval '2 days' as end_time, event_id % 4 = 0 as done from events where event_type = 'signup'), f as (select event_id as shift_id, ts + interval '3 days' as failed_at from events where event_id % 5 = 0)
select shift_id, end_time from s where end_time <= timestamp '2024-01-20 12:00:00' and end_time > timestamp '2024-01-20 12:00:00' - interval '5 days' and not done
and not exists (select 1 from f where f.shift_id = s.shift_id and failed_at > timestamp '2024-01-20 12:00:00' - interval '2 days')""")
def handover_candidates(spark, sf_dir):
    """Shifts that ended lately, have no summary and have not failed just now."""
    df = events(spark, sf_dir, "event_id", "event_type")
    after = lambda days: F.col("ts") + F.expr(f"interval {days} days")
    shifts = df.where("event_type = 'signup'").select(F.col("event_id").alias("shift_id"), after(2).alias("end_time"), F.when(F.col("event_id") % 4 == 0, "done").alias("summary"))
    failed = df.where("event_id % 5 = 0").select(F.col("event_id").alias("shift_id"), after(3).alias("failed_at"))
    return recommend.handover_candidates(shifts, failed, F.lit("2024-01-20 12:00:00").cast("timestamp"), "5 days", "2 days").select("shift_id", "end_time")


@query("""select event_id as id from events where event_type <> 'purchase' and event_type <> 'view' and event_id % 3 <> 0 and coalesce(case when event_id % 2 = 0 then ts + interval '2 days' end, ts) <= timestamp '2024-01-20' - interval '30 seconds'""")
def orphaned_alerts(spark, sf_dir):
    """Open alerts that were quiet before a restart and that nobody tracks."""
    df = events(spark, sf_dir, "event_id", "event_type")
    alerts = df.select(F.col("event_id").alias("id"), "ts", F.when(F.col("event_id") % 2 == 0, F.col("ts") + F.expr("interval 2 days")).alias("last_ts"), F.when(F.col("event_type") == "purchase", F.col("ts")).alias("resolved_at"), F.when(F.col("event_type") == "view", "SOS").otherwise("PROXIMITY").alias("alert_code"))
    return sessions.orphans(alerts, alerts.where("id % 3 = 0"), F.lit("2024-01-20").cast("timestamp")).select("id")
