"""Sessions, tumbling samples and state in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import islands
from ...operators import windows as W
from ...streaming import sessions as S
from ..registry import events, query

ISLANDS = """e as (select *, case when lag(ts) over w is null or ts - lag(ts) over w > interval '6 hours' then 1 else 0 end as brk from events window w as (partition by user_id order by ts)),
s as (select *, sum(brk) over (partition by user_id order by ts rows unbounded preceding) as sid from e)"""


@query(f"with {ISLANDS} select user_id, min(ts) as start_ts, max(ts) as last_ts, count(*) as n, max(value) as top, arg_max(value, ts) as last_value from s group by user_id, sid")
def session_coalesce(spark, sf_dir):
    """Events of a user no more than six hours apart as one row."""
    got = S.coalesce_events(events(spark, sf_dir, "user_id", "value"), "ts", "6 hours", ["user_id"], top=F.max("value"), last_value=F.max_by("value", "ts"))
    return got.select("user_id", "start_ts", "last_ts", "n", "top", "last_value")


@query(f"with {ISLANDS} select user_id, max(ts) + interval '6 hours' as expires from s where event_type <> 'signup' group by user_id, sid")
def session_expiry(spark, sf_dir):
    """When the sessions that have other events than signups run out."""
    df = events(spark, sf_dir, "user_id", "event_type")
    got = S.coalesce_events(df, "ts", "6 hours", ["user_id"], others=F.count_if(F.col("event_type") != "signup"), last_other=F.max(F.when(F.col("event_type") != "signup", F.col("ts"))))
    return got.where("others > 0").select("user_id", (F.col("last_other") + F.expr("interval 6 hours")).alias("expires"))


@query("select user_id, date_trunc('day', ts) as day, avg(value) as mean, count(*) filter (event_type = 'error') as errors from events group by 1, 2")
def tumbling_sample(spark, sf_dir):
    """One row a user and day."""
    got = events(spark, sf_dir, "user_id", "event_type", "value").groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.avg("value").alias("mean"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return got.select("user_id", F.col("w.start").alias("day"), "mean", "errors")


@query("""with v as (select *, value > 40 as act, ts - lag(ts) over w as gap, lag(value > 40) over w as pa from events window w as (partition by user_id order by ts)),
r as (select *, sum((pa is null or gap > interval '2 days' or not pa)::int) over (partition by user_id order by ts rows unbounded preceding) as run from v where act)
select user_id, min(ts) as start_ts, max(ts) as end_ts, count(*) as n, max(value) as peak from r group by user_id, run having max(ts) - min(ts) >= interval '12 hours'""")
def fault_episodes(spark, sf_dir):
    """Episodes of high values without a gap over two days that last half a day, with their peaks."""
    df = events(spark, sf_dir, "user_id", "value").withColumn("act", F.col("value") > 40)
    got = islands.run_summary(df, "user_id", 2 * W.DAY, "act", peak=F.max("value")).where("act and end_us - start_us >= 43200000000")
    return got.select("user_id", F.timestamp_micros("start_us").alias("start_ts"), F.timestamp_micros("end_us").alias("end_ts"), "n", "peak")


@query("""with d as (select user_id, ts, value from events), m as (select user_id, min(ts) as t0 from d group by 1), f as (select d.* from d join m using (user_id) where ts <= t0 + interval '5 days'), b as (select user_id, median(value) as med from f group by 1)
select user_id, avg(value) filter (value >= 0.8 * med) as baseline from f join b using (user_id) group by 1""")
def calibration(spark, sf_dir):
    """A baseline from each user's first five days: the mean of the values not far under their median."""
    df = events(spark, sf_dir, "user_id", "value")
    first = df.groupBy("user_id").agg(F.min("ts").alias("t0"))
    near = df.join(first, "user_id").where(F.col("ts") <= F.col("t0") + F.expr("interval 5 days"))
    med = near.groupBy("user_id").agg(F.median("value").alias("med"))
    return near.join(med, "user_id").groupBy("user_id").agg(F.avg(F.when(F.col("value") >= 0.8 * F.col("med"), F.col("value"))).alias("baseline"))


@query("""with l as (select *, last_value(case when value >= 30 then 1 when value < 20 then 0 end ignore nulls) over k as a, last_value(case when value >= 60 then 1 when value < 50 then 0 end ignore nulls) over k as b from events window k as (partition by user_id order by ts rows unbounded preceding))
select event_id, user_id, (coalesce(a, 0) + coalesce(b, 0))::int as level from l""")
def hysteresis_levels(spark, sf_dir):
    """A level that enters at its floor and leaves only well below it, in event order."""
    df = events(spark, sf_dir, "event_id", "user_id", "value")
    return S.hysteresis(df, "user_id", "us", "value", [30.0, 60.0], 10.0, "level").select("event_id", "user_id", "level")


@query("""select user_id, event_id from events where event_type = 'error' and ts <= timestamp '2024-01-15' and not exists (select 1 from events r where r.user_id = events.user_id and r.event_type = 'purchase' and r.ts > events.ts and r.ts <= timestamp '2024-01-15')""")
def open_at_instant(spark, sf_dir):
    """Errors before an instant that no purchase has resolved by then."""
    at = F.lit("2024-01-15").cast("timestamp")
    df = events(spark, sf_dir, "event_id", "user_id", "event_type").where(F.col("ts") <= at)
    resolved = df.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("resolved"))
    return df.where("event_type = 'error'").join(resolved, "user_id", "left").where("resolved is null or resolved <= ts").select("user_id", "event_id")
