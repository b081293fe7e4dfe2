"""Windows, islands, ranks and cumulative queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ...operators import clean, islands
from ...operators import windows as W
from ..registry import events, query, table

D = W.DAY
#: DuckDB's half-open trailing frame of a number of days.
FRAME = "(partition by user_id order by ts range between interval '{} microseconds' preceding and current row)"
FRAME3, FRAME7, FRAME14 = (FRAME.format(d * 86_400_000_000 - 1) for d in (3, 7, 14))
RUNS = """e as (select *, case when lag(ts) over w is null or ts - lag(ts) over w > interval '12 hours' or (event_type = 'view') is distinct from lag(event_type = 'view') over w then 1 else 0 end as brk
    from events window w as (partition by user_id order by ts)),
r as (select *, sum(brk) over (partition by user_id order by ts rows unbounded preceding) as run_id from e)"""


@query(f"select event_id, user_id, count(value) over {FRAME3} as n, avg(value) over {FRAME3} as mean3, stddev_pop(value) over {FRAME3} as std3 from events")
def trail_mean_std(spark, sf_dir):
    """Count, mean and deviation of the last three days of each user."""
    got = W.trailing_stats(events(spark, sf_dir, "event_id", "user_id", "value"), "user_id", "value", 3 * D)
    return got.select("event_id", "user_id", "n", F.col("mean").alias("mean3"), F.col("std").alias("std3"))


@query(f"select event_id, user_id, count(value) over {FRAME3} as n, avg(value) over {FRAME3} as mean3 from events")
def trail_chunked(spark, sf_dir):
    """The same trailing mean with each user's series split into ten-day chunks."""
    df = events(spark, sf_dir, "event_id", "user_id", "value")
    got = W.chunked(df, "user_id", 3 * D, 10 * D, lambda x, keys: x.withColumns({"n": F.count("value").over(W.trailing(keys, 3 * D)), "mean3": F.avg("value").over(W.trailing(keys, 3 * D))}))
    return got.select("event_id", "user_id", "n", "mean3")


@query(f"""with t as (select *, epoch_us(ts) / 86400000000.0 - 19723.0 as d from events),
s as (select event_id, user_id, count(d) over w as n, sum(d) over w as st, sum(d * d) over w as stt, sum(value) over w as sx, sum(d * value) over w as stx from t window w as {FRAME7})
select event_id, user_id, case when n * stt - st * st > 1e-9 then (n * stx - st * sx) / (n * stt - st * st) else 0.0 end as slope7 from s""")
def trail_slope(spark, sf_dir):
    """Least-squares slope of the value on days over a week."""
    df = events(spark, sf_dir, "event_id", "user_id", "value").withColumn("d", F.col("us") / 86_400_000_000.0 - 19723.0)
    return df.select("event_id", "user_id", W.slope(F.col("d"), F.col("value"), W.trailing("user_id", 7 * D)).alias("slope7"))


@query(f"""with t as (select *, epoch_us(ts) / 86400000000.0 - 19723.0 as d, case when event_type <> 'click' then value end as x from events),
s as (select event_id, user_id, count(x) over w as n, sum(case when x is not null then d end) over w as st, sum(case when x is not null then d * d end) over w as stt, sum(x) over w as sx, sum(d * x) over w as stx from t window w as {FRAME7})
select event_id, user_id, case when n >= 3 and n * stt - st * st > 1e-9 then (n * stx - st * sx) / (n * stt - st * st) end as slope7 from s""")
def slope_nullaware(spark, sf_dir):
    """Slope over rows that have a value (clicks have none), from three such rows on."""
    df = events(spark, sf_dir, "event_id", "user_id", "event_type", "value").withColumns({"d": F.col("us") / 86_400_000_000.0 - 19723.0, "x": F.when(F.col("event_type") != "click", F.col("value"))})
    return df.select("event_id", "user_id", W.slope(F.col("d"), F.col("x"), W.trailing("user_id", 7 * D), null_aware=True).alias("slope7"))


_BINS = "b as (select user_id, date_diff('day', timestamp '2024-01-01', ts)::bigint as bin, count(*) as n, avg(value) as x from events group by 1, 2)"


def _bins(spark, sf_dir):
    day = F.datediff(F.col("ts"), F.lit("2024-01-01")).cast("long")
    return events(spark, sf_dir, "user_id", "value").groupBy("user_id", day.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("x"))


@query(f"with {_BINS} select user_id, bin, sum(n) over (partition by user_id order by bin range between 6 preceding and current row)::bigint as n7 from b")
def bin_window(spark, sf_dir):
    """Rows of the last seven day bins."""
    return _bins(spark, sf_dir).select("user_id", "bin", F.sum("n").over(W.by("user_id", "bin").rangeBetween(-6, 0)).alias("n7"))


@query(f"with {_BINS} select user_id, bin, sum(x * n) over w / sum(case when x is not null then n end) over w as mean7 from b window w as (partition by user_id order by bin range between 6 preceding and current row)")
def weighted_trail(spark, sf_dir):
    """Mean of seven day bins, by the rows in them."""
    return _bins(spark, sf_dir).select("user_id", "bin", W.weighted_trailing_mean(F.col("x"), F.col("n"), W.by("user_id", "bin").rangeBetween(-6, 0)).alias("mean7"))


@query(f"""with {_BINS} select user_id, bin, case when sum(n) over w >= 5 then sum(x * n) over w / sum(n) over w end as baseline from b
window w as (partition by user_id order by bin range between 13 preceding and 3 preceding)""")
def lagged_baseline(spark, sf_dir):
    """Mean of the bins from two weeks to three days back, if they hold five rows."""
    return _bins(spark, sf_dir).select("user_id", "bin", W.lagged_mean(F.col("x"), F.col("n"), "user_id", "bin", 14, 3, 5).alias("baseline"))


@query(f"select event_id, user_id, sum((event_type = 'error')::int) over {FRAME7}::bigint as errors7 from events")
def trail_7d_sum(spark, sf_dir):
    """Errors of the last seven days."""
    df = events(spark, sf_dir, "event_id", "user_id", "event_type")
    return df.select("event_id", "user_id", F.sum((F.col("event_type") == "error").cast("long")).over(W.trailing("user_id", 7 * D)).alias("errors7"))


@query(f"with {RUNS} select user_id, run_id::bigint as run_id, event_type = 'view' as viewing, min(ts) as start_ts, max(ts) as end_ts, count(*) as n from r group by 1, 2, 3")
def islands_runs(spark, sf_dir):
    """Runs of views or other events without a gap over twelve hours."""
    df = events(spark, sf_dir, "user_id", "event_type").withColumn("viewing", F.col("event_type") == "view")
    got = islands.run_summary(df, "user_id", D / 2, "viewing")
    return got.select("user_id", "run_id", "viewing", F.timestamp_micros("start_us").alias("start_ts"), F.timestamp_micros("end_us").alias("end_ts"), "n")


@query("""with e as (select *, event_type = 'error' as act, lag(event_type = 'error') over w as pa, ts - lag(ts) over w as gap from events window w as (partition by user_id order by ts))
select event_id, user_id from e where act and not coalesce(pa and gap <= interval '1 day', false)""")
def run_starts(spark, sf_dir):
    """First errors of runs of errors."""
    df = events(spark, sf_dir, "event_id", "user_id", "event_type")
    return df.withColumn("first", islands.run_starts(F.col("event_type") == "error", "user_id", D)).where("first").select("event_id", "user_id")


@query(f"with {RUNS} select event_id, user_id, (epoch_us(ts) - epoch_us(min(ts) over (partition by user_id, run_id)))::bigint as age_us from r")
def state_age(spark, sf_dir):
    """How long the user has been in the present state."""
    df = events(spark, sf_dir, "event_id", "user_id", "event_type").withColumn("viewing", F.col("event_type") == "view")
    return islands.runs(df, "user_id", D / 2, "viewing").select("event_id", "user_id", (F.col("us") - F.col("run_start")).alias("age_us"))


@query(f"""with {RUNS} select event_id, user_id, avg(value) over (partition by user_id, run_id order by ts rows unbounded preceding) as run_mean from r where event_type = 'view'""")
def run_running_mean(spark, sf_dir):
    """Mean of a run of views so far."""
    df = events(spark, sf_dir, "event_id", "user_id", "event_type", "value").withColumn("viewing", F.col("event_type") == "view")
    w = Window.partitionBy("user_id", "run_id").orderBy("us").rowsBetween(Window.unboundedPreceding, 0)
    return islands.runs(df, "user_id", D / 2, "viewing").where("viewing").select("event_id", "user_id", F.avg("value").over(w).alias("run_mean"))


@query("select event_id, user_id, lag(value) over w as before, lead(value) over w as after, value - lag(value) over w as change from events window w as (partition by user_id order by ts)")
def lag_lead_diff(spark, sf_dir):
    w = W.by("user_id")
    return events(spark, sf_dir, "event_id", "user_id", "value").select("event_id", "user_id", F.lag("value").over(w).alias("before"), F.lead("value").over(w).alias("after"), (F.col("value") - F.lag("value").over(w)).alias("change"))


@query("select event_id, user_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by ts rows unbounded preceding) as last_purchase from events")
def ffill(spark, sf_dir):
    """The value of the last purchase, carried forward."""
    df = events(spark, sf_dir, "event_id", "user_id", "event_type", "value")
    return df.select("event_id", "user_id", W.ffill(F.when(F.col("event_type") == "purchase", F.col("value")), W.by("user_id")).alias("last_purchase"))


@query("""with e as (select *, value is null or value < 1 or value > 120 as bad from events), m as (select *, bad and not coalesce(lag(bad) over w, true) and coalesce(ts - lag(ts) over w <= interval '2 days', false) as glitch from e window w as (partition by user_id order by ts))
select event_id, user_id, glitch, case when glitch then last_value(case when not glitch then value end ignore nulls) over (partition by user_id order by ts rows between unbounded preceding and 1 preceding) else value end as value from m""")
def glitch_repair(spark, sf_dir):
    """Lone values outside 1 to 120 replaced by the value before."""
    got = clean.repair_glitches(events(spark, sf_dir, "event_id", "user_id", "value"), "user_id", {"value": (1.0, 120.0)}, 2 * D)
    return got.select("event_id", "user_id", F.col("glitch").isNotNull().alias("glitch"), "value")


@query("select event_id, user_id, count(*) over (partition by user_id order by ts rows between current row and unbounded following) as left_n from events")
def reverse_cumsum(spark, sf_dir):
    """Events from here to the user's last."""
    return events(spark, sf_dir, "event_id", "user_id").select("event_id", "user_id", W.reverse_total(F.lit(1).cast("long"), W.by("user_id")).alias("left_n"))


@query("""with e as (select *, count(*) filter (event_type = 'purchase') over (partition by user_id order by ts rows unbounded preceding) as period from events)
select event_id, user_id, period, sum((event_type = 'view')::int) over (partition by user_id, period order by ts rows unbounded preceding)::bigint as views from e""")
def cumsum_since_event(spark, sf_dir):
    """Views since the last purchase."""
    df = events(spark, sf_dir, "event_id", "user_id", "event_type")
    df = df.withColumn("period", F.count_if(F.col("event_type") == "purchase").over(W.by("user_id").rowsBetween(Window.unboundedPreceding, 0)))
    return df.select("event_id", "user_id", "period", F.sum((F.col("event_type") == "view").cast("long")).over(W.by(["user_id", "period"]).rowsBetween(Window.unboundedPreceding, 0)).alias("views"))


@query("""with d as (select user_id, ts::date::timestamp as day, sum(value) as s, count(value) as n from events group by 1, 2)
select user_id, day, sum(s) over w / sum(n) over w as prior_mean from d window w as (partition by user_id order by day rows between unbounded preceding and 1 preceding)""")
def expanding_prior_mean(spark, sf_dir):
    """Mean value over all earlier days."""
    d = events(spark, sf_dir, "user_id", "value").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    return d.select("user_id", "day", W.prior_mean(F.col("s"), F.col("n"), W.by("user_id", "day")).alias("prior_mean"))


@query("""select t.event_id, t.user_id, avg(h.value) as prior7 from events t left join events h on h.user_id = t.user_id and h.event_type = 'view' and h.ts >= t.ts - interval '7 days' and h.ts < t.ts
where t.event_type = 'purchase' group by 1, 2""")
def past_only_ratio(spark, sf_dir):
    """For each purchase, the mean of the user's views in the week before it."""
    df = events(spark, sf_dir, "event_id", "user_id", "event_type", "value")
    t = df.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return W.lookback_mean(t, df.where("event_type = 'view'"), "user_id", "ts", "ts", "value", 7 * D, "prior7").select("event_id", "user_id", "prior7")


@query("""with g as (select user_id, date_trunc('week', ts)::date::timestamp as week, count(*) as n from events group by 1, 2)
select user_id, week, n, rank() over (partition by week order by n desc) as rank from g""")
def rank_in_group(spark, sf_dir):
    """Users by their events in a week."""
    g = events(spark, sf_dir, "user_id").groupBy("user_id", F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("rank", F.rank().over(Window.partitionBy("week").orderBy(F.desc("n"))).cast("long"))


@query("select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_per_key(spark, sf_dir):
    """The last event of each user."""
    return W.latest(events(spark, sf_dir), "user_id", F.desc("us"), F.desc("event_id")).select("user_id", "event_id", "event_type", "value")


@query(f"select event_id, user_id, min((value > 20)::int) over {FRAME3} = 1 as held from events")
def held_for(spark, sf_dir):
    """Whether all values of the last three days are over 20."""
    df = events(spark, sf_dir, "event_id", "user_id", "value")
    return df.select("event_id", "user_id", W.held_for(F.col("value") > 20, "user_id", 3 * D).alias("held"))


@query("""select event_id, user_id, case when count(*) over w = 3 then avg(value) over w end as mean_lag from events window w as (partition by user_id order by ts rows between 5 preceding and 3 preceding)""")
def full_frame_lagged(spark, sf_dir):
    """Mean of the rows five to three before, where there are three."""
    w = W.by("user_id").rowsBetween(-5, -3)
    return events(spark, sf_dir, "event_id", "user_id", "value").select("event_id", "user_id", W.full_frame(F.avg("value").over(w), w, 3).alias("mean_lag"))


@query("select event_id, user_id, sum(value) over (partition by user_id order by ts rows between 9 preceding and current row) as sum10 from events")
def ten_row_sum(spark, sf_dir):
    return events(spark, sf_dir, "event_id", "user_id", "value").select("event_id", "user_id", F.sum("value").over(W.by("user_id").rowsBetween(-9, 0)).alias("sum10"))


@query("select user_id, event_id, date_trunc('hour', ts) as hour from events qualify row_number() over (partition by user_id, date_trunc('hour', ts) order by ts, event_id) = 1")
def first_per_hour(spark, sf_dir):
    """The first event of each user's hours."""
    df = events(spark, sf_dir, "event_id", "user_id").withColumn("hour", F.date_trunc("hour", "ts"))
    return W.latest(df, ["user_id", "hour"], F.asc("us"), F.asc("event_id")).select("user_id", "event_id", "hour")


@query("""with r as (select *, row_number() over (partition by user_id order by ts, event_id) as a, row_number() over (partition by user_id order by ts desc, event_id desc) as z from events)
select user_id, avg(value) filter (z <= 10) - avg(value) filter (a <= 10) as trend from r group by 1""")
def head_tail_trend(spark, sf_dir):
    """Mean of the last ten values less that of the first ten."""
    return W.head_tail_change(events(spark, sf_dir, "event_id", "user_id", "value"), "user_id", [F.asc("us"), F.asc("event_id")], [F.desc("us"), F.desc("event_id")], "value", 10, "trend")


@query("""with w as (select user_id, s as start_ts, count(*) as n from events, (select unnest(generate_series(timestamp '2023-12-25', timestamp '2024-03-01', interval '12 hours')) as s) g where ts >= s and ts < s + interval '2 days' group by 1, 2)
select user_id, start_ts, n from w qualify row_number() over (partition by user_id order by n desc, start_ts) = 1""")
def hop_windows_best(spark, sf_dir):
    """Each user's busiest two-day window, by steps of twelve hours."""
    hops = W.hop_windows(events(spark, sf_dir, "user_id"), "ts", "2 days", "12 hours").groupBy("user_id", F.col("start").alias("start_ts")).agg(F.count(F.lit(1)).alias("n"))
    return W.latest(hops, "user_id", F.desc("n"), F.asc("start_ts"))


@query("""with e as (select *, event_type in ('error', 'click') as act from events), r as (select *, sum((act is distinct from pa)::int) over (partition by user_id order by ts rows unbounded preceding) as run from (select *, lag(act) over (partition by user_id order by ts) as pa from e)),
h as (select *, act and ts - min(ts) over (partition by user_id, run) > interval '1 day' as over_ from r)
select event_id, user_id from h qualify over_ and not coalesce(lag(over_) over (partition by user_id, run order by ts), false)""")
def hold_trigger(spark, sf_dir):
    """Where errors or clicks alone have gone on for more than a day: once a run."""
    df = events(spark, sf_dir, "event_id", "user_id", "event_type")
    return islands.hold_trigger(df, "user_id", F.col("event_type").isin("error", "click"), D).select("event_id", "user_id")


@query(f"select event_id, user_id, sum((event_type = 'click')::int) over {FRAME3}::bigint as clicks, avg((event_type = 'click')::int) over {FRAME3} as share from events")
def sliding_counter(spark, sf_dir):
    """Clicks of the last three days and their share of all events."""
    df, w = events(spark, sf_dir, "event_id", "user_id", "event_type"), W.trailing("user_id", 3 * D)
    c = (F.col("event_type") == "click").cast("long")
    return df.select("event_id", "user_id", F.sum(c).over(w).alias("clicks"), F.avg(c).over(w).alias("share"))


@query("select l_orderkey, sum(l_quantity) as qty, sum(sum(l_quantity)) over (partition by o_custkey order by o_orderdate, l_orderkey rows unbounded preceding) as running from lineitem join orders on l_orderkey = o_orderkey group by l_orderkey, o_custkey, o_orderdate")
def cumulative_quantity(spark, sf_dir):
    """Running quantity of each customer's orders."""
    per = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty"))
    j = per.join(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "l_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return j.select("l_orderkey", "qty", F.sum("qty").over(w).alias("running"))
