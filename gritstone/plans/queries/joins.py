"""Joins: dimensions, as-of, intervals, semi and anti, distance and zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import asof, spatial, vectors, windows
from ..registry import events, query, table


@query("select o_orderkey, c_name, n_name, r_name from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def join_dims_left(spark, sf_dir):
    """Orders with customer, nation and region; the planner broadcasts what its statistics call small."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    c, n, r = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey"), table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey"), table(spark, sf_dir, "region", "r_regionkey", "r_name")
    j = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, F.col("c_nationkey") == n.n_nationkey, "left").join(r, F.col("n_regionkey") == r.r_regionkey, "left")
    return j.select("o_orderkey", "c_name", "n_name", "r_name")


@query("select o_orderpriority, count(*) as n, sum(l_quantity) as qty from lineitem join orders on l_orderkey = o_orderkey group by 1")
def join_inner_agg(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity"), table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority")
    return l.join(o, l.l_orderkey == o.o_orderkey).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


@query("""with a as (select o_custkey as k, count(*) as orders, sum(o_totalprice) as total from orders group by 1), b as (select l_suppkey as k, count(*) as lines from lineitem group by 1)
select coalesce(a.k, b.k) as k, orders, total, lines from a full join b on a.k = b.k""")
def outer_metrics(spark, sf_dir):
    """Metrics of two sources on one key, each kept where the other lacks it."""
    a = table(spark, sf_dir, "orders", "o_custkey", "o_totalprice").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("total"))
    b = table(spark, sf_dir, "lineitem", "l_suppkey").groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("lines"))
    return a.join(b, "k", "full")


def _pair(spark, sf_dir, left, right):
    df = events(spark, sf_dir, "event_id", "user_id", "event_type", "value")
    l = df.where(F.col("event_type") == left).select("event_id", "user_id", "ts")
    r = df.where(F.col("event_type") == right).select("user_id", F.col("ts").alias("r_ts"), F.col("event_id").alias("r_id"), F.col("value").alias("r_value"))
    return l, r


_ASOF = "select l.event_id, l.user_id, r.event_id as r_id, r.value as r_value from (select * from events where event_type = '{}') l asof left join (select * from events where event_type = '{}') r on l.user_id = r.user_id and l.ts {} r.ts"


@query(_ASOF.format("purchase", "view", ">="))
def asof_backward(spark, sf_dir):
    """The last view at or before each purchase."""
    l, r = _pair(spark, sf_dir, "purchase", "view")
    return asof.asof_join(l, r, "user_id", "ts", "r_ts", ["r_id", "r_value"], tie="r_id").select("event_id", "user_id", "r_id", "r_value")


@query(_ASOF.format("purchase", "view", ">="))
def asof_backward_chunked(spark, sf_dir):
    """The same, with each user's series cut into five-day stretches."""
    l, r = _pair(spark, sf_dir, "purchase", "view")
    return asof.asof_join(l, r, "user_id", "ts", "r_ts", ["r_id", "r_value"], tie="r_id", chunk=5 * windows.DAY).select("event_id", "user_id", "r_id", "r_value")


@query(_ASOF.format("error", "purchase", "<"))
def asof_forward_strict(spark, sf_dir):
    """The first purchase after each error."""
    l, r = _pair(spark, sf_dir, "error", "purchase")
    return asof.asof_join(l, r, "user_id", "ts", "r_ts", ["r_id", "r_value"], "forward", exact=False, tie="r_id").select("event_id", "user_id", "r_id", "r_value")


@query(_ASOF.format("error", "purchase", "<="))
def asof_forward_incl(spark, sf_dir):
    """The first purchase at or after each error, over five-day stretches."""
    l, r = _pair(spark, sf_dir, "error", "purchase")
    return asof.asof_join(l, r, "user_id", "ts", "r_ts", ["r_id", "r_value"], "forward", tie="r_id", chunk=5 * windows.DAY).select("event_id", "user_id", "r_id", "r_value")


def _spans(spark, sf_dir):
    """A one-day interval from each signup of a user, cut at the next."""
    s = events(spark, sf_dir, "event_id", "user_id", "event_type").where("event_type = 'signup'")
    w = windows.by("user_id")
    end = F.least(F.col("ts") + F.expr("interval 1 day"), F.coalesce(F.lead("ts").over(w), F.lit("9999-01-01").cast("timestamp")))
    return s.select("user_id", F.col("event_id").alias("span_id"), F.col("ts").alias("start_ts"), end.alias("end_ts"))


_SPANS = "s as (select user_id, event_id as span_id, ts as start_ts, least(ts + interval '1 day', coalesce(lead(ts) over (partition by user_id order by ts), timestamp '9999-01-01')) as end_ts from events where event_type = 'signup')"


@query(f"with {_SPANS} select e.event_id, e.user_id, s.span_id from events e left join s on e.user_id = s.user_id and e.ts >= s.start_ts and e.ts < s.end_ts")
def asof_in_interval(spark, sf_dir):
    """Each event with the signup span that holds it: an as-of join and an end check."""
    e = events(spark, sf_dir, "event_id", "user_id")
    return asof.point_in_interval(e, _spans(spark, sf_dir), "user_id", "ts", "start_ts", "end_ts", ["span_id"]).select("event_id", "user_id", "span_id")


@query(f"with {_SPANS} select e.event_id, s.span_id, (date_diff('hour', s.start_ts, e.ts) - (case when e.ts - s.start_ts < to_hours(date_diff('hour', s.start_ts, e.ts)) then 1 else 0 end) + 1)::bigint as hour_of_span from events e join s on e.user_id = s.user_id and e.ts >= s.start_ts and e.ts < s.end_ts")
def interval_first_match(spark, sf_dir):
    """Events inside spans with the hour of the span, from 1."""
    e = events(spark, sf_dir, "event_id", "user_id")
    got = asof.point_in_interval(e, _spans(spark, sf_dir), "user_id", "ts", "start_ts", "end_ts", ["span_id", "start_ts"]).where("span_id is not null")
    return got.select("event_id", "span_id", (F.floor((F.unix_micros("ts") - F.unix_micros("start_ts")) / 3_600_000_000) + 1).alias("hour_of_span"))


@query(f"with {_SPANS} select span_id, coalesce((select min(e.ts) from events e where e.user_id = s.user_id and e.event_type = 'error' and e.ts >= s.start_ts and e.ts < s.end_ts), end_ts) as cut_ts from s")
def cut_by_min(spark, sf_dir):
    """Spans cut at the first error inside them."""
    errors = events(spark, sf_dir, "user_id", "event_type").where("event_type = 'error'")
    return asof.cut_by_first(_spans(spark, sf_dir), errors, "user_id", "start_ts", "end_ts", "ts", "cut_ts").select("span_id", "cut_ts")


@query("""with o as (select o_orderkey as k, o_custkey, o_orderdate as a, o_orderdate + interval '20 days' as b from orders)
select x.k as k, y.k as other from o x join o y on x.o_custkey = y.o_custkey and x.k < y.k and x.a < y.b and x.b > y.a""")
def overlap_pairs(spark, sf_dir):
    """Orders of a customer whose twenty-day spans overlap."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate").select(F.col("o_orderkey").alias("k"), "o_custkey", F.col("o_orderdate").alias("a"), (F.col("o_orderdate") + F.expr("interval 20 days")).alias("b"))
    return asof.overlap_join(o, o, "o_custkey", ("a", "b"), ("a", "b"), 30 * windows.DAY, {"k": "other"}).where("k < other").select("k", "other")


@query("select o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity >= 49)")
def semi_isin(spark, sf_dir):
    big = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity").where("l_quantity >= 49")
    return table(spark, sf_dir, "orders", "o_orderkey").join(big, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def anti_missing(spark, sf_dir):
    """Orders without a line."""
    return table(spark, sf_dir, "orders", "o_orderkey").join(table(spark, sf_dir, "lineitem", "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query("select l_orderkey, l_linenumber, p_brand, count(*) as n from lineitem left join part on l_partkey = p_partkey group by 1, 2, 3")
def map_lookup(spark, sf_dir):
    """A lookup of one attribute."""
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    return l.join(table(spark, sf_dir, "part", "p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"), "left").groupBy("l_orderkey", "l_linenumber", "p_brand").agg(F.count(F.lit(1)).alias("n"))


#: Fixed corners of the zones that the spatial query uses.
ZONES = (("low", 10.0, [[0.0, 900.0], [25.0, 900.0], [25.0, 1300.0], [0.0, 1300.0]]), ("slant", 5.0, [[5.0, 1000.0], [45.0, 1100.0], [30.0, 1800.0]]), ("high", 20.0, [[20.0, 1200.0], [51.0, 1200.0], [51.0, 2200.0], [20.0, 2200.0]]))


@query("with c(name, lim, poly) as (values " + ", ".join(f"('{n}', {l}::double, {p})" for n, l, p in ZONES) + """),
e as (select p_partkey, name, lim, p_size::double as x, p_retailprice as y, poly[i] as a, poly[i % len(poly) + 1] as b from part, c, (select unnest(range(1, 5)) as i) g where i <= len(poly)),
h as (select p_partkey, name, lim, sum(case when (a[2] > y) <> (b[2] > y) and x < a[1] + (y - a[2]) * (b[1] - a[1]) / nullif(b[2] - a[2], 0) then 1 else 0 end) as n from e group by 1, 2, 3)
select p_partkey, arg_min(name, lim) filter (n % 2 = 1) as zone, min(lim) filter (n % 2 = 1) as zone_limit from h group by 1""")
def pip_join(spark, sf_dir):
    """The zone of lowest limit that each part's size and price lie in."""
    zones = spark.createDataFrame([(1, n, l, p) for n, l, p in ZONES], "site int, name string, lim double, ring array<array<double>>")
    p = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice").withColumns({"site": F.lit(1), "x": F.col("p_size").cast("double")})
    return spatial.lowest_limit(p, zones, "p_partkey", "site", "x", "p_retailprice", "ring", "lim", "name").select("p_partkey", "zone", "zone_limit")


@query("""with c as (select list_transform(embedding, lambda x: x::double) as v from embeddings where vec_id in (1, 2, 3))
select vec_id, bool_or(list_distance(list_transform(embedding, lambda x: x::double), v) <= 1.2) as near from embeddings, c group by 1""")
def range_distance(spark, sf_dir):
    """Whether a vector is within 1.2 of one of three core points."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    core = [r.embedding for r in e.where("vec_id in (1, 2, 3)").orderBy("vec_id").collect()]  # three rows
    return e.select("vec_id", vectors.within_distance(e, "embedding", core, 1.2).alias("near"))


@query("select a.user_id, a.event_id, a.n_next from (select user_id, event_id, count(*) over (partition by user_id order by ts range between interval '1 microsecond' following and interval '21600000000 microseconds' following) as n_next from events) a")
def lead_overlap(spark, sf_dir):
    """Events that begin within six hours after each event."""
    w = windows.by("user_id").rangeBetween(1, 21_600_000_000)
    return events(spark, sf_dir, "event_id", "user_id").select("user_id", "event_id", F.count(F.lit(1)).over(w).alias("n_next"))


@query("""with r as (select user_id, event_id, ts from events where event_type = 'signup'), u as (select distinct user_id from events)
select u.user_id, coalesce(arg_max(event_id, ts) filter (ts <= timestamp '2024-01-15'), arg_max(event_id, ts)) as event_id from u left join r using (user_id) group by 1""")
def nearest_fallback(spark, sf_dir):
    """The last signup before an instant, else the last of all."""
    df = events(spark, sf_dir, "event_id", "user_id", "event_type")
    r = df.where("event_type = 'signup'").groupBy("user_id").agg(F.max_by("event_id", F.when(F.col("ts") <= F.lit("2024-01-15").cast("timestamp"), F.col("us"))).alias("a"), F.max_by("event_id", "us").alias("b"))
    return df.select("user_id").distinct().join(r, "user_id", "left").select("user_id", F.coalesce("a", "b").alias("event_id"))


@query(f"with {_SPANS}, r as (select e.user_id, s.span_id, count(*) as n from events e join s on e.user_id = s.user_id and e.ts >= s.start_ts and e.ts < s.end_ts group by 1, 2) select s.user_id, s.span_id, coalesce(n, 0)::bigint as n from s left join r on s.span_id = r.span_id")
def events_per_span(spark, sf_dir):
    """Events of every span, none counted as zero."""
    e = events(spark, sf_dir, "event_id", "user_id")
    spans = _spans(spark, sf_dir)
    inside = asof.point_in_interval(e, spans, "user_id", "ts", "start_ts", "end_ts", ["span_id"]).where("span_id is not null").groupBy("span_id").agg(F.count(F.lit(1)).alias("n"))
    return spans.join(inside, "span_id", "left").select("user_id", "span_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("""with a as (select user_id, event_id, ts from events where event_type = 'error'), b as (select user_id, event_id, ts from events where event_type = 'view')
select coalesce(a.user_id, b.user_id) as user_id, case when b.ts is null or a.ts > b.ts then 'live' else 'snapshot' end as source from (select user_id, max(ts) as ts from a group by 1) a full join (select user_id, max(ts) as ts from b group by 1) b on a.user_id = b.user_id""")
def merge_newest(spark, sf_dir):
    """Of live rows and snapshot rows, which is newer for each user."""
    df = events(spark, sf_dir, "user_id", "event_type")
    tagged = df.where("event_type in ('error', 'view')").select("user_id", F.struct("us", F.when(F.col("event_type") == "error", "live").otherwise("snapshot").alias("source")).alias("x"))
    return tagged.groupBy("user_id").agg(F.max("x")["source"].alias("source"))


