"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ...operators import aggregates as A
from ..registry import events, query, table


@query("select l_returnflag, l_linestatus, sum(l_quantity) as qty, avg(l_quantity) as mean_qty, count(*) as n, min(l_shipdate) as first_ship, max(l_discount) as top_discount from lineitem group by 1, 2")
def group_basic(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.avg("l_quantity").alias("mean_qty"), F.count(F.lit(1)).alias("n"), F.min("l_shipdate").alias("first_ship"), F.max("l_discount").alias("top_discount"))


@query("select user_id, arg_min(value, ts) as first_value, arg_max(value, ts) as last_value from events group by 1")
def first_last(spark, sf_dir):
    return events(spark, sf_dir, "user_id", "value").groupBy("user_id").agg(F.min_by("value", "us").alias("first_value"), F.max_by("value", "us").alias("last_value"))


@query("select p_brand, stddev_pop(p_size) as pop, stddev_samp(p_size) as samp from part group by 1")
def std_pop_samp(spark, sf_dir):
    return table(spark, sf_dir, "part", "p_brand", "p_size").groupBy("p_brand").agg(F.stddev_pop("p_size").alias("pop"), F.stddev_samp("p_size").alias("samp"))


@query("select p_brand, median(p_retailprice) as price from part group by 1")
def median_per_unit(spark, sf_dir):
    return table(spark, sf_dir, "part", "p_brand", "p_retailprice").groupBy("p_brand").agg(F.median("p_retailprice").alias("price"))


@query("select event_type, quantile_cont(value, 0.02) as p2, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.98) as p98 from events group by 1")
def percentile_cont(spark, sf_dir):
    return events(spark, sf_dir, "event_type", "value").groupBy("event_type").agg(*(F.percentile("value", p).alias(n) for n, p in (("p2", 0.02), ("p50", 0.5), ("p98", 0.98))))


@query("select p_brand, list_sort(list(p_size))[ceil(0.9 * (count(p_size) - 1))::int + 1] as p90 from part group by 1")
def percentile_higher(spark, sf_dir):
    """The quantile that is one of the values."""
    return A.quantile_higher(table(spark, sf_dir, "part", "p_brand", "p_size"), ["p_brand"], "p_size", 0.9, "p90")


@query("select l_returnflag, sum(l_discount * l_quantity) / sum(l_quantity) as discount from lineitem where l_quantity > 0 group by 1")
def weighted_mean(spark, sf_dir):
    return table(spark, sf_dir, "lineitem", "l_returnflag", "l_discount", "l_quantity").groupBy("l_returnflag").agg(A.weighted_mean(F.col("l_discount"), F.col("l_quantity")).alias("discount"))


@query("select l_suppkey, case when sum(l_quantity) > 0 then sum(l_extendedprice) / sum(l_quantity) end as unit_price from lineitem group by 1")
def ratio_of_sums(spark, sf_dir):
    return table(spark, sf_dir, "lineitem", "l_suppkey", "l_extendedprice", "l_quantity").groupBy("l_suppkey").agg(A.ratio(F.col("l_extendedprice"), F.col("l_quantity")).alias("unit_price"))


@query("select o_orderpriority, n, row_number() over (order by n desc, o_orderpriority) as place from (select o_orderpriority, count(*) as n from orders group by 1)")
def value_counts_rank(spark, sf_dir):
    c = table(spark, sf_dir, "orders", "o_orderpriority").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "o_orderpriority")).cast("long"))


@query("select user_id, count(*) filter (event_type = 'error') as errors, count(*) filter (value > 50) as high from events group by 1")
def count_if(spark, sf_dir):
    return events(spark, sf_dir, "user_id", "event_type", "value").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value") > 50).alias("high"))


@query("select o_orderpriority, count(distinct o_custkey) as customers from orders group by 1")
def count_distinct(spark, sf_dir):
    return table(spark, sf_dir, "orders", "o_orderpriority", "o_custkey").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"))


@query("select user_id, event_type from (select user_id, event_type, count(*) as n from events group by 1, 2) qualify row_number() over (partition by user_id order by n desc, event_type) = 1")
def argmax_type(spark, sf_dir):
    """Each user's most frequent event type."""
    c = events(spark, sf_dir, "user_id", "event_type").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("user_id").agg(A.most(F.col("event_type"), F.col("n")).alias("event_type"))


@query("""select l_orderkey, l_linenumber, l_partkey, greatest(l_tax, l_discount) as top, case when l_tax >= l_discount then 'tax' else 'discount' end as which from lineitem""")
def rowwise_max_arg(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_tax", "l_discount")
    top, which = A.row_max({"tax": F.col("l_tax"), "discount": F.col("l_discount")})
    return l.select("l_orderkey", "l_linenumber", "l_partkey", top.alias("top"), which.alias("which"))


RANKS = {"view": 0, "click": 1, "signup": 2, "purchase": 3, "error": 4}


@query("select user_id, arg_max(event_type, case event_type " + " ".join(f"when '{k}' then {v}" for k, v in RANKS.items()) + " end) as worst from events group by 1")
def worst_rank(spark, sf_dir):
    """Each user's event type of highest rank."""
    return events(spark, sf_dir, "user_id", "event_type").groupBy("user_id").agg(A.worst(F.col("event_type"), RANKS).alias("worst"))


@query("with g as (select p_brand, var_samp(p_size) as v, avg(p_size) as m from part group by 1) select avg(v) as within, var_samp(m) as between, var_samp(m) / (var_samp(m) + avg(v)) as icc from g")
def icc(spark, sf_dir):
    """How much of the variance of part sizes lies between brands."""
    return A.intraclass(table(spark, sf_dir, "part", "p_brand", "p_size"), "p_brand", "p_size")


@query("select l_returnflag, count(*) filter (l_linestatus = 'F') as f, count(*) filter (l_linestatus = 'O') as o from lineitem group by 1")
def pivot_status(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count()
    return p.select("l_returnflag", F.coalesce("F", F.lit(0)).cast("long").alias("f"), F.coalesce("O", F.lit(0)).cast("long").alias("o"))


@query("select l_returnflag, corr(l_quantity, l_extendedprice) as r from lineitem group by 1")
def corr_pairs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem", "l_returnflag", "l_quantity", "l_extendedprice").groupBy("l_returnflag").agg(F.corr("l_quantity", "l_extendedprice").alias("r"))


@query("""with s as (select event_type, h::int as bucket from (select distinct event_type from events), (select unnest(generate_series(0, 23)) as h)), c as (select event_type, hour(ts)::int as bucket, count(*) as n from events group by 1, 2)
select s.event_type, s.bucket, coalesce(n, 0)::bigint as n from s left join c on s.event_type = c.event_type and s.bucket = c.bucket""")
def hour_histogram_spine(spark, sf_dir):
    """Events of each hour of the day and type, zeros included."""
    return A.spine_counts(events(spark, sf_dir, "event_type"), F.hour("ts"), 0, 23, "event_type")


@query("select case when p_size <= 10 then '1-10' when p_size <= 25 then '11-25' else '26+' end as bin, count(*) as n, avg(p_retailprice) as price from part group by 1")
def binned(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_size", "p_retailprice")
    return p.groupBy(F.when(F.col("p_size") <= 10, "1-10").when(F.col("p_size") <= 25, "11-25").otherwise("26+").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("price"))


@query("select o_orderstatus, min(o_orderkey) as first_id, max(o_orderkey) as last_id, array_to_string(list_sort(list(o_orderkey))[1:3], ',') as ids from orders group by 1")
def summary_ids(spark, sf_dir):
    """Ranges and the first ids of each status; a bounded buffer keeps the three least."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    w = Window.partitionBy("o_orderstatus").orderBy("o_orderkey")
    least = o.withColumn("n", F.row_number().over(w)).where("n <= 3").groupBy("o_orderstatus").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), ",").alias("ids"))
    return o.groupBy("o_orderstatus").agg(F.min("o_orderkey").alias("first_id"), F.max("o_orderkey").alias("last_id")).join(least, "o_orderstatus")


@query("""with t as (select l_tax > 0.04 as truth, l_discount > 0.05 as pred from lineitem), c as (select count(*) filter (truth and pred) as tp, count(*) filter (not truth and pred) as fp, count(*) filter (truth and not pred) as fn from t)
select tp, fp, fn, tp / (tp + fp) as precision, tp / (tp + fn) as recall, 2 * tp / (2 * tp + fp + fn) as f1 from c""")
def precision_recall(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem", "l_tax", "l_discount").select((F.col("l_tax") > 0.04).cast("int").alias("truth"), (F.col("l_discount") > 0.05).cast("int").alias("pred"))
    return A.binary_scores(l, "truth", "pred")


@query("select avg(abs(l_extendedprice - 1000 * l_quantity)) as mae, 100 * avg(abs(l_extendedprice - 1000 * l_quantity) / nullif(abs(l_extendedprice), 0)) as mape, avg((l_extendedprice between 500 * l_quantity and 1500 * l_quantity)::int) as coverage from lineitem")
def interval_coverage(spark, sf_dir):
    q = F.col("l_quantity")
    l = table(spark, sf_dir, "lineitem", "l_extendedprice", "l_quantity").select("l_extendedprice", (1000 * q).alias("mid"), (500 * q).alias("lo"), (1500 * q).alias("hi"))
    return A.forecast_errors(l, "l_extendedprice", "mid", "lo", "hi")


@query("""with c as (select p_size as s, sum((p_retailprice > 1500)::int) as pos, count(*) as n from part group by 1), r as (select pos, sum(pos) over w as tp, sum(n) over w as seen from c window w as (order by s desc rows unbounded preceding))
select sum(pos * tp / seen) / sum(pos) as average_precision from r""")
def pr_auc(spark, sf_dir):
    """Area under precision and recall of part size as a score."""
    return A.average_precision(table(spark, sf_dir, "part", "p_size", "p_retailprice").select("p_size", (F.col("p_retailprice") > 1500).cast("int").alias("y")), "y", "p_size")


@query("""with c as (select p_brand as a, p_type as b, count(*)::double as n from part group by 1, 2), x as (select sum(n * (n - 1) / 2) as cells, sum(n) as total from c), r as (select sum(n * (n - 1) / 2) as rows_ from (select sum(n) as n from c group by a)), k as (select sum(n * (n - 1) / 2) as cols from (select sum(n) as n from c group by b))
select (cells - rows_ * cols / (total * (total - 1) / 2)) / ((rows_ + cols) / 2 - rows_ * cols / (total * (total - 1) / 2)) as ari from x, r, k""")
def rand_index(spark, sf_dir):
    """Agreement of two labellings of the parts."""
    return A.adjusted_rand(table(spark, sf_dir, "part", "p_brand", "p_type"), "p_brand", "p_type")


@query("select coalesce(o_orderstatus, 'all') as status, coalesce(o_orderpriority, 'all') as priority, sum(o_totalprice) as total from orders group by grouping sets ((o_orderstatus), (o_orderpriority))")
def grouping_sets(spark, sf_dir):
    """Two groupings of one input in one pass."""
    o = table(spark, sf_dir, "orders", "o_orderstatus", "o_orderpriority", "o_totalprice")
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    return o.groupingSets([[s], [p]], s, p).agg(F.sum("o_totalprice").alias("total")).select(F.coalesce(s, F.lit("all")).alias("status"), F.coalesce(p, F.lit("all")).alias("priority"), "total")


@query("""with d as (select user_id, date_trunc('day', ts) as day, count(*) as n, count(*) filter (event_type = 'error') as errors from events group by 1, 2)
select user_id, sum(errors) filter (n >= 2)::bigint as busy_errors, max(n) as most from d group by 1""")
def two_level(spark, sf_dir):
    """Daily counts, then their summary."""
    d = events(spark, sf_dir, "user_id", "event_type").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return d.groupBy("user_id").agg(F.sum(F.when(F.col("n") >= 2, F.col("errors"))).alias("busy_errors"), F.max("n").alias("most"))
