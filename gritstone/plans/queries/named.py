"""Named lookups: the views and filters that applications ask for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import windows as W
from ...sources import tables
from ..registry import events, query, table


def _at(text):
    return F.lit(text).cast("timestamp")


@query("select event_id, user_id, event_type from events where event_type = 'error' and user_id = 7")
def point_lookup(spark, sf_dir):
    return events(spark, sf_dir, "event_id", "user_id", "event_type").where("event_type = 'error' and user_id = 7").select("event_id", "user_id", "event_type")


@query("select event_id, ts, value from events where user_id = 7 and ts > timestamp '2024-01-05' order by ts limit 10")
def page_after(spark, sf_dir):
    """The next ten events of a user after a time."""
    df = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "value")
    return tables.page(df, "user_id", 7, "ts", _at("2024-01-05"), n=10).select("event_id", "ts", "value")


@query("select event_id, user_id from events where user_id in (3, 5, 8) and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-12'")
def key_range(spark, sf_dir):
    df = table(spark, sf_dir, "events", "event_id", "ts", "user_id")
    return tables.key_range(df, "user_id", [3, 5, 8], "ts", _at("2024-01-05"), _at("2024-01-12")).select("event_id", "user_id")


@query("select event_id, event_type from events where user_id = 7 and ts <= timestamp '2024-01-15' order by ts desc limit 1")
def latest_until(spark, sf_dir):
    """The newest event of a user until a time."""
    df = events(spark, sf_dir, "event_id", "user_id", "event_type").where((F.col("user_id") == 7) & (F.col("ts") <= _at("2024-01-15")))
    return df.orderBy(F.desc("us")).limit(1).select("event_id", "event_type")


@query("select event_id, user_id, value from events where ts <= timestamp '2024-01-15' qualify row_number() over (partition by user_id order by ts desc) = 1")
def latest_until_per_key(spark, sf_dir):
    """The newest event of every user until a time."""
    df = events(spark, sf_dir, "event_id", "user_id", "value").where(F.col("ts") <= _at("2024-01-15"))
    return df.groupBy("user_id").agg(F.max_by(F.struct("event_id", "value"), "us").alias("x")).select("x.event_id", "user_id", "x.value")


@query("select o_orderkey, o_orderstatus from orders where (o_custkey in (1, 2, 4) or o_orderpriority = '1-URGENT') and o_orderdate >= timestamp '1996-01-01' and o_orderdate <= timestamp '1996-03-31'")
def or_group(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    dates = F.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1996-03-31").cast("timestamp_ntz"))
    return o.where((F.col("o_custkey").isin(1, 2, 4) | (F.col("o_orderpriority") == "1-URGENT")) & dates).select("o_orderkey", "o_orderstatus")


@query("select max(o_orderdate)::date::timestamp as latest from orders")
def latest_date(spark, sf_dir):
    return table(spark, sf_dir, "orders", "o_orderdate").agg(F.to_date(F.max("o_orderdate")).alias("latest"))


@query("select o_orderkey, o_totalprice from orders where o_orderdate::date = (select max(o_orderdate)::date from orders)")
def newest_group(spark, sf_dir):
    """Rows of the newest day."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderdate").withColumn("d", F.to_date("o_orderdate"))
    return tables.last_dates(o, "d", 1).select("o_orderkey", "o_totalprice")


@query("select min(o_orderdate) as start_date from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 45)")
def window_start(spark, sf_dir):
    """The first order that has a large line."""
    big = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity").where("l_quantity > 45")
    return table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").join(big, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").agg(F.min("o_orderdate").alias("start_date"))


@query("select o_orderstatus, count(*) as n, max(o_orderkey) filter (o_totalprice > 100000) as last_large from orders group by 1 order by n desc, o_orderstatus limit 1")
def most_common_batch(spark, sf_dir):
    g = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("o_totalprice") > 100000, F.col("o_orderkey"))).alias("last_large"))
    return g.orderBy(F.desc("n"), "o_orderstatus").limit(1)


@query("select event_id, user_id from events where ts between timestamp '2024-01-03' and timestamp '2024-01-20' and (event_type = 'error' or value is null) order by ts, event_id limit 200")
def demo_extract(spark, sf_dir):
    df = events(spark, sf_dir, "event_id", "user_id", "event_type", "value")
    return df.where(F.col("ts").between(_at("2024-01-03"), _at("2024-01-20")) & ((F.col("event_type") == "error") | F.col("value").isNull())).orderBy("us", "event_id").limit(200).select("event_id", "user_id")


@query("select o_orderkey from orders where o_orderstatus is not null and o_orderstatus <> 'F' and o_orderpriority not like '5%'")
def unfinished(spark, sf_dir):
    return table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority").where("o_orderstatus is not null and o_orderstatus <> 'F' and o_orderpriority not like '5%'").select("o_orderkey")


@query("select user_id, arg_max(value, ts) as latest, max(ts) as seen from events group by 1 order by latest desc, user_id limit 20")
def latest_sorted(spark, sf_dir):
    """Latest value of each user, highest first."""
    g = events(spark, sf_dir, "user_id", "value").groupBy("user_id").agg(F.max_by("value", "us").alias("latest"), F.max("ts").alias("seen"))
    return g.orderBy(F.desc("latest"), "user_id").limit(20)


@query("select user_id, count(*) as live from events where ts > timestamp '2024-01-30' - interval '30 minutes' - interval '2 days' group by 1")
def fresh_only(spark, sf_dir):
    """Users seen in the last two days and a half hour before an instant."""
    return events(spark, sf_dir, "user_id").where(F.col("ts") > _at("2024-01-30") - F.expr("interval 2 days 30 minutes")).groupBy("user_id").agg(F.count(F.lit(1)).alias("live"))


@query("select o_orderkey, case when c_custkey is not null then o_custkey end as o_custkey from orders left join (select c_custkey from customer where c_acctbal > 0) on o_custkey = c_custkey")
def null_orphans(spark, sf_dir):
    """References to customers that are gone become null."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_acctbal").where("c_acctbal > 0")
    return tables.null_orphans(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), "o_custkey", c, "c_custkey")


@query("select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc) <= 60")
def last_sixty(spark, sf_dir):
    """The last sixty rows of each user."""
    df = events(spark, sf_dir, "event_id", "user_id")
    return df.withColumn("n", F.row_number().over(W.Window.partitionBy("user_id").orderBy(F.desc("us")))).where("n <= 60").select("user_id", "event_id")


@query("select conv_id, turn, role from conversations where role = 'system' or turn = 0")
def first_turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations", "conv_id", "turn", "role").where("role = 'system' or turn = 0")
