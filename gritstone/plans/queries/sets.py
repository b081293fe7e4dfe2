"""Set operations, sorting, top-k, upserts, vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ...operators import merge, scoring, vectors
from ..registry import events, query, table


@query("select o_custkey as id, 'order' as kind from orders union all select c_custkey, 'customer' from customer")
def union_all(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders", "o_custkey"), table(spark, sf_dir, "customer", "c_custkey")
    return o.select(F.col("o_custkey").alias("id"), F.lit("order").alias("kind")).unionByName(c.select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind")))


@query("""with a as (select o_custkey as k, o_orderkey as v, 0 as f from orders where o_orderpriority = '1-URGENT' union all select o_custkey, o_orderkey, 1 from orders)
select k, v from a qualify row_number() over (partition by k order by f, v) = 1""")
def union_dedupe_first(spark, sf_dir):
    """One order a customer: the first urgent one, else the first."""
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderpriority")
    urgent = o.where("o_orderpriority = '1-URGENT'")
    return merge.union_first(["k"], *(x.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v")) for x in (urgent, o)), order=[F.asc("v")])


@query("select c_custkey from customer except select o_custkey from orders")
def except_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer", "c_custkey").subtract(table(spark, sf_dir, "orders", "o_custkey"))


@query("select s_nationkey as k from supplier intersect select c_nationkey from customer where c_acctbal > 5000")
def intersect_ids(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_nationkey", "c_acctbal").where("c_acctbal > 5000").select("c_nationkey")
    return table(spark, sf_dir, "supplier", F.col("s_nationkey").alias("k")).intersect(c)


@query("select event_type, min(event_id) as first_id from events group by 1")
def ordered_distinct(spark, sf_dir):
    """Distinct values with the place of the first."""
    return events(spark, sf_dir, "event_id", "event_type").groupBy("event_type").agg(F.min("event_id").alias("first_id"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def top_limit(spark, sf_dir):
    """The twenty largest orders: a heap in each task, no full sort."""
    return table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("select user_id, event_id, value from events qualify row_number() over (partition by user_id order by value desc, event_id) <= 3")
def topk_per_user(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return events(spark, sf_dir, "user_id", "event_id", "value").withColumn("n", F.row_number().over(w)).where("n <= 3").select("user_id", "event_id", "value")


@query("""with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings), s as (select q.vec_id as query_id, v.vec_id, list_cosine_similarity(q.e, v.e) as sim from v q join v on q.vec_id <> v.vec_id where q.vec_id < 10)
select query_id, vec_id, rank::int as rank from (select *, row_number() over (partition by query_id order by sim desc, vec_id) as rank from s) where rank <= 5""")
def topk_per_query(spark, sf_dir):
    """The five nearest vectors to each of ten fixed queries."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return vectors.top_k_per_query(e, e.where("vec_id < 10"), "vec_id", "embedding", 5).select("query_id", "vec_id", "rank")


@query("""with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings), q as (select e from v where vec_id = 7)
select vec_id from (select vec_id, list_cosine_similarity(v.e, q.e) as sim from v, q) where sim >= 0.3 order by sim desc, vec_id limit 4""")
def match_chunks(spark, sf_dir):
    """The four rows nearest to one query vector, at least 0.3 similar."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    q = e.where("vec_id = 7").first()
    return vectors.match_vectors(e, "vec_id", "embedding", q.embedding if q else []).select("vec_id")


@query("""with z as (select user_id, (n - avg(n) over ()) / stddev_pop(n) over () as zn, (v - avg(v) over ()) / stddev_pop(v) over () as zv, (e - avg(e) over ()) / stddev_pop(e) over () as ze, (m - avg(m) over ()) / stddev_pop(m) over () as zm
from (select user_id, count(*) as n, avg(value) as v, count(*) filter (event_type = 'error') as e, max(value) as m from events group by 1)),
u as (select user_id, unnest(['n', 'v', 'e', 'm']) as f, unnest([zn, zv, ze, zm]) as z, unnest([0, 1, 2, 3]) as i from z)
select user_id, string_agg(f, ',' order by abs(z) desc, i) as top from (select * from u qualify row_number() over (partition by user_id order by abs(z) desc, i) <= 3) group by 1""")
def top3_abs_z(spark, sf_dir):
    """The three features that stand out most for each user."""
    g = events(spark, sf_dir, "user_id", "event_type", "value").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("v"), F.count_if(F.col("event_type") == "error").alias("e"), F.max("value").alias("m"))
    z = scoring.global_z(g, ["n", "v", "e", "m"])
    return z.select("user_id", F.array_join(F.transform(scoring.top_by_size({c: F.col(f"z_{c}") for c in ("n", "v", "e", "m")}, 3), lambda x: x["name"]), ",").alias("top"))


@query("select l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_orderkey order by l_returnflag, case when l_tax > 0.02 then l_tax end asc nulls last, l_partkey, l_suppkey, l_extendedprice) as place from lineitem")
def priority_nulls_last(spark, sf_dir):
    """Lines in order of priority, unknown durations last."""
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_tax")
    w = Window.partitionBy("l_orderkey").orderBy("l_returnflag", F.when(F.col("l_tax") > 0.02, F.col("l_tax")).asc_nulls_last(), "l_partkey", "l_suppkey", "l_extendedprice")
    return l.select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(w).cast("long").alias("place"))


@query("""with ch as (select o_custkey as k, o_totalprice as bal from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1)
select coalesce(c_custkey, k) as c_custkey, c_name, case when k is not null then bal else c_acctbal end as c_acctbal from customer full join ch on c_custkey = k""")
def upsert_newest(spark, sf_dir):
    """Balances replaced by each customer's newest order; names, which the change lacks, stay."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal")
    o = table(spark, sf_dir, "orders", "o_custkey", "o_totalprice", "o_orderdate", "o_orderkey").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return merge.upsert(c, o, ["c_custkey"], F.col("at"))


@query("""select c_custkey as k, c_name as name from customer where c_custkey <= 100 union all select o_custkey, min(o_orderpriority) from orders where o_custkey not in (select c_custkey from customer where c_custkey <= 100) group by 1""")
def insert_idempotent(spark, sf_dir):
    """Rows whose key is new, once each."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name").where("c_custkey <= 100").toDF("k", "name")
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderpriority").toDF("k", "name")
    return merge.insert_new(c, o, ["k"], F.asc("name"))


@query("select o_orderkey, case when o_totalprice > 200000 then 'X' else o_orderstatus end as o_orderstatus from orders where not (o_orderpriority = '5-LOW' and o_totalprice < 10000)")
def update_delete(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    kept = merge.delete(o, (F.col("o_orderpriority") == "5-LOW") & (F.col("o_totalprice") < 10000))
    return merge.update(kept, F.col("o_totalprice") > 200000, o_orderstatus=F.lit("X")).select("o_orderkey", "o_orderstatus")


@query("select count(*) filter (o_orderstatus = 'O') as reopened, count(*) filter (o_totalprice is null) as nulled from orders")
def count_before_apply(spark, sf_dir):
    return merge.change_counts(table(spark, sf_dir, "orders", "o_orderstatus", "o_totalprice"), reopened=F.col("o_orderstatus") == "O", nulled=F.col("o_totalprice").isNull())


@query("""with f as (select user_id as k, event_id as seq, event_type as op, value as v from events qualify row_number() over (partition by user_id order by event_id desc) = 1)
select c_custkey as k, c_acctbal as v from customer where c_custkey not in (select k from f) union all select k, v from f where op <> 'error'""")
def change_feed(spark, sf_dir):
    """A feed of changes applied: the last of a key counts, errors delete."""
    t = table(spark, sf_dir, "customer", "c_custkey", "c_acctbal").toDF("k", "v")
    feed = events(spark, sf_dir, "event_id", "user_id", "event_type", "value").select(F.col("user_id").alias("k"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), F.col("value").alias("v"))
    return merge.apply_changes(t, feed, "k", "seq", "op")
