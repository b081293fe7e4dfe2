"""Neighbours and dense clusters of a user's days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...operators import evaluation, neighbours
from ..registry import events, query

_DAYS = "p as materialized (select user_id * 1000 + dayofyear(ts) as id, count(*)::double as a, max(value) / 10 as b from events group by 1)"
_FAR = "f as materialized (select x.id, list_sort(min(sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)), 4))[4] as k_distance from p x cross join p y group by x.id)"


def days(spark, sf_dir) -> DataFrame:
    """Events a day and the highest value, a point a user and day."""
    df = events(spark, sf_dir, "user_id", "value")
    each = df.groupBy((F.col("user_id") * 1000 + F.dayofyear("ts")).alias("id")).agg(F.count(F.lit(1)).cast("double").alias("a"), (F.max("value") / 10).alias("b"))
    return each.select("id", F.array("a", "b").alias("x"))


@query(f"with {_DAYS}, {_FAR} select id, k_distance from f")
def k_distances(spark, sf_dir):
    """How far the fourth nearest day is, the day itself included."""
    return neighbours.k_distances(days(spark, sf_dir), "id", "x", 4)


@query(f"""with {_DAYS}, {_FAR}, c as (select k_distance as value, count(*) as k from f group by 1), s as (select value, sum(k) over (order by value) as n_le, sum(k) over () as n, min(value) over () as lo, max(value) over () as hi from c)
select arg_max(value, (n_le - 1)::double / (n - 1)::double - (value - lo) / (hi - lo)) as eps from s""")
def k_distance_eps(spark, sf_dir):
    """The radius of dense clusters: the knee of the k-distances."""
    return evaluation.knee(neighbours.k_distances(days(spark, sf_dir), "id", "x", 4), "k_distance")


@query(f"""with recursive {_DAYS}, e as materialized (select x.id as a, y.id as b from p x join p y on sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)) <= 0.35),
core as materialized (select a as id from e group by 1 having count(*) >= 4), l as materialized (select e.a, e.b from e join core c on e.a = c.id join core d on e.b = d.id),
g(id, top) as (select id, id from core union select l.b, g.top from g join l on l.a = g.id where l.b > g.top), k as (select id, min(top) as cluster from g group by 1),
b as (select e.a as id, min(k.cluster) as cluster from e join k on k.id = e.b where e.a not in (select id from core) group by 1)
select p.id, k.id is not null as core, coalesce(k.cluster, b.cluster) as cluster from p left join k using (id) left join b using (id)""")
def density_clusters(spark, sf_dir):
    """Clusters of dense days, their core, and noise."""
    return neighbours.density_clusters(days(spark, sf_dir), "id", "x", 0.35, 4)
