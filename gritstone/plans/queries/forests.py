"""An isolation forest over the event stream, and its twin in SQL, level by level."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ...operators import isolation
from ...sources.shared import written_once
from ..registry import events, query

_TREES, _SAMPLE, _DEEP, _SHARE = 12, 64, 6, 0.03
_XS = "x0, x1, x2"
_FOUND = "[s for s in [" + ", ".join(f"{{'f': {i}, 'lo': min(x{i}), 'hi': max(x{i})}}" for i in range(3)) + "] if s.hi > s.lo]"
_DRAWN = "('0x' || substr(md5(g || ':' || tree || ':' || node || ':{}'), 1, 8))::bigint"
_VALUE = "case {}f when 0 then x0 when 1 then x1 else x2 end"
_SIZE = "case when {0} < 2 then 0 when {0} = 2 then 1 else 2 * (ln({0} - 1) + 0.5772156649015329::double) - 2 * ({0} - 1) / {0} end"


def _grown(d: int) -> str:
    """The nodes at a depth, and the rows at the next."""
    return f"""v{d} as (select g, tree, node, count(*)::double as size, {_FOUND} as v from s{d} group by all),
n{d} as (select g, tree, node, size, pick.f as f, pick.lo + (pick.hi - pick.lo) * (({_DRAWN.format('t')} + 0.5::double) / 4294967296) as cut from (select *, case when len(v) > 0 and {d} < {_DEEP} then v[{_DRAWN.format('f')} % len(v) + 1] end as pick from v{d})),
s{d + 1} as (select g, {_XS}, tree, 2 * node + ({_VALUE.format('')} >= cut)::int as node from s{d} join n{d} using (g, tree, node) where f is not null),"""


def _stepped(d: int) -> str:
    return f"w{d + 1} as (select w.event_id, w.g, {_XS}, w.tree, case when f is null then w.node else 2 * w.node + ({_VALUE.format('nodes.')} >= cut)::int end as node from w{d} w left join nodes using (g, tree, node)),"


_FOREST = f"""with e as (select event_id, event_type as g, value as x0, (hour(ts) * 60 + minute(ts))::double as x1, coalesce((epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id))) / 3.6e9, 0) as x2 from events),
p as (select *, count(*) over (partition by g) as n from (select *, row_number() over (partition by g order by md5(event_id::varchar), event_id) as rk from e) where rk <= {_TREES * _SAMPLE}),
s0 as (select g, {_XS}, (rk - 1 + c) % {_TREES} as tree, 1::bigint as node from p, range({_TREES}) t(c) where c < least({_TREES}, greatest(1, {_TREES * _SAMPLE} // n))),
{chr(10).join(_grown(d) for d in range(_DEEP + 1))}
nodes as ({' union all '.join(f'select * from n{d}' for d in range(_DEEP + 1))}),
w0 as (select event_id, g, {_XS}, c as tree, 1::bigint as node from e, range({_TREES}) t(c)),
{chr(10).join(_stepped(d) for d in range(_DEEP))}
whole as (select g, sum({_SIZE.format('size')}) as whole from n0 group by g),
l as (select event_id, g, sum(length(bin(node)) - 1 + {_SIZE.format('coalesce(size, 0)')}) as total from w{_DEEP} left join nodes using (g, tree, node) group by all),
c as (select event_id, g, 2 ** -(total / whole) as score from l join whole using (g)),
m as (select g, quantile_cont(score, {1 - _SHARE}) as score_limit from c semi join p using (event_id) group by g)
select event_id, g as event_type, score, score > score_limit + 1e-9 as flagged from c join m using (g)"""


@query(_FOREST)
def isolation_scores(spark, sf_dir):
    """How unusual each event is among those of its type, by value, time of day and time since the user's last event, and which are flagged."""
    before = F.lag("us").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    df = events(spark, sf_dir, "event_id", "user_id", "event_type", "value")
    df = df.select("event_id", "event_type", "value", (F.hour("ts") * 60 + F.minute("ts")).alias("minute"), F.coalesce((F.col("us") - before) / 3.6e9, F.lit(0.0)).alias("pause"))
    seen = ["value", "minute", "pause"]
    rows = written_once(isolation.picked(df, "event_type", "event_id", seen, _TREES, _SAMPLE), "picked")
    forest = written_once(isolation.grow(rows, _TREES, _SAMPLE), "forest")
    scored = isolation.score(df, forest, "event_type", seen)
    limit = isolation.limits(rows, forest, _SHARE).select(F.col("grp").alias("event_type"), "score_limit")
    return scored.join(limit, "event_type").select("event_id", "event_type", "score", (F.col("score") > F.col("score_limit") + 1e-9).alias("flagged"))
