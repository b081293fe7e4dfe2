"""Episodes whose severity rises, and lookups in a renewed table, over the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import text
from ...operators import windows as W
from ...streaming import episodes, proximity, renewed
from ..registry import events, query, table

_KINDS = {"click": "info", "purchase": "warning", "signup": "critical", "error": "emergency"}


@query("""with t as (select user_id, epoch_us(ts) as us, max(case event_type when 'purchase' then 1 when 'signup' then 2 when 'error' then 3 else 0 end) as rank, count(*) as rows,
  arg_min(event_type, (case event_type when 'purchase' then '2' when 'signup' then '1' when 'error' then '0' else '3' end) || event_type) as code from events group by all),
b as (select *, coalesce(us - lag(us) over (partition by user_id order by us) > 129600000000, true) as fresh from t),
e as (select *, sum(fresh::int) over (partition by user_id order by us rows unbounded preceding) as ep from b),
r as (select *, sum(rows) over k as n, max(rank) over (partition by user_id, ep order by us rows between unbounded preceding and 1 preceding) as top, min(us) over (partition by user_id, ep) as start from e window k as (partition by user_id, ep order by us rows unbounded preceding)),
o as (select user_id, us, case when fresh then 'open' else 'rise' end as reason, code, rank, n, start from r where fresh or rank > top),
f as (select user_id, ep, max(us) + 129600000000 as us, max(rank) as rank, sum(rows) as n, min(us) as start, arg_min(code, us) as first from e group by all),
c as (select f.user_id, f.us, 'resolve' as reason, arg_min(e.code, e.us) as code, f.rank, f.n, f.start from f join e on e.user_id = f.user_id and e.ep = f.ep and e.rank = f.rank where first <> 'signup' group by all)
select user_id, make_timestamp(us) as ts, reason, code, ['info', 'warning', 'critical', 'emergency'][rank + 1] as severity, n::bigint as n, make_timestamp(start) as start_ts from (select * from o union all select * from c)""")
def episode_changes(spark, sf_dir):
    """Openings, rises in severity and ends of users' episodes of events with pauses of at most a day and a half; those that begin with a signup don't end."""
    df = events(spark, sf_dir, "user_id", "event_type")
    kinds = F.create_map(*(F.lit(x) for kv in _KINDS.items() for x in kv))
    return episodes.changes(df.withColumn("severity", kinds[F.col("event_type")]), "user_id", "ts", "event_type", "severity", 1.5 * W.DAY, ("signup",))


@query("""with recursive e as (select event_id, user_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as n from events),
p as (select event_id, user_id, n, us as checked from e where n = 1 union all select e.event_id, e.user_id, e.n, case when e.us - p.checked >= 172800000000 then e.us else p.checked end from p join e on e.user_id = p.user_id and e.n = p.n + 1),
v as (select user_id, epoch_us(ts) as us, max(value) as value from events where event_type = 'purchase' group by all)
select event_id, p.user_id, make_timestamp(checked) as checked_at, v.value as newest from p asof left join v on p.user_id = v.user_id and p.checked >= v.us""")
def renewed_lookup(spark, sf_dir):
    """Each event with the user's newest purchase as of the last lookup; a user looks up every two days at most."""
    df = events(spark, sf_dir, "event_id", "user_id", "event_type", "value")
    bought = df.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("value").alias("newest"))
    got = renewed.renewed(df.select("event_id", "user_id", "ts"), bought, "user_id", "ts", "at", ["newest"], 2 * W.DAY, tie="newest")
    return got.select("event_id", "user_id", "checked_at", "newest")


@query("""with f as (select user_id, min(ts) as t0 from events group by 1), d as (select user_id, min(ts) as t1 from events join f using (user_id) where ts - t0 >= interval '4 days' group by 1),
s as (select user_id, value / 150 as x, t1 from events left join d using (user_id) where t1 is null or ts <= t1), m as (select user_id, median(x) as mid, count(x) as n, bool_or(t1 is not null) as done from s group by 1),
c as (select user_id, done, n, 0.75::double * avg(x) filter (x >= 0.8::double * mid) as t from s join m using (user_id) group by all)
select user_id, done, n, case when g then t else 0.22 end as threshold, done and not g as fallback from (select *, coalesce(done and n >= 6 and t between 0.12 and 0.30, false) as g from c)""")
def eye_calibration(spark, sf_dir):
    """Each user's threshold from four days of values, or the default where there are too few or it isn't plausible."""
    df = events(spark, sf_dir, "user_id", "value").withColumn("x", F.col("value") / 150)
    return proximity.eye_threshold(df, "user_id", "x", 4 * W.DAY, 6)


_WORDS = r"list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^a-z0-9\x{{0900}}-\x{{097F}}\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 2)"
_CODES = r"list_distinct(regexp_extract_all(upper({0}), 'E-\d{{3}}'))"


@query(f"""with d as (select doc_id, coalesce(text, '') || ' e-' || (110 + doc_id % 4 * 105) as t from documents), b as (select item_id, coalesce(text, '') || case when item_id % 3 = 0 then ' E-' || (110 + item_id % 4 * 105) else '' end as t from benchmark),
dw as (select doc_id, unnest(list_distinct({_WORDS.format('t')})) as w from d), bw as (select item_id, w, count(*) as k from (select item_id, unnest({_WORDS.format('t')}) as w from b) group by all),
n as (select doc_id, item_id, sum(k) as n from dw join bw using (w) group by all),
dc as (select doc_id, unnest({_CODES.format('t')}) as c from d), bc as (select item_id, unnest({_CODES.format('t')}) as c from b),
same as (select distinct doc_id, item_id, true as same from dc join bc using (c)),
s as (select doc_id, item_id, coalesce(n, 0) + case when same then 5 when item_id in (select item_id from bc) then -5 else 0 end as score from n full join same using (doc_id, item_id)),
r as (select * from s where score >= 2 qualify row_number() over (partition by doc_id order by score desc, item_id) = 1)
select doc_id, item_id, score::bigint as score from documents left join r using (doc_id)""")
def best_answers(spark, sf_dir):
    """The benchmark item that answers each document best, by shared words and fault codes."""
    code = lambda i: (110 + F.col(i) % 4 * 105).cast("string")
    d = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" e-"), code("doc_id")).alias("t"))
    b = table(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("item_id") % 3 == 0, F.concat(F.lit(" E-"), code("item_id"))).otherwise("")).alias("t"))
    return text.best_answers(d, b, "doc_id", "t", "item_id", "t")
