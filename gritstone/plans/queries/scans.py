"""Scans, filters, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import dates, predicates, text
from ...operators import clean
from ...sources import schemas
from ..registry import events, query, table


@query("select o_orderkey, o_totalprice from orders where o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1996-01-01'")
def scan_prune(spark, sf_dir):
    """Two columns and a pushed date range."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.where("o_orderdate >= timestamp_ntz'1995-01-01' and o_orderdate < timestamp_ntz'1996-01-01'").select("o_orderkey", "o_totalprice")


@query("select event_id, user_id from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-08'")
def filter_range_halfopen(spark, sf_dir):
    return table(spark, sf_dir, "events", "event_id", "user_id", "ts").where(predicates.half_open("ts", "2024-01-05", "2024-01-08")).select("event_id", "user_id")


@query("select event_id from events where ts between timestamp '2024-01-05' and timestamp '2024-01-08'")
def filter_range_closed(spark, sf_dir):
    return table(spark, sf_dir, "events", "event_id", "ts").where(predicates.closed("ts", "2024-01-05", "2024-01-08")).select("event_id")


@query("select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY') or c_acctbal < 0 or c_acctbal is null or c_name like '%99'")
def filter_in_or_null(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return c.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") | (F.col("c_acctbal") < 0) | F.col("c_acctbal").isNull() | F.col("c_name").like("%99")).select("c_custkey")


@query("select event_id, (value is null or value < 1 or value > 60)::int + (user_id < 20)::int as bad from events")
def plausible_flags(spark, sf_dir):
    """How many of two signals are out of range."""
    df = events(spark, sf_dir, "event_id", "user_id", "value")
    return df.select("event_id", (clean.implausible("value", 1, 60).cast("int") + clean.implausible("user_id", 20, 1e9).cast("int")).alias("bad"))


@query("""select event_id, value > 30 and g as warning, value > 60 and g as critical from (select *, coalesce(json_extract(props, '$.k')::int > 20, false) as g from events)""")
def threshold_gated(spark, sf_dir):
    """Levels of a threshold that counts only while another signal is high."""
    k = F.get_json_object("props", "$.k").cast("int")
    level = predicates.threshold(F.col("value"), {"warning": 30, "critical": 60}, gate=(k, 20))
    return events(spark, sf_dir, "event_id", "value", "props").select("event_id", *(c.alias(n) for n, c in level.items()))


@query("select event_id, (event_type = 'view')::int as is_view, (event_type = 'purchase')::int as is_purchase, (event_type = 'error')::int as is_error from events")
def one_hot(spark, sf_dir):
    return events(spark, sf_dir, "event_id", "event_type").select("event_id", *(c.alias(f"is_{n}") for n, c in predicates.one_hot("event_type", ["view", "purchase", "error"]).items()))


@query("select event_id, case when event_type in ('view', 'click') then event_type end as level from events")
def category_levels(spark, sf_dir):
    """Categories that training did not see become NULL."""
    return events(spark, sf_dir, "event_id", "event_type").select("event_id", predicates.known("event_type", ["view", "click"]).alias("level"))


@query("select o_orderkey from orders join customer on o_custkey = c_custkey where c_nationkey = 3")
def rls_view(spark, sf_dir):
    """The orders that someone of nation 3 may see."""
    o, c = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    return predicates.visible(o.join(c, o.o_custkey == c.c_custkey), F.col("c_nationkey"), 3, manager=False).select("o_orderkey")


@query("select 'l_orderkey' as rule, l_orderkey as id, count(*) as n from lineitem where l_orderkey not in (select o_orderkey from orders) group by 2 union all select 'o_custkey', o_custkey, count(*) from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0) group by 2")
def violations_fk(spark, sf_dir):
    """References without a target."""
    l, o = table(spark, sf_dir, "lineitem", "l_orderkey"), table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer", "c_custkey", "c_acctbal").where("c_acctbal > 0")
    a, b = schemas.missing_references(l, "l_orderkey", o, "o_orderkey"), schemas.missing_references(o, "o_custkey", c, "c_custkey")
    return a.unionByName(b)


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def violations_unique(spark, sf_dir):
    return schemas.duplicates(table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("""select o_orderkey, date_trunc('week', o_orderdate)::date::timestamp as monday, (isodow(o_orderdate) - 1)::int as weekday, date_trunc('hour', o_orderdate + interval '330 minutes') as local_hour, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as iso,
(date_diff('day', timestamp '1990-01-01', o_orderdate) / 365.25)::double as age from orders""")
def date_parts(spark, sf_dir):
    """Week, weekday from Monday 0, local hour, ISO text and age in years."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    t = F.col("o_orderdate")
    return o.select("o_orderkey", dates.monday(t).alias("monday"), F.weekday(t).alias("weekday"), F.date_trunc("hour", dates.local(t, "Asia/Kolkata")).alias("local_hour"), dates.iso(t).alias("iso"), dates.years(F.lit("1990-01-01").cast("timestamp"), t).alias("age"))


@query("""select p_partkey, least(greatest(p_size, 10), 40) as clipped, floor(p_retailprice / 7)::bigint as floored, sqrt(p_retailprice) as root, ln(1 + p_size) as log1p, sign(p_size - 25)::double as side,
(p_retailprice - 900) / 1100 as scaled, sin(p_size) as wave, exp(-p_size / 10.0) as decay from part""")
def math_functions(spark, sf_dir):
    p, size, price = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice"), F.col("p_size"), F.col("p_retailprice")
    return p.select("p_partkey", F.least(F.greatest(size, F.lit(10)), F.lit(40)).alias("clipped"), F.floor(price / 7).alias("floored"), F.sqrt(price).alias("root"), F.log1p(size).alias("log1p"), F.signum(size - 25.0).alias("side"), ((price - 900) / 1100).alias("scaled"), F.sin(size).alias("wave"), F.exp(-size / 10.0).alias("decay"))


@query("""select doc_id, case when regexp_matches(text, '[ऀ-ॿ]') then 'devanagari' when regexp_matches(text, '[஀-௿]') then 'tamil' when regexp_matches(text, '[À-ÿ]') then 'latin accents' else 'plain' end as script from documents""")
def script_detect(spark, sf_dir):
    """The script of each document."""
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.script(F.col("text")).alias("script"))


@query("""with d as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) as w from documents), b as (select item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) as w from benchmark),
o as (select doc_id, item_id, count(*) as overlap from d join b using (w) group by 1, 2)
select doc_id, item_id, overlap from o qualify row_number() over (partition by doc_id order by overlap desc, item_id) = 1""")
def word_overlap(spark, sf_dir):
    """The benchmark item that shares most words with each document."""
    d, b, none = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"), F.array().cast("array<string>")
    words = F.coalesce(text.words(F.col("text")), none)
    best = text.best_matches(d, b, "doc_id", "item_id", "text", words, words, none, none, 1)
    return best.select(F.col("_q").alias("doc_id"), F.col("_a").alias("item_id"), F.col("score").alias("overlap"))


@query(r"""select doc_id, trim(regexp_replace(regexp_replace(replace(lower(text || ' E 365, e-1234 and E110!'), 'ß', 'ss'), '\be\s*-?\s*(\d{3})\b', 'e-\1', 'g'), '[^\p{L}\p{M}\p{N}-]+', ' ', 'g')) as key from documents""")
def question_keys(spark, sf_dir):
    """Texts as keys of a cache: without case and signs, fault codes in one spelling."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", text.question_key(F.concat("text", F.lit(" E 365, e-1234 and E110!"))).alias("key"))


@query("select event_id, json_extract(props, '$.k')::bigint as k, json_extract(props, '$.missing') is not null as has_missing, 'k=' || coalesce((json_extract(props, '$.k'))::varchar, '') as label from events")
def json_path(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return events(spark, sf_dir, "event_id", "props").select("event_id", k.cast("long").alias("k"), F.get_json_object("props", "$.missing").isNotNull().alias("has_missing"), F.concat(F.lit("k="), F.coalesce(k, F.lit(""))).alias("label"))


@query("select o_orderkey, sha256(o_orderstatus || o_orderpriority) as version, 'Order ' || o_orderkey || ': ' || coalesce(o_orderpriority, '?') as title from orders")
def hash_and_template(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return o.select("o_orderkey", F.sha2(F.concat("o_orderstatus", "o_orderpriority"), 256).alias("version"), text.template("Order {}: {}", F.col("o_orderkey"), F.col("o_orderpriority")).alias("title"))


@query("select page_id, regexp_extract(url, '^https?://([^/]+)', 1) as host, url like '%/' as dir, coalesce(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), 'none') as title from pages")
def regex_parts(spark, sf_dir):
    p = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return p.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.col("url").like("%/").alias("dir"), F.coalesce(F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")), F.lit("none")).alias("title"))


@query("""select r_regionkey, '{' || string_agg(case when contains(n_name, ' ') then '"' || n_name || '"' else n_name end, ',' order by n_name) || '}' as literal from region join nation on r_regionkey = n_regionkey group by 1""")
def array_literals(spark, sf_dir):
    """Arrays as brace literals, with quotes where a name has a blank."""
    n = table(spark, sf_dir, "nation", "n_name", "n_regionkey").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    return n.select("r_regionkey", text.brace_literal(F.col("names")).alias("literal"))


@query("""select event_id, event_type is distinct from 'view' as other, coalesce(value, 0) as value, case when value >= 75 then 'green' when value >= 50 then 'orange' else 'red' end as band from events""")
def bands_and_nulls(spark, sf_dir):
    df = events(spark, sf_dir, "event_id", "event_type", "value")
    return df.select("event_id", (~F.col("event_type").eqNullSafe("view")).alias("other"), F.coalesce("value", F.lit(0.0)).alias("value"), predicates.bands(F.col("value"), [(75, "green"), (50, "orange")], "red").alias("band"))


@query("select event_id, case when date_diff('day', date '2024-01-01', ts::date) < 20 then 'train' when date_diff('day', date '2024-01-01', ts::date) < 25 then 'val' else 'test' end as fold from events")
def split_by_day(spark, sf_dir):
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01"))
    return events(spark, sf_dir, "event_id").select("event_id", F.when(day < 20, "train").when(day < 25, "val").otherwise("test").alias("fold"))


@query("""select event_id, case when user_id is null then 'user_id' when event_type not in ('view', 'signup', 'purchase', 'error', 'click') then 'event_type' when event_type = 'purchase' and (value is null or value < 5) then 'value' end as error from events""")
def validate_events(spark, sf_dir):
    """The first broken rule of each event, by its type; NULL: valid."""
    rules = [("user_id", F.col("user_id").isNotNull()), ("event_type", F.col("event_type").isin("view", "signup", "purchase", "error", "click")), ("value", (F.col("event_type") != "purchase") | (F.col("value") >= 5))]
    return events(spark, sf_dir).select("event_id", schemas.first_error(rules).alias("error"))


@query("""with recursive d as (select doc_id, case when doc_id % 3 <> 0 then '# ' || source || chr(10) else '' end || replace(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10), chr(10) || '## '), '. ', '.' || chr(10) || chr(10)) as t, 'doc ' || doc_id as stem from documents where text is not null),
l as (select doc_id, case when contains(chr(10) || t, chr(10) || '# ') then trim(regexp_extract(chr(10) || t, '\n# ([^\n]*)', 1), ' ') else stem end as title, string_split(regexp_replace(chr(10) || t, '\n# [^\n]*', '', 'g'), chr(10) || '## ') as parts from d),
s as (select doc_id, title, i - 1 as section, parts[i] as part from l, unnest(range(1, len(parts) + 1)) as u(i)),
b as (select doc_id, title, section, case when section = 0 then title else trim(regexp_extract(part, '^([^\n]*)', 1), ' ') end as heading, regexp_replace(case when section = 0 then part else regexp_replace(part, '^[^\n]*', '') end, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') as body from s),
p as (select doc_id, section, case when length(body) <= 2400 then [body] else regexp_split_to_array(body, '\n[ \t\n\r\f\v]*\n') end as ps from b where body <> ''),
r as (select doc_id, section, 1 as i, null::varchar as done, ps[1] as open, 0 as piece from p
  union all select r.doc_id, r.section, i + 1, case when open <> '' and length(open) + length(ps[i + 1]) + 2 > 2400 then open end, case when open <> '' and length(open) + length(ps[i + 1]) + 2 > 2400 then right(open, 400) || chr(10) || chr(10) || ps[i + 1] when open <> '' then open || chr(10) || chr(10) || ps[i + 1] else ps[i + 1] end, i
    from r join p on p.doc_id = r.doc_id and p.section = r.section where i < len(ps)),
o as (select doc_id, section, i as pos, done as txt from r where done is not null union all select r.doc_id, r.section, i + 1, open from r join p on p.doc_id = r.doc_id and p.section = r.section where i = len(ps) and open <> '')
select doc_id, (row_number() over (partition by doc_id order by section, pos) - 1)::int as chunk_index, heading, '# ' || title || case when heading = title then '' else chr(10) || '## ' || heading end || chr(10) || chr(10) || txt as content from o join b using (doc_id, section)""")
def markdown_chunks(spark, sf_dir):
    """Chunks of the documents as markdown: their lines as sections, their sentences as paragraphs."""
    d = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), "\n", "\n## "), r"\. ", ".\n\n")
    top = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("# "), F.col("source"), F.lit("\n"))).otherwise("")
    return text.markdown_chunks(d.select("doc_id", F.concat(top, body).alias("body")), "doc_id", "body", F.concat(F.lit("doc "), F.col("doc_id")))
