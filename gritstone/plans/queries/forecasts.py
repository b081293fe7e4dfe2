"""Forecasts by boosted trees over the event stream, with their SQL twins, tree by tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...operators import boosting
from ...operators import windows as W
from ...sources.shared import written_once
from .. import maintenance, task_time
from ..registry import events, query

_TREES, _SHRINK, _LEAST = 3, 2, 20
_X = "case f when 0 then x0 when 1 then x1 else x2 end"
_P = "floor(1e6::double / (1 + exp(-s / 1000.0::double)))::bigint"


def _twin(at: list[list[float]], models: list[int | str]) -> str:
    """Tables of a fit with trees of depth 2, from rows e (id, x0, x1, x2, y in thousandths, tr: learned from): s (id, model, s) and nodes t{k} (model, node, f, c, n), v{k} (model, node, v)."""
    logit = models == [boosting.LOGIT]
    g, h = (f"y * 1000 - {_P}", f"{_P} * (1000000 - {_P}) // 1000000") if logit else ("case when y > s then model else model - 100 end", "1")
    edges = "(values " + ", ".join(f"({f}, {c}::double)" for f, cs in enumerate(at) for c in cs) + ") cuts(f, c)"
    gain = "gl * gl / greatest(hl, 1) + (g - gl) * (g - gl) / greatest(h - hl, 1) - g * g / greatest(h, 1)"

    def value(name: str, source: str, shrink: int) -> str:
        if logit:
            return f"{name} as materialized (select model, node, floor((1000 * sum({g}))::double / (sum({h}) + 1000000) / {shrink})::bigint as v from {source} where tr group by all)"
        ranked = f"select model, node, y - s as r, row_number() over (partition by model, node order by y - s) as rk, count(*) over (partition by model, node) as k from {source} where tr"
        return f"{name} as materialized (select model, node, floor(r / {shrink}::double)::bigint as v from ({ranked}) where rk = (model * k + 99) // 100)"

    out = [f"a0 as materialized (select *, 1::bigint as node, 0::bigint as s from e, (values {', '.join(f'({0 if logit else m})' for m in models)}) m(model))", value("v0", "a0", 1), "s0 as materialized (select a0.* replace (s + v as s) from a0 join v0 using (model, node))"]
    for k in range(1, _TREES + 1):
        source = f"s{k - 1}"
        for d in (0, 1):
            node = "1::bigint as node" if d == 0 else "node as node"
            out.append(f"g{k}{d} as (select model, node, {g} as g, {h} as h, x0, x1, x2 from (select * replace ({node}) from {source}) where tr)")
            out.append(f"h{k}{d} as (select model, node, f, c, count(*) filter ({_X} < c) as nl, (sum(g) filter ({_X} < c))::double as gl, (sum(h) filter ({_X} < c))::double as hl, count(*) as n, sum(g)::double as g, sum(h)::double as h from g{k}{d}, {edges} group by all)")
            out.append(f"t{k}{d} as materialized (select model, node, f, c, n, nl from h{k}{d} where least(nl, n - nl) >= {_LEAST} and {gain} > 0 qualify row_number() over (partition by model, node order by {gain} desc, f, c) = 1)")
            out.append(f"a{k}{d} as materialized (select w.* replace (case when f is null then w.node else 2 * w.node + ({_X} >= c)::int end as node) from (select * replace ({node}) from {source}) w left join t{k}{d} t on t.model = w.model and t.node = w.node)")
            source = f"a{k}{d}"
        out += [value(f"v{k}", source, _SHRINK), f"s{k} as materialized (select w.* replace (s + v as s) from {source} w join v{k} using (model, node))"]
    return ",\n".join(out)


def _shares(model: int) -> str:
    """Table p (id, p0, p1, p2): Shapley values of one model, leaf by leaf."""
    leaves = []
    for k in range(1, _TREES + 1):
        root, low = f"(select * from t{k}0 where model = {model} and node = 1) r", f"(select * from t{k}1 where model = {model} and node > 1) d"
        sides = "(values (0), (1)) {}(b)"
        z1, z2 = ("(case {0}.b when 0 then {1}.nl else {1}.n - {1}.nl end)::double / {1}.n".format(*x) for x in (("i", "r"), ("j", "d")))
        leaves.append(f"select v, r.f as f1, r.c as c1, i.b as b1, {z1} as z1, d.f as f2, d.c as c2, j.b as b2, {z2} as z2 from {root} cross join {sides.format('i')} cross join {sides.format('j')} join {low} on d.node = 2 + i.b join v{k} v on v.model = {model} and v.node = 4 + 2 * i.b + j.b")
        leaves.append(f"select v, r.f, r.c, i.b, {z1}, null, null, null, null from {root} cross join {sides.format('i')} join v{k} v on v.model = {model} and v.node = 2 + i.b")  # only leaves have a value
    met = lambda i: f"((case f{i} when 0 then x0 when 1 then x1 else x2 end >= c{i}) = (b{i} = 1))::int"
    part = """case when f2 is null then case when f1 = {0} then v * (o1 - z1) else 0 end when f1 = f2 then case when f1 = {0} then v * (o1 * o2 - z1 * z2) else 0 end
  when f1 = {0} then v * (o1 - z1) * (o2 + z2) / 2 when f2 = {0} then v * (o2 - z2) * (o1 + z1) / 2 else 0 end"""
    return f"""lf as materialized ({' union all '.join(leaves)}),
o as (select id, lf.*, {met(1)} as o1, {met(2)} as o2 from e, lf),
p as materialized (select id, {', '.join(f'coalesce(sum({part.format(i)}), 0) / 1000 as p{i}' for i in range(3))} from o group by id)"""


_TASK_AT = [[float(i) for i in range(5, 200, 5)], [float(i) for i in range(1, 11)], [1.0]]
_TASKS = ["quantity", "slope", "night"]
_TASK_ROWS = """e as materialized (select event_id as id, value as x0, (event_id % 11)::double as x1, (hour(ts) >= 18)::int::double as x2, dayofyear(ts) % 5 as fold, dayofyear(ts) % 5 < 3 as tr,
  (5 + value * (1 + 0.1::double * (event_id % 11)) * (case when hour(ts) >= 18 then 1.5 else 1 end)::double * (0.8::double + 0.4::double * ('0x' || substr(md5(event_id::varchar), 1, 8))::bigint / 4294967296)) as mins, floor(1000 * ln(1 + mins))::bigint as y from events)"""
_LOGS = f"""with {_TASK_ROWS},
{_twin(_TASK_AT, task_time.PERCENTS)},
q as materialized (select id, x0, x1, x2, fold, mins, ln(1 + mins) as l, list_sort(list(s)) as qs from s{_TREES} group by all),
w as (select *, qs[1] / 1000.0::double as q1, qs[2] / 1000.0::double as q2, qs[3] / 1000.0::double as q3 from q),
ms as (select greatest(q1 - l, l - q3) as miss from w where fold = 3), mr as (select miss, row_number() over (order by miss) as rk, count(*) over () as n from ms),
o as (select greatest(coalesce(min(miss) filter (rk = least(ceil((n + 1) * 0.8), n)), 0), 0) as off from mr)"""


def _tasks(spark, sf_dir) -> DataFrame:
    """Events as tasks: minutes by quantity, slope and night, with noise from the id; days are dealt to five folds."""
    df = events(spark, sf_dir, "event_id", "value")
    night, noise = F.hour("ts") >= 18, F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 8), 16, 10).cast("long") / 4294967296
    minutes = 5 + F.col("value") * (1 + 0.1 * (F.col("event_id") % 11)) * F.when(night, 1.5).otherwise(1.0) * (0.8 + 0.4 * noise)
    return df.select("event_id", F.col("value").alias("quantity"), (F.col("event_id") % 11).cast("double").alias("slope"), night.cast("double").alias("night"), (F.dayofyear("ts") % 5).alias("fold"), minutes.alias("minutes"))


def _fitted(spark, sf_dir) -> tuple[DataFrame, DataFrame, float]:
    tasks = written_once(_tasks(spark, sf_dir), "tasks")
    nodes = task_time.fit_forecast(tasks.where("fold < 3"), "minutes", _TASKS, _TASK_AT, trees=_TREES, depth=2, shrink=_SHRINK, least=_LEAST)
    offset = task_time.widening(tasks.where("fold = 3"), nodes, _TASKS, "minutes").first().offset
    return tasks, nodes, offset


@query(_LOGS.replace("o as (select greatest", "ofs as (select greatest") + f""",
{_shares(50)},
m as (select w.*, exp(q2) - exp(q2 - p1) as slope, exp(q2) - exp(q2 - p2) as night from w join p using (id))
select id as event_id, fold, exp(q1 - off) - 1 as p10_min, exp(q2) - 1 as p50_min, exp(q3 + off) - 1 as p90_min, case when abs(slope) > abs(night) or (abs(slope) = abs(night) and 'slope' > 'night') then 'slope' else 'night' end as factor,
  round_even(case when abs(slope) > abs(night) then slope else night end, 1) as factor_min from m, ofs""")
def task_forecast(spark, sf_dir):
    """Minutes of each task at three quantiles, moved apart to hold four fifths of a fold, and the factor that counts most."""
    tasks, nodes, offset = _fitted(spark, sf_dir)
    got = task_time.forecast(tasks, nodes, _TASKS, offset, 1)
    return got.select("event_id", "fold", "p10_min", "p50_min", "p90_min", F.col("factors")[0]["feature"].alias("factor"), F.col("factors")[0]["impact_min"].alias("factor_min"))


@query(_LOGS + """
select fold, count(*) as n, avg((l between q1 - off and q3 + off)::int) as coverage, avg(exp(q3 + off) - exp(q1 - off)) as width_min, avg(abs(mins - (exp(q2) - 1))) as mae_min, avg(greatest(0.1::double * (l - q1), -0.9::double * (l - q1))) as pinball_p10 from w, o group by fold""")
def forecast_coverage(spark, sf_dir):
    """For each fold: the share of tasks inside their interval, its mean width, the middle's mean error, the loss of p10."""
    tasks, nodes, offset = _fitted(spark, sf_dir)
    y, q = F.log1p("minutes"), F.col("_q")
    inside = y.between(q[0] - offset, q[2] + offset)
    return task_time.quantiles(tasks, nodes, _TASKS).groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.avg(inside.cast("int")).alias("coverage"), F.avg(F.exp(q[2] + offset) - F.exp(q[0] - offset)).alias("width_min"),
        F.avg(F.abs(F.col("minutes") - F.expm1(q[1]))).alias("mae_min"), F.avg(F.greatest(0.1 * (y - q[0]), -0.9 * (y - q[0]))).alias("pinball_p10"))


_RISK_AT = [[float(i) for i in range(5, 200, 5)], [0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0], [float(i) for i in range(1, 9)]]
_RISKS = ["value", "pause_h", "errors_72h"]
_DAY_US = 86_400_000_000


@query(f"""with b as (select event_id as id, user_id, event_type, value as x0, (epoch_us(ts) - epoch_us(lag(ts) over k)) / 3.6e9::double as gap, count(*) filter (event_type = 'error') over (partition by user_id order by epoch_us(ts) range between 259200000000 preceding and 1 preceding) as x2,
  min(case when event_type = 'error' then epoch_us(ts) end) over (partition by user_id order by epoch_us(ts) range between 1 following and 86400000000 following) is not null as failed from events window k as (partition by user_id order by ts, event_id)),
z as (select event_type, avg(x0) as m, stddev_samp(x0) as d from b group by 1),
e as materialized (select id, x0, coalesce(gap, '-infinity'::double) as x1, x2::double as x2, failed::int * 1000 as y, user_id % 5 < 3 as tr, coalesce((x0 - m) / d >= 6, false) as far from b join z using (event_type)),
{_twin(_RISK_AT, [boosting.LOGIT])},
{_shares(0)},
f as (select id, far, 1 / (1 + exp(-s / 1000.0::double)) as p, list_transform(list_sort([{{'k': -p0, 'i': 0, 'f': 'value', 'v': p0}}, {{'k': -p1, 'i': 1, 'f': 'pause_h', 'v': p1}}, {{'k': -p2, 'i': 2, 'f': 'errors_72h', 'v': p2}}]), lambda x: {{'f': x.f, 'v': x.v}}) as up,
  list_transform(list_sort([{{'k': -abs(p0), 'i': 0, 'f': 'value', 'v': p0}}, {{'k': -abs(p1), 'i': 1, 'f': 'pause_h', 'v': p1}}, {{'k': -abs(p2), 'i': 2, 'f': 'errors_72h', 'v': p2}}]), lambda x: {{'f': x.f, 'v': x.v}}) as big, p0 from s{_TREES} join p using (id)),
t as (select *, case when len(list_filter(up, lambda x: x.v > 0)) > 0 then list_filter(up, lambda x: x.v > 0)[:2] else big[:2] end as top from f),
n as (select id, case when far then greatest(p, 0.35::double) else p end as p, case when far then list_concat([{{'f': 'value', 'v': p0}}], list_filter(top, lambda x: x.f <> 'value')[:1]) else top end as top from t)
select id as event_id, p, case when p >= 0.6 then 'high' when p >= 0.3 then 'medium' else 'low' end as risk_band, array_to_string(list_transform(top, lambda x: x.f), ',') as factors, round(top[1].v, 3) as first_shap from n""")
def failure_forecast(spark, sf_dir):
    """The chance that an error follows within a day, its band, and the two factors that push it up most."""
    df = events(spark, sf_dir, "event_id", "user_id", "event_type", "value")
    w, error = W.by("user_id"), F.col("event_type") == "error"
    soon = F.min(F.when(error, F.col("us"))).over(w.rangeBetween(1, _DAY_US)).isNotNull()
    df = df.withColumns({"pause_h": (F.col("us") - F.lag("us").over(W.Window.partitionBy("user_id").orderBy("ts", "event_id"))) / 3.6e9, "errors_72h": F.count_if(error).over(w.rangeBetween(-3 * _DAY_US, -1)), "failed": soon.cast("int")})
    scales = df.groupBy("event_type").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_d"))
    far = F.when((F.col("value") - F.col("_m")) / F.nullif(F.col("_d"), F.lit(0.0)) >= maintenance.FLOOR_Z, "value")
    rows = written_once(df.join(scales, "event_type").withColumn("far", far).select("event_id", "user_id", *_RISKS, "failed", "far"), "risks")
    nodes = boosting.fit(rows.where("user_id % 5 < 3"), "failed", _RISKS, _RISK_AT, [boosting.LOGIT], _TREES, 2, _SHRINK, _LEAST)
    got = maintenance.failure_forecast(rows, nodes, _RISKS, "far", 2)
    return got.select("event_id", "p", "risk_band", F.array_join(F.transform("top_factors", lambda x: x["feature"]), ",").alias("factors"), F.col("top_factors")[0]["shap"].alias("first_shap"))
