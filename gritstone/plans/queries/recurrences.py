"""Recurrences over each user's events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import recurrence
from ..registry import events, query

NUMBERED = "e as (select event_id, user_id, value, row_number() over (partition by user_id order by ts, event_id) as n from events)"


@query(f"""with recursive {NUMBERED},
r as (select event_id, user_id, n, value as level from e where n = 1
    union all select e.event_id, e.user_id, e.n, 0.75::double * r.level + 0.25::double * e.value from r join e on e.user_id = r.user_id and e.n = r.n + 1)
select event_id, user_id, level from r""")
def recurrence_level(spark, sf_dir):
    """A level that goes a quarter of the way to each value."""
    df = events(spark, sf_dir, "event_id", "user_id", "value")
    return recurrence.follow(df, "user_id", ["us", "event_id"], "value", 0.75, "level").select("event_id", "user_id", "level")


@query(f"""with recursive {NUMBERED},
r as (select event_id, user_id, n, 0.5::double as place from e where n = 1
    union all select e.event_id, e.user_id, e.n, least(1.0::double, greatest(0.0::double, r.place + (e.value / 256.0::double - 0.125::double))) from r join e on e.user_id = r.user_id and e.n = r.n + 1)
select event_id, user_id, place from r""")
def recurrence_walk(spark, sf_dir):
    """A walk between 0 and 1 that each value pushes up or down."""
    df = events(spark, sf_dir, "event_id", "user_id", "value").withColumn("change", F.col("value") / 256.0 - 0.125)
    return recurrence.bounded_walk(df, "user_id", ["us", "event_id"], "change", "place").select("event_id", "user_id", "place")
