"""Episodes of events: repeats of a key within a gap are one alert whose severity only rises, and which ends by itself after a silence.

The table form and the stream give the same changes: an `open` row, a `rise` row for each event more severe than all before it in its episode, whose code
the episode takes over, and a `resolve` row once the gap has passed.

Rows with a NULL key or time take no part. A NULL or unknown severity is the lowest. Rows of one key and time count as one
with the most severe of them (then the first code), and all are counted in `n`. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import windows as W
from ..operators.stretches import Stretches

#: Severities from low to high, and codes whose episodes never end by themselves.
SEVERITIES = ("info", "warning", "critical", "emergency")
LASTING = ("SOS",)
#: What a row that belongs to no open episode, as it is older than the one that goes on, says.
LATE = "late"


def rank(severity: Column) -> Column:
    """The place of a severity, 0 for the lowest."""
    return F.coalesce(*(F.when(severity == s, F.lit(i)) for i, s in enumerate(SEVERITIES)), F.lit(0))


def changes(df: DataFrame, key: str, ts: str, code: str, severity: str, gap_s: float, lasting: tuple[str, ...] = LASTING, now: Column | None = None, chunk: float | None = None) -> DataFrame:
    """What happens to the episodes of a table: key, ts, reason, code, severity, n, start_ts.

    `now`: episodes whose gap hasn't passed by then have no resolve row; without it all have ended. With `chunk` seconds, a busy key's rows lie in many tasks.
    """
    gap = round(gap_s * 1e6)
    r = rank(F.col(severity))
    times = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("_key"), W.micros(ts).alias("us"), F.col(code).alias("code"), r.alias("rank"))
    times = times.groupBy("_key", "us").agg(F.min_by("code", F.struct(-F.col("rank"), "code")).alias("code"), F.max("rank").alias("rank"), F.count(F.lit(1)).alias("rows"))
    whole = Stretches(("_key",), chunk)
    begun = whole.scan(times, before={"_prev": F.col("us")}).withColumn("_new", F.col("_prev").isNull() | (F.col("us") - F.col("_prev") > gap))
    of = whole.scan(begun, total={"_episode": F.col("_new").cast("int")}, last={"_start": F.when(F.col("_new"), F.col("us"))}).drop("_prev")
    rows = Stretches(("_key", "_episode"), chunk).scan(of, total={"n": F.col("rows")}, top_before={"_top": F.col("rank")})
    rows = rows.withColumn("reason", F.when(F.col("_new"), "open").when(F.col("rank") > F.col("_top"), "rise")).where("reason is not null")
    ended = of.groupBy("_key", "_episode", "_start").agg((F.max("us") + gap).alias("us"), F.max_by("code", F.struct("rank", -F.col("us"))).alias("code"), F.max("rank").alias("rank"), F.sum("rows").alias("n"), F.min_by("code", "us").alias("_first"))
    over = ~F.coalesce(F.col("_first").isin(*lasting), F.lit(False)) if lasting else F.lit(True)
    over = over if now is None else over & (F.col("us") < F.unix_micros(now))
    both = rows.select("_key", "us", "reason", "code", "rank", "n", "_start").unionByName(ended.where(over).select("_key", "us", F.lit("resolve").alias("reason"), "code", "rank", "n", "_start"))
    return _told(both, key)


def changes_stream(stream: DataFrame, key: str, ts: str, code: str, severity: str, gap_s: float, watermark: str, lasting: tuple[str, ...] = LASTING) -> DataFrame:
    """The same rows as `changes`, as a stream in append mode.

    A key's open episode is its state. A timer in event time ends it when the watermark has passed the gap, whether or not the key has
    new rows. Rows behind the watermark are dropped and counted by Spark (numRowsDroppedByWatermark of the query's progress). A row ahead of it that
    is older than the key's open episode by more than the gap gives reason `late` and changes nothing.
    """
    gap, kind = round(gap_s * 1e6), stream.schema[key].dataType.simpleString()
    r = rank(F.col(severity))
    rows = stream.where(F.col(key).isNotNull()).withWatermark(ts, watermark).select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), W.micros(ts).alias("us"), F.col(code).alias("code"), r.alias("rank"))

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield _frame(_resolved(k[0], open_, gap))
            return
        batch = pd.concat(list(frames)).assign(down=lambda x: -x["rank"]).sort_values(["us", "down", "code"], kind="stable")
        out: list[tuple] = []
        for us, same in batch.groupby("us", sort=True):
            top, name, n = int(same["rank"].iloc[0]), same["code"].iloc[0], len(same)
            name = None if pd.isna(name) else name
            us = int(us)
            if open_ and us > open_[1] + gap:
                out += _resolved(k[0], open_, gap)
                open_ = None
            if open_ is None:
                open_ = (us, us, n, top, name, name in lasting)
                out.append((k[0], us, "open", name, top, n, us))
            elif us < open_[0] - gap:
                out.append((k[0], us, LATE, name, top, n, open_[0]))
            else:
                start, last, count, worst, named, stays = open_
                rose = top > worst
                open_ = (min(start, us), max(last, us), count + n, max(top, worst), name if rose else named, stays)
                if rose:
                    out.append((k[0], us, "rise", name, top, open_[2], open_[0]))
        state.update(open_)
        state.setTimeoutTimestamp(max((open_[1] + gap) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield _frame(out)

    told = rows.groupBy("_key").applyInPandasWithState(run, f"_key {kind}, us long, reason string, code string, rank int, n long, _start long", "start long, last long, n long, rank int, code string, lasting boolean", "append", GroupStateTimeout.EventTimeTimeout)
    return _told(told, key)


def _resolved(key, open_: tuple, gap: int) -> list[tuple]:
    start, last, n, worst, code, stays = open_
    return [] if stays else [(key, last + gap, "resolve", code, worst, n, start)]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["_key", "us", "reason", "code", "rank", "n", "_start"])


def _told(df: DataFrame, key: str) -> DataFrame:
    severity = F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("rank") + 1)
    return df.select(F.col("_key").alias(key), F.timestamp_micros("us").alias("ts"), "reason", "code", severity.alias("severity"), F.col("n").cast("long").alias("n"), F.timestamp_micros("_start").alias("start_ts"))
