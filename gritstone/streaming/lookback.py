"""All alert rules of a machine on a stream, those that look back over minutes included.

A stream has no windows over rows, so each machine keeps what they need: a list of the last six minutes of pressure, load and speed, the
idle run that goes on, and each rule's carry. The list is cut at every row, so it is as long as six minutes of rows; a timer
forgets machines that have been silent. Rows that come after later ones of their machine can't be taken in order any more: they raise nothing but a row that says so.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import windows as W
from . import rules
from .rules import GAP_S, IDLE_RPM, LOOK_S, PERIOD_S, RULES, Carry

#: What a row that is too late says.
LATE = "late"
SIGNALS = ["hydraulic_pressure_bar", "engine_load_pct", "ground_speed_kmh", "engine_rpm", "is_idle"]
#: Rules that need rows of minutes.
LOOKING = ("HYD_PRESSURE_DROP", "EXCESS_IDLE")


def use_state_store(spark: SparkSession) -> None:
    """Stateful processors keep their lists and timers in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def machine_alerts(telemetry: DataFrame, acks: DataFrame | None = None, forget_ms: int | None = 86_400_000) -> DataFrame:
    """Alert events of a telemetry stream: machine_id, rule, ts, reason, severity, stage; the same as `rules.alerts` tells of a table.

    acks (machine_id, ts, rule) may be a stream too. A micro-batch's rows are taken in time order, acknowledgements before readings of their
    time. A row older than the last one of its machine gives reason `late` and no more. Machines are forgotten after `forget_ms` of silence; None
    keeps them, for runs that end when their input does (with a timer pending, Spark goes on to make empty batches).
    """
    df = rules.with_optional(telemetry).withColumn("us", W.micros("ts"))
    plain = {n: r for n, r in RULES.items() if n not in LOOKING}
    told = F.array(*(F.struct(F.lit(n).alias("rule"), rules.PLAIN.get(r.get("kind"), rules.threshold)(r).alias("r")) for n, r in plain.items()))
    rows = df.select("machine_id", "ts", "us", *SIGNALS, F.lit(None).cast("string").alias("ack"), F.to_json(told).alias("told"))
    if acks is not None:
        none = [F.lit(None).cast(kind).alias(c) for c, kind in rows.dtypes if c in SIGNALS]
        rows = rows.unionByName(acks.select("machine_id", "ts", W.micros("ts").alias("us"), *none, F.col("rule").alias("ack"), F.lit(None).cast("string").alias("told")))
    return rows.groupBy("machine_id").transformWithStateInPandas(_Machine(forget_ms), rules.EVENTS, "Append", "None" if forget_ms is None else "ProcessingTime")


def _mean(values: list) -> float | None:
    known = [v for v in values if v is not None]
    return sum(known) / len(known) if known else None


class _Machine(StatefulProcessor):
    def __init__(self, forget_ms: int | None) -> None:
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "us long, pressure double, load double, speed double")
        self.kept = handle.getValueState("kept", "json string, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self.kept.get() if self.kept.exists() else None
        now = timerValues.getCurrentProcessingTimeInMs()
        timer = kept[1] if kept else None
        if timer is not None:
            self.handle.deleteTimer(timer)
            if timer <= now:  # rows have come in the batch in which the machine would have been forgotten
                kept = None
                self.recent.clear()
        state = json.loads(kept[0]) if kept else {"last": None, "idle": None, "carries": {}}
        carries = {n: Carry(**c) for n, c in state["carries"].items()}
        recent = [tuple(r) for r in self.recent.get()]
        batch = pd.concat(list(rows))
        batch = batch.assign(reading=batch["ack"].isna()).sort_values(["us", "reading"], kind="stable")
        out: list[tuple] = []
        for r in batch.itertuples(index=False):
            if state["last"] is not None and r.us < state["last"]:
                out.append((key[0], None, r.ts, LATE, None, None))
                continue
            if not r.reading:
                carries.setdefault(r.ack, Carry()).take(r.ack, r.us, [rules.ACK], False, None, None)
                continue
            recent = [x for x in recent if x[0] > r.us - LOOK_S * 1e6] + [(r.us, *map(rules._number, (r.hydraulic_pressure_bar, r.engine_load_pct, r.ground_speed_kmh)))]
            for rule, levels, clear, value, base in [*self.plain(r), self.drop(r.us, recent), self.idle(r, state)]:
                out += [(key[0], rule, r.ts, *e) for e in carries.setdefault(rule, Carry()).take(rule, r.us, levels, clear, value, base)]
            state["last"] = r.us
        self.recent.put(recent)
        timer = None if self.forget_ms is None else now + self.forget_ms
        if timer is not None:
            self.handle.registerTimer(timer)
        self.kept.update((json.dumps({**state, "carries": {n: asdict(c) for n, c in carries.items()}}), timer))
        yield pd.DataFrame(out, columns=rules._COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        self.kept.clear()
        yield pd.DataFrame([], columns=rules._COLUMNS)

    def close(self) -> None:
        pass

    def plain(self, r) -> Iterator[tuple]:
        """Rules that the row alone decides."""
        for x in json.loads(r.told):
            yield x["rule"], x["r"]["levels"], x["r"]["clear"], x["r"].get("value"), None

    def drop(self, us: int, recent: list[tuple]) -> tuple:
        """The means that a pressure drop compares; the carry keeps the latch."""
        since = lambda seconds: [x for x in recent if x[0] > us - seconds * 1e6]
        now, before = _mean([x[1] for x in since(120)]), _mean([x[1] for x in recent if x[0] <= us - 180_000_000])
        still = _mean([x[3] for x in since(180)])
        loaded = min(x[2] or 0.0 for x in recent) > 40 and us - recent[0][0] >= 300_000_000
        found = loaded and None not in (now, before, still) and before > 100 and now < 0.65 * before and still < 2
        return "HYD_PRESSURE_DROP", ["critical"] if found else [], False, now, before

    def idle(self, r, state: dict) -> tuple:
        """The idle run that goes on: its begin, the sum of its rpm and its rows."""
        rpm = rules._number(r.engine_rpm)
        idle = r.is_idle is not None and r.is_idle == True and rpm is not None  # noqa: E712  pandas' missing values are no booleans
        if not idle:
            state["idle"] = None
            return "EXCESS_IDLE", [], True, None, None
        if state["idle"] is None or r.us - state["last"] > GAP_S * 1e6:
            state["idle"] = [r.us, 0.0, 0]
        run = state["idle"]
        run[1], run[2] = run[1] + rpm, run[2] + 1
        seconds, mean = (r.us - run[0]) / 1e6 + PERIOD_S, run[1] / run[2]
        levels = [n for n, (over, _) in RULES["EXCESS_IDLE"]["levels"].items() if mean > IDLE_RPM and seconds > over]
        return "EXCESS_IDLE", levels, mean < IDLE_RPM * (1 - rules.BAND), seconds, None
