"""Alert rules on telemetry: levels, episodes and stages as columns; a carry a key for streams.

What a rule sees in a row (which levels hold, whether the signal is back inside its band, the
watched value) needs no memory. What needs some is said by windows over a key's rows: how long a level
has held is the age of a run, an alert is an episode from a first active row to a first calm one, the time spent critical is a
running sum, and each stage begins at the first row that meets its condition. The latch of a
pressure drop depends on its own past: a stretch of rows is reduced to what becomes of each pressure that it may begin with, and stretches are put together.

A stream has no windows over rows, so there each key carries the same quantities from batch to batch
(`Carry`); keys that have been silent for long are forgotten.

A key's rows are in one window partition, sorted and spilled by Spark; all keys run side by side. With `chunk`
seconds, a busy key's rows lie in stretches of time: what looks back over minutes gets copies of the rows before, and running values are put together from stretches.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.predicates import is_false
from ..operators import asof
from ..operators import windows as W
from ..operators.stretches import Stretches
from ..sources.shared import written_once

GAP_S, BAND, CLEAR_S, PERIOD_S = 120.0, 0.05, 120.0, 60.0
RANK = {"info": 0, "warning": 1, "critical": 2, "emergency": 3}
SEVERITIES = list(RANK)
STAGES = ["warn", "derate", "recommend_shutdown", "escalated"]
#: Minutes of values that an alert looks back on.
HISTORY_S = 720.0
#: Seconds of critical time at which the graded stages begin, and of the two short cuts.
DERATE_S, SHUTDOWN_S, ESCALATE_S, RISING_S, IGNORED_S = 120.0, 300.0, 420.0, 60.0, 120.0

#: The rules. levels: severity -> (limit, seconds that it must hold).
RULES: dict[str, dict] = {
    "COOLANT_HIGH": {"signal": "coolant_temp_c", "levels": {"warning": (100.0, 120.0)}, "response": "none"},
    "COOLANT_CRITICAL": {"signal": "coolant_temp_c", "levels": {"critical": (105.0, 0.0)}, "response": "graded", "rising": (3.0, 180.0)},
    "HYD_OIL_HIGH": {"signal": "hydraulic_oil_temp_c", "levels": {"warning": (90.0, 0.0), "critical": (95.0, 0.0)}, "response": "graded", "rising": (3.0, 180.0)},
    "OIL_PRESSURE_LOW": {"signal": "oil_pressure_kpa", "below": True, "gate": ("engine_rpm", 1200.0), "levels": {"critical": (100.0, 0.0)}, "response": "graded"},
    "BATTERY_LOW": {"signal": "battery_voltage", "below": True, "levels": {"warning": (24.0, 300.0)}, "response": "none"},
    "HYD_PRESSURE_DROP": {"kind": "drop", "levels": {"critical": (0.65, 0.0)}, "response": "graded", "below": True},
    "SEATBELT": {"kind": "seatbelt", "levels": {"warning": (20.0, 5.0), "critical": (20.0, 30.0)}, "response": "escalate", "escalate_s": 120.0},
    "TIP_RISK": {"kind": "tilt", "levels": {"warning": (15.0, 0.0), "critical": (25.0, 0.0)}, "response": "escalate", "escalate_s": 120.0},
    "EXCESS_IDLE": {"kind": "idle", "levels": {"info": (600.0, 0.0), "warning": (1200.0, 0.0)}, "response": "none"},
    "OVERSPEED": {"kind": "speed", "levels": {"warning": (0.0, 0.0)}, "response": "none"},
}
#: Fault codes and their severities; unknown codes are warnings. What a model's verdict opens.
CODES = {"E-110": "warning", "E-215": "warning", "E-360": "warning", "E-365": "warning", "E-410": "warning", "E-520": "info"}
VERDICTS = {"UNUSUAL_BEHAVIOUR": ("machine_fault", "warning"), "SENSOR_GLITCH": ("sensor_glitch", "info")}
ACK = "acknowledged"
SPEED_LIMIT = {"excavator": 5.5, "wheel_loader": 20.0, "dozer": 10.0, "articulated_truck": 40.0}
MOVING_KMH, IDLE_RPM = 0.5, 1200.0


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _reading(levels: dict[str, Column], clear: Column, value: Column) -> Column:
    on = F.filter(F.array(*(F.when(_false(c), F.lit(n)) for n, c in levels.items())), lambda x: x.isNotNull())
    return F.struct(on.alias("levels"), _false(clear).alias("clear"), value.cast("double").alias("value"))


def threshold(rule: dict) -> Column:
    """Beyond a limit in the bad direction; clear once 5 % inside the mildest limit."""
    x, limits = F.col(rule["signal"]), [limit for limit, _ in rule["levels"].values()]
    below = rule.get("below", False)
    gate = _false(F.col(rule["gate"][0]) > rule["gate"][1]) if "gate" in rule else F.lit(True)
    levels = {n: ((x < limit) if below else (x > limit)) & gate for n, (limit, _) in rule["levels"].items()}
    return _reading(levels, x > max(limits) * (1 + BAND) if below else x < min(limits) * (1 - BAND), x)


def tilt(rule: dict) -> Column:
    x = F.greatest(F.abs("pitch_deg"), F.abs("roll_deg"))
    return _reading({n: x > limit for n, (limit, _) in rule["levels"].items()}, x < min(v[0] for v in rule["levels"].values()) * (1 - BAND), x)


def seatbelt(rule: dict) -> Column:
    speed, load = F.coalesce("ground_speed_kmh", F.lit(0.0)), F.coalesce("engine_load_pct", F.lit(0.0))
    limit = rule["levels"]["warning"][0]
    open_ = is_false(F.col("seatbelt_fastened")) & ((speed > MOVING_KMH) | (load > limit))
    still = (speed < MOVING_KMH * (1 - BAND)) & (load < limit * (1 - BAND))
    return _reading(dict.fromkeys(rule["levels"], open_), _false(F.col("seatbelt_fastened")) | still, F.lit(None))


def speed(rule: dict) -> Column:
    """Over the limit of a zone if one holds (zone_limit), else of the machine type."""
    table = F.create_map(*(F.lit(x) for kv in SPEED_LIMIT.items() for x in kv))
    x, limit = F.col("ground_speed_kmh"), F.least(F.col("zone_limit"), table[F.col("machine_type")])
    return _reading({"warning": x > limit}, x.isNull() | limit.isNull() | (x < limit * (1 - BAND)), x)


#: Seconds that the windows of a reading look back.
LOOK_S = 360.0


def readings(telemetry: DataFrame, since: datetime | None = None, chunk: float | None = None) -> DataFrame:
    """machine_id, ts, us, rule, levels, clear, value: a row for each rule and telemetry row.

    Optional columns: machine_type, zone_limit. The rules that look back use windows
    of minutes over the machine's rows, which share one shuffle. Rows before `since` warm these windows up and raise nothing.
    """
    df = _looked_back(with_optional(telemetry).withColumn("us", W.micros("ts")), chunk)
    found = _false((F.col("_before") > 100) & (F.col("_recent") < 0.65 * F.col("_before")) & F.col("_loaded") & F.col("_still"))
    fast = F.col("_idle") & (F.col("_rpm") > IDLE_RPM)
    special = {
        # the value of a drop carries what a latch needs: the mean now, and before where a drop is found
        "drop": lambda r: F.struct(F.when(found, F.array(F.lit("critical"))).otherwise(F.array().cast("array<string>")).alias("levels"), F.lit(False).alias("clear"), F.col("_recent").alias("value")),
        "idle": lambda r: _reading({n: fast & (F.col("_run") > over) for n, (over, _) in r["levels"].items()}, ~F.col("_idle") | (F.col("_rpm") < IDLE_RPM * (1 - BAND)), F.col("_run")),
    }
    items = [F.struct(F.lit(name).alias("rule"), special.get(rule.get("kind"), PLAIN.get(rule.get("kind"), threshold))(rule).alias("r")) for name, rule in RULES.items()]
    df = df if since is None else df.where(F.col("ts") >= F.lit(since))
    rows = df.select("machine_id", "ts", "us", F.col("_before").alias("base"), F.explode(F.array(*items)).alias("x"))
    return rows.select("machine_id", "ts", "us", "x.rule", "x.r.levels", "x.r.clear", "x.r.value", F.when(F.col("x.rule") == "HYD_PRESSURE_DROP", F.col("base")).alias("base"))


def with_optional(telemetry: DataFrame) -> DataFrame:
    """Telemetry with the optional columns, null where it has none."""
    missing = {n: F.lit(None).cast(kind) for n, kind in (("machine_type", "string"), ("zone_limit", "double")) if n not in telemetry.columns}
    return telemetry.withColumns(missing)


#: Kinds of rules that a row alone decides; those without a kind are thresholds.
PLAIN = {"tilt": tilt, "seatbelt": seatbelt, "speed": speed}


def _looked_back(df: DataFrame, chunk: float | None) -> DataFrame:
    """Adds the pressures of a drop, load and speed over minutes, and length and mean rpm of an idle run."""
    pressure = F.col("hydraulic_pressure_bar")
    df = df.withColumn("_idle", _false(F.col("is_idle")) & F.col("engine_rpm").isNotNull())

    def minutes(rows: DataFrame, keys: list[str]) -> DataFrame:
        m = lambda n: W.trailing(keys, 60 * n)
        earlier = W.by(keys).rangeBetween(-round(LOOK_S * 1e6) + 1, -180_000_000)
        covered = F.col("us") - F.min("us").over(m(6)) >= 300_000_000
        before = F.lag(F.struct("us", "_idle")).over(W.by(keys))
        goes_on = _false((before["us"] >= F.col("us") - round(GAP_S * 1e6)) & before["_idle"])
        return rows.withColumns({"_recent": F.avg(pressure).over(m(2)), "_before": F.avg(pressure).over(earlier), "_loaded": (F.min(F.coalesce("engine_load_pct", F.lit(0.0))).over(m(6)) > 40) & covered, "_still": F.avg("ground_speed_kmh").over(m(3)) < 2, "_starts": F.col("_idle") & ~goes_on})

    if chunk is None and not df.isStreaming:
        df = dealt(df, ["machine_id"], df.count())
    df = minutes(df, ["machine_id"]) if chunk is None else W.chunked(df, "machine_id", LOOK_S, chunk, minutes)
    df = Stretches(("machine_id",), chunk).scan(df, last={"_since": F.when(F.col("_starts"), F.col("us"))})
    run = Stretches(("machine_id", "_since"), chunk).scan(df, total={"_rpm_sum": F.when(F.col("_idle"), F.col("engine_rpm")), "_rpm_n": F.col("_idle").cast("int")})
    idle = F.col("_idle")
    return run.withColumns({"_rpm": F.when(idle, F.col("_rpm_sum") / F.col("_rpm_n")), "_run": F.when(idle, (F.col("us") - F.col("_since")) / 1e6 + PERIOD_S)})


def code_readings(telemetry: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """A row for each fault code and telemetry row: present or not. Without a list, which a stream needs, the codes that a machine shows."""
    df = telemetry.select("machine_id", "ts", W.micros("ts").alias("us"), "fault_code")
    if codes is not None:
        rows = df.withColumn("code", F.explode(F.array(*map(F.lit, codes))))
    elif df.isStreaming:
        raise ValueError("a stream needs the list of codes: which of them will come is not known")
    else:
        rows = df.join(df.where("fault_code is not null").select("machine_id", F.col("fault_code").alias("code")).distinct(), "machine_id")
    severity = F.coalesce(F.create_map(*(F.lit(x) for kv in CODES.items() for x in kv))[F.col("code")], F.lit("warning"))
    here = _false(F.col("fault_code") == F.col("code"))
    return _plain(rows, F.concat(F.lit("FAULT_CODE:"), F.col("code")), F.when(here, F.array(severity)), ~here, F.lit(None))


def verdict_readings(verdicts: DataFrame) -> DataFrame:
    """A row for each kind of alert and minute of a model's output (machine_id, ts, kind, score)."""
    kinds = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(k).alias("on"), F.lit(s).alias("severity")) for n, (k, s) in VERDICTS.items())))
    rows = verdicts.withColumns({"us": W.micros("ts"), "v": kinds})
    here = _false(F.col("kind") == F.col("v.on"))
    return _plain(rows, F.col("v.rule"), F.when(here, F.array(F.col("v.severity"))), ~here, F.col("score"))


def acknowledgements(acks: DataFrame) -> DataFrame:
    """Acknowledged alerts (machine_id, ts, rule) as rows of the same stream."""
    return _plain(acks.withColumn("us", W.micros("ts")), F.col("rule"), F.array(F.lit(ACK)), F.lit(False), F.lit(None))


def _plain(df: DataFrame, rule: Column, levels: Column, clear: Column, value: Column) -> DataFrame:
    none = F.array().cast("array<string>")
    return df.select("machine_id", "ts", "us", rule.alias("rule"), F.coalesce(levels, none).alias("levels"), clear.alias("clear"), value.cast("double").alias("value"), F.lit(None).cast("double").alias("base"))


def _hold(name: str, level: str) -> float:
    """Seconds that a level must hold; fault codes and verdicts hold at once."""
    return RULES[name]["levels"].get(level, (0.0, 0.0))[1] if name in RULES else 0.0


def _response(name: str) -> str:
    return RULES[name]["response"] if name in RULES else "none" if name in VERDICTS else "graded"


def _by_rule(value, default) -> Column:
    """A rule's own value as a column."""
    items = {name: value(name) for name in [*RULES, *VERDICTS]}
    return F.coalesce(F.create_map(*(F.lit(x) for kv in items.items() for x in kv))[F.col("rule")], F.lit(default))


EVENTS = "machine_id string, rule string, ts timestamp, reason string, severity string, stage string"
KEY = ["machine_id", "rule"]
_COLUMNS = ["machine_id", "rule", "ts", "reason", "severity", "stage"]


#: How far back a row's levels and calm can depend on other rows: the longest hold, the clear band's, and the rows at their ends.
REACH_S = max(hold for r in RULES.values() for _, hold in r["levels"].values()) + CLEAR_S + 4 * GAP_S


def alerts(found: DataFrame, chunk: float | None = None) -> DataFrame:
    """Alert events of a table of readings and acknowledgements: machine_id, rule, ts, reason, severity, stage.

    With `chunk` seconds (at least HISTORY_S) no task holds all rows of a machine and rule. An acknowledgement counts
    from its time on, if the alert has opened before it.
    """
    acked = F.array_contains("levels", ACK)
    found = written_once(found, "readings")  # read for its count, for drops, for other rules and for acknowledgements
    n = found.count()
    rows = _episodes(_active(_latched(found.where(~acked), chunk, n), chunk, n), chunk)
    rows = rows if chunk is None else written_once(rows, "episodes")
    return _told(_staged(rows, found.where(acked).select(*KEY, F.col("us").alias("ack_us")), chunk))


#: Rows of a task, about: whole keys lie in as many tasks as that takes.
TASK_ROWS = 250_000


def dealt(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Whole keys over as many tasks as `rows` rows take, so that a task's share doesn't grow with the table."""
    return df.repartition(max(1, -(-rows // TASK_ROWS)), *keys)


def _latched(found: DataFrame, chunk: float | None, n: int) -> DataFrame:
    """Levels and clear of a pressure drop follow the pressure before it, which is kept until the pressure is back."""
    drop, place = F.col("rule") == "HYD_PRESSURE_DROP", ["machine_id", "_stretch"]
    size, columns = round(chunk * 1e6) if chunk else 1 << 62, found.columns
    rows = found.where(drop).withColumn("_stretch", F.floor(F.col("us") / size))
    begins = F.lit(None).cast("double")
    if chunk:
        left = rows.repartition(*place).sortWithinPartitions(*place, "us").mapInPandas(_transitions, "machine_id string, _stretch long, free double, marks array<double>, exits array<double>")
        held = left.repartition("machine_id").sortWithinPartitions(*place).mapInPandas(_composed, "machine_id string, _stretch long, _held double")  # a row a stretch
        rows = rows.join(held, place, "left")
    else:
        rows = rows.withColumn("_held", begins)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, None
        for b in batches:
            out = []
            for k, levels, value, base, start in zip(zip(b.machine_id, b._stretch, strict=True), b.levels, b.value, b.base, b._held, strict=True):
                key, held = (key, held) if k == key else (k, _number(start))
                held, levels, clear = _latch(held, len(levels) > 0, _number(value), _number(base))
                out.append((levels, clear))
            yield b.assign(levels=[x for x, _ in out], clear=[x for _, x in out])[columns]

    kept = dealt(rows, place, n).sortWithinPartitions(*place, "us").mapInPandas(run, found.schema)
    return found.where(~drop).unionByName(kept)


def _latch(held: float | None, found: bool, value: float | None, base: float | None) -> tuple[float | None, list[str], bool]:
    """The pressure before a drop (None: no drop), and the levels and clear flag that follow from it."""
    held = base if found and held is None else held
    if held is None or value is None:
        return held, [], held is None
    back = value >= _back(held)
    return (None if back else held), (["critical"] if value < 0.65 * held else []), back


def _back(held: float) -> float:
    """The pressure at which a drop from `held` is over."""
    return 0.65 * (1 + BAND) * held


def _transitions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a stretch: what it leaves if it begins without a drop, and, for each new highest value in it, what it leaves if that value ends the drop it began with."""
    for key, rows in _groups(batches, ["machine_id", "_stretch"], ["levels", "value", "base"]):
        marks, exits, top = [], [], float("-inf")
        drops = [i for i, r in enumerate(rows) if len(r[0]) and _number(r[2]) is not None]
        seen: dict[int, float | None] = {}
        for i, r in enumerate(rows):
            v = _number(r[1])
            if v is not None and v > top:
                top = v
                marks.append(v)
                exits.append(_left(rows, drops, i + 1, seen))
        yield pd.DataFrame({"machine_id": [key[0]], "_stretch": [key[1]], "free": [_left(rows, drops, 0, seen)], "marks": [marks], "exits": [exits]})


def _left(rows: list, drops: list[int], start: int, seen: dict[int, float | None]) -> float | None:
    """The pressure that is still held at the end of a stretch, if nothing is held at row `start`. `seen` knows it for drops that were met before."""
    path, held = [], None
    while (at := bisect_left(drops, start)) < len(drops):
        i = drops[at]
        if i in seen:
            held = seen[i]
            break
        path.append(i)
        base = float(rows[i][2])
        end = next((j for j in range(i, len(rows)) if (v := _number(rows[j][1])) is not None and v >= _back(base)), None)
        if end is None:
            held = base
            break
        start = end + 1
    seen.update(dict.fromkeys(path, held))
    return held


def _composed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pressure that is held where each stretch begins, from the transitions of the stretches before it."""
    machine, held = None, None
    for b in batches:
        out = []
        for m, free, marks, exits in zip(b.machine_id, b.free, b.marks, b.exits, strict=True):
            held = held if m == machine else None
            machine = m
            out.append(held)
            if held is None:
                held = _number(free)
            elif (at := next((i for i, x in enumerate(marks) if x >= _back(held)), None)) is not None:
                held = _number(exits[at])
        yield pd.DataFrame({"machine_id": b.machine_id, "_stretch": b._stretch, "_held": pd.Series(out, dtype="float64")})


def _groups(batches: Iterator[pd.DataFrame], keys: list[str], columns: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of equal keys in sorted rows, across batches."""
    key, rows = None, []
    for b in batches:
        for k, r in zip(zip(*(b[c] for c in keys), strict=True), zip(*(b[c] for c in columns), strict=True), strict=True):
            if k != key and rows:
                yield key, rows
                rows = []
            key = k
            rows.append(r)
    if rows:
        yield key, rows


def _active(found: DataFrame, chunk: float | None, n: int) -> DataFrame:
    """Rows that an alert acts on, with sign: active (rank: the highest level that has held long enough) or calm (the clear band has held so).

    crit_step: seconds since the row before, if both are critical and no gap is between them.
    """

    def compute(df: DataFrame, keys: list[str]) -> DataFrame:
        df, w = dealt(df, keys, n), W.by(keys)
        begins = w.rowsBetween(W.Window.unboundedPreceding, 0)
        age = lambda on, was: F.when(on, (F.col("us") - F.last(F.when(on & ~(F.col("step").isNotNull() & _false(was)), F.col("us")), True).over(begins)) / 1e6)
        df = df.withColumn("_p", F.lag(F.struct("us", "levels")).over(w))
        seconds = (F.col("us") - F.col("_p.us")) / 1e6
        df = df.withColumn("step", F.when((seconds > 0) & (seconds <= GAP_S), seconds))
        held = [F.when(age(F.array_contains("levels", n), F.array_contains("_p.levels", n)) + PERIOD_S >= _by_rule(lambda rule, n=n: _hold(rule, n), 0.0), F.lit(r)) for n, r in RANK.items()]
        df = df.withColumn("rank", F.greatest(*held)).withColumn("_q", F.col("rank").isNull() & F.col("clear"))
        df = df.withColumn("_o", F.lag(F.struct("rank", "_q")).over(w))
        calm = _false(age(F.col("_q"), F.col("_o._q")) + PERIOD_S >= CLEAR_S)
        both = (F.col("rank") == RANK["critical"]) & (F.col("_o.rank") == RANK["critical"])
        return df.withColumns({"sign": F.when(F.col("rank").isNotNull(), "active").when(calm, "calm"), "crit_step": F.when(both, F.col("step"))}).drop("_p", "_o", "_q", "step")

    rows = compute(found, KEY) if chunk is None else W.chunked(found, KEY, REACH_S, chunk, compute)
    return rows.where("sign is not null")


def _episodes(df: DataFrame, chunk: float | None) -> DataFrame:
    """Names the alerts of a key by when they open; keeps their active rows and the calm row that ends each."""
    over = Stretches(tuple(KEY), chunk)
    df = over.scan(df, before={"before": F.col("sign")})
    opens, ends = (F.col("sign") == "active") & ~_false(F.col("before") == "active"), (F.col("sign") == "calm") & _false(F.col("before") == "active")
    kept = df.withColumns({"opens": opens, "ends": ends}).where((F.col("sign") == "active") | F.col("ends"))
    return over.scan(kept, last={"episode": F.when(F.col("opens"), F.col("us"))}).drop("before", "sign")


def _staged(df: DataFrame, acks: DataFrame, chunk: float | None) -> DataFrame:
    """Adds top (the episode's highest rank so far), top_before, and the times at which the stages begin."""
    own = [*KEY, "episode"]
    critical = F.col("rank") == RANK["critical"]
    response, delta = _by_rule(_response, "graded"), _by_rule(lambda n: RULES.get(n, {}).get("rising", (None, 0.0))[0], None)

    def rising(rows: DataFrame, keys: list[str]) -> DataFrame:
        earlier = F.last(F.when(F.col("rank").isNotNull(), F.col("value")), True).over(W.by(keys).rangeBetween(-round(HISTORY_S * 1e6), -180_000_000))
        return rows.withColumn("rising", _false(F.col("value") - earlier >= delta))

    df = rising(df, own) if chunk is None else W.chunked(df, own, HISTORY_S + 1, chunk, rising)
    df = Stretches(tuple(own), chunk).scan(df, total={"spent": F.coalesce("crit_step", F.lit(0.0))}, top={"top": F.col("rank")}, top_before={"top_before": F.col("rank")})
    df = df.withColumn("graded", response == "graded")
    # acknowledgements go to the last alert that has opened before them, if it is still open, and count from their time on
    key = F.struct(*KEY).alias("_k")
    spans = df.groupBy(*own).agg(F.max("us").alias("to_us")).select(key, "episode", "to_us", F.timestamp_micros("episode").alias("_from"))
    met = asof.asof_join(acks.select(key, "ack_us", F.timestamp_micros("ack_us").alias("_at")), spans, "_k", "_at", "_from", ["episode", "to_us"], exact=False, chunk=chunk)
    first_ack = met.where("ack_us <= to_us").groupBy("_k.machine_id", "_k.rule", "episode").agg(F.min("ack_us").alias("ack_us"))
    df = df.join(first_ack, own, "left")
    after = lambda stage, seconds: F.col("us") >= F.col(stage) + round(seconds * 1e6)
    spent, graded = F.col("spent"), F.col("graded")

    def begins(rows: DataFrame, stage: str, cond: Column) -> DataFrame:
        """The first critical row of the episode that meets the condition."""
        at = F.min(F.when(critical & cond, F.col("us")))
        if chunk is None:
            return rows.withColumn(stage, at.over(W.Window.partitionBy(*own)))
        return rows.join(rows.groupBy(*own).agg(at.alias(stage)), own)

    df = begins(df, "derate", graded & (spent >= DERATE_S))
    df = begins(df, "recommend_shutdown", graded & ((spent >= SHUTDOWN_S) | after("derate", RISING_S) & F.col("rising")))
    ignored = after("recommend_shutdown", IGNORED_S) & ~_false(F.col("ack_us") <= F.col("us"))
    alone = (response == "escalate") & (spent >= _by_rule(lambda n: RULES.get(n, {}).get("escalate_s", float("inf")), float("inf")))
    return begins(df, "escalated", alone | graded & ((spent >= ESCALATE_S) | _false(ignored)))


def _told(df: DataFrame) -> DataFrame:
    """Rows at which something changes, as events."""
    named = lambda rank: F.element_at(F.array(*map(F.lit, SEVERITIES)), rank + 1)
    rises = ~F.col("opens") & _false(F.col("top") > F.col("top_before"))
    before = F.lit("warn")
    for stage in STAGES[1:]:
        before = F.when(F.col(stage) < F.col("us"), stage).otherwise(before)
    event = lambda cond, reason, stage: F.when(cond, F.struct(F.lit(reason).alias("reason"), named(F.col("top")).alias("severity"), stage.alias("stage")))
    told = [event(F.col("opens"), "open", F.lit("warn")), event(rises, "severity", before), *(event(F.col(s) == F.col("us"), "stage", F.lit(s)) for s in STAGES[1:]), event(F.col("ends"), "resolve", F.lit("resolved"))]
    changes = df.withColumn("told", F.filter(F.array(*told), lambda x: x.isNotNull())).where(F.size("told") > 0)
    return changes.select(*KEY, "ts", F.explode("told").alias("e")).select(*KEY, "ts", "e.*")


def _number(x) -> float | None:
    return None if x is None or x != x else float(x)


@dataclass
class Carry:
    """What a key of a stream takes from row to row. Times are microseconds."""

    us: int | None = None
    ran: bool = False  # the row before was critical
    runs: dict[str, int] = field(default_factory=dict)  # begin of each level's run, and of the clear band's
    top: int | None = None  # of the open alert
    spent: float = 0.0
    marks: dict[str, int] = field(default_factory=dict)  # stages and when they began
    values: list = field(default_factory=list)  # (time, value) of the last minutes
    acked: bool = False
    latch: float | None = None

    def take(self, rule: str, us: int, levels: list[str], clear: bool, value: float | None, base: float | None) -> list[tuple[str, str, str]]:
        """Takes one row; what changed, as (reason, severity, stage)."""
        if ACK in levels:
            self.acked = self.top is not None
            return []
        step = (us - self.us) / 1e6 if self.us is not None and 0 < us - self.us <= GAP_S * 1e6 else None
        self.us = us
        if rule == "HYD_PRESSURE_DROP":
            self.latch, levels, clear = _latch(self.latch, bool(levels), value, base)
        old = self.runs if step else {}
        self.runs = {n: old.get(n, us) for n in levels}
        age = lambda n: (us - self.runs[n]) / 1e6 + PERIOD_S
        rank = max((RANK[n] for n in levels if age(n) >= _hold(rule, n)), default=None)
        if rank is None and clear:
            self.runs["clear"] = old.get("clear", us)
        critical = rank == RANK["critical"]
        ran, self.ran = self.ran, critical
        if rank is None:
            if self.top is None or not clear or age("clear") < CLEAR_S:
                return []
            severity = SEVERITIES[self.top]
            self.top, self.spent, self.marks, self.values, self.acked = None, 0.0, {}, [], False
            return [("resolve", severity, "resolved")]
        told = [] if self.top is not None and rank <= self.top else [("open" if self.top is None else "severity", SEVERITIES[rank], max(self.marks, key=STAGES.index, default="warn"))]
        self.top = max(rank, -1 if self.top is None else self.top)
        self.values = [(t, v) for t, v in self.values if t >= us - HISTORY_S * 1e6] + ([(us, value)] if value is not None else [])
        if critical:
            self.spent += step if step and ran else 0.0
            new = [s for s in STAGES[1:] if s not in self.marks and self._due(s, rule, us, value)]
            self.marks |= dict.fromkeys(new, us)
            told += [("stage", SEVERITIES[self.top], s) for s in new]
        return told

    def _due(self, stage: str, rule: str, us: int, value: float | None) -> bool:
        since = lambda s: (us - self.marks[s]) / 1e6 if s in self.marks else -1.0
        if _response(rule) != "graded":
            return stage == "escalated" and _response(rule) == "escalate" and self.spent >= RULES[rule]["escalate_s"]
        if stage == "derate":
            return self.spent >= DERATE_S
        if stage == "recommend_shutdown":
            delta = RULES.get(rule, {}).get("rising", (None, 0.0))[0]
            before = next((v for t, v in reversed(self.values) if t <= us - 180_000_000), None)
            return self.spent >= SHUTDOWN_S or since("derate") >= RISING_S and None not in (delta, before, value) and value - before >= delta
        return self.spent >= ESCALATE_S or since("recommend_shutdown") >= IGNORED_S and not self.acked


def alerts_stream(found: DataFrame, forget_ms: int = 86_400_000) -> DataFrame:
    """Alert events of a stream of readings; each key's carry is kept between micro-batches, and forgotten after a day of silence.

    A micro-batch's rows are taken in time order, acknowledgements before readings of their time. The rules that look back over
    windows need their columns from the source, as a stream has no windows over rows.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        carry = Carry(**json.loads(state.get[0])) if state.exists else Carry()
        rows = pd.concat(list(frames))
        rows = rows.assign(later=[ACK not in x for x in rows.levels]).sort_values(["us", "later"], kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            out += [(*key, r.ts, *e) for e in carry.take(key[1], r.us, list(r.levels), r.clear, _number(r.value), _number(r.base))]
        state.update((json.dumps(asdict(carry)),))
        state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame(out, columns=_COLUMNS)

    return found.groupBy(*KEY).applyInPandasWithState(run, EVENTS, "carry string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def newest_alert(events: DataFrame) -> DataFrame:
    """The last event of each machine and rule: what a feed shows."""
    return events.groupBy("machine_id", "rule").agg(F.max_by(F.struct("ts", "reason", "severity", "stage"), "ts").alias("e")).select("machine_id", "rule", "e.*")
