"""Distances, zones and fatigue signs from detections, for tables and streams.

What a frame alone tells is a column expression; trailing counts and shares are windows, and so are
zones, which are left later than they are entered. Posts that keep a distance in time from the last
one depend on themselves; they are found by following each row's successor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import windows as W
from ..operators.islands import hold_trigger, latched, runs
from ..operators.stretches import spaced

#: Heights in metres, zone limits, slack on leaving, closing speed, repeat of a red post, life of a track.
HEIGHT_M = {"person": 1.7, "car": 1.5, "truck": 3.0}
RED_M, ORANGE_M, WIDER_M, SLACK_M = 3.0, 7.0, 2.0, 0.3
CLOSING_MPS, CLOSING_S, LEAST_SPAN_S, REPEAT_S, LIFE_S = 0.5, 1.0, 0.7, 2.0, 2.0
LEVELS = ["info", "warning", "critical"]


def distance(height_px: Column, kind: Column, focal_px: Column, ultrasonic: Column) -> Column:
    """Pinhole distance of an object of known height, and the ultrasonic reading if that is nearer."""
    known = F.coalesce(F.create_map(*(F.lit(x) for kv in HEIGHT_M.items() for x in kv))[kind], F.lit(HEIGHT_M["person"]))
    camera = F.when(height_px > 0, known * focal_px / height_px).otherwise(F.lit(float("inf")))
    return F.when(ultrasonic > 0, F.least(camera, ultrasonic)).otherwise(camera)


def closing(df: DataFrame, track: str) -> DataFrame:
    """Adds closing_mps over about a second (NULL with too short a history) and approaching; needs `us` and `distance_m`.

    The sample at or just before the window's start counts as its first.
    """
    w = W.by(track)
    inside = F.min("us").over(w.rangeBetween(-round(CLOSING_S * 1e6) + 1, 0))
    before = w.rangeBetween(W.Window.unboundedPreceding, -round(CLOSING_S * 1e6))
    old_us, old_d = F.coalesce(F.last("us").over(before), inside), F.coalesce(F.last("distance_m").over(before), F.first("distance_m").over(w.rangeBetween(-round(CLOSING_S * 1e6) + 1, 0)))
    span = (F.col("us") - old_us) / 1e6
    speed = F.when(span >= LEAST_SPAN_S, (old_d - F.col("distance_m")) / span)
    return df.withColumn("closing_mps", speed).withColumn("approaching", F.coalesce(F.col("closing_mps") > CLOSING_MPS, F.lit(False)))


#: Zones from the innermost: name, limit, whether the limit itself is inside, and the severity's place in LEVELS.
ZONES = (("red", RED_M, False, 2), ("orange", ORANGE_M, True, 1))


def zones(df: DataFrame, track: str) -> DataFrame:
    """Adds zone, severity and post to detections (us, distance_m, approaching, wide).

    A zone is entered at its limit and left beyond the slack; a track that was not seen for its life begins anew. Who comes
    nearer counts one level more. A post goes out on a new zone, on a higher severity, and again and again while it stays red.
    """
    lives = runs(df, track, LIFE_S).drop("run_start", "run_pos")
    w = W.by([track, "run_id"])
    so_far = w.rowsBetween(W.Window.unboundedPreceding, 0)
    d, wider = F.col("distance_m"), F.when(F.col("wide"), WIDER_M).otherwise(0.0)
    zone, base = F.lit("clear"), F.lit(None).cast("int")
    for name, limit, closed, place in reversed(ZONES):
        within = lambda slack, limit=limit, closed=closed: (d <= limit + wider + slack) if closed else (d < limit + wider + slack)
        held = latched(within(0.0), ~within(SLACK_M), so_far)
        zone, base = F.when(held, name).otherwise(zone), F.when(held, place).otherwise(base)
    level = F.when(base.isNotNull(), F.least(base + F.coalesce(F.col("approaching"), F.lit(False)).cast("int"), F.lit(len(LEVELS) - 1)))
    df = lives.withColumns({"zone": zone, "_level": level})
    rises = F.coalesce(F.col("_level") > F.coalesce(F.lag("_level").over(w), F.lit(-1)), F.lit(False))
    new = (F.col("zone") != "clear") & ((F.col("zone") != F.lag("zone", 1, "clear").over(w)) | rises)
    df = df.withColumns({"severity": F.create_map(*(F.lit(x) for kv in enumerate(LEVELS) for x in kv))[F.col("_level")], "_new": new, "_again": F.col("zone") == "red"}).drop("_level", "run_id")
    return spaced(df, track, "_new", "_again", REPEAT_S, "post").drop("_new", "_again")


def aspect_ratio(points: Column, top: list[int], bottom: list[int], left: int, right: int) -> Column:
    """Mean height over width of an eye or mouth; points is an array of [x, y]."""
    dist = lambda a, b: F.sqrt(F.pow(points[a][0] - points[b][0], 2) + F.pow(points[a][1] - points[b][1], 2))
    width = dist(left, right)
    total = sum((dist(a, b) for a, b in zip(top, bottom, strict=True)), F.lit(0.0))
    return F.when(width > 0, total / len(top) / width).otherwise(0.0)


def closed_share(df: DataFrame, key: str, limit: float, seconds: float = 60) -> DataFrame:
    """Adds perclos: the share of frames with closed eyes in the last minute."""
    return df.withColumn("perclos", F.avg((F.col("ear") < limit).cast("double")).over(W.trailing(key, seconds)))


def signs(df: DataFrame, key: str, cond: Column, hold: float, seconds: float = 600) -> DataFrame:
    """Times at which a sign has held long enough, with how many there were in the last ten minutes."""
    fired = hold_trigger(df, key, cond, hold)
    return fired.withColumn("n_recent", F.count(F.lit(1)).over(W.trailing(key, seconds)))


def fatigue_score(perclos: Column, yawns: Column, nods: Column, hours: Column, night: Column) -> Column:
    """0 to 1 from closed eyes, yawns, head drops, hours into the shift and the night."""
    part = lambda x, full: F.least(x / full, F.lit(1.0))
    return 0.45 * part(perclos, 0.3) + 0.15 * part(yawns, 3) + 0.15 * part(nods, 3) + 0.15 * part(F.greatest(hours, F.lit(0.0)), 10) + 0.10 * night.cast("int")


#: Scores at which fatigue is high and at which it no longer is, history that it needs, closed eyes and their repeat.
HIGH_FROM, HIGH_UNTIL, SPAN_S, CLOSED_S, CLOSED_REPEAT_S = 0.6, 0.55, 30.0, 2.0, 2.0


def fatigue_alerts(df: DataFrame, key: str) -> DataFrame:
    """Rows (us, score, span_s, closed, moving) at which an alert goes out, with reason: score or eyes_closed.

    A high score alerts once, until it has fallen well below; eyes closed for long on a moving machine do again and again.
    """
    w = W.by(key)
    high = latched((F.col("score") >= HIGH_FROM) & (F.col("span_s") >= SPAN_S), F.col("score") < HIGH_UNTIL, w.rowsBetween(W.Window.unboundedPreceding, 0))
    shut = F.coalesce(F.col("closed") & F.col("moving"), F.lit(False))
    found = runs(df.withColumns({"_high": high, "_shut": shut}), key, float(1 << 40), "_shut")
    found = found.withColumn("_over", F.col("_shut") & (F.col("us") - F.col("run_start") > round(CLOSED_S * 1e6))).drop("run_id", "run_start", "run_pos")
    enters = F.col("_high") & ~F.lag("_high", 1, False).over(w)
    told = spaced(found.withColumns({"_enters": enters, "_first": F.col("_over") & ~F.lag("_over", 1, False).over(w)}), key, "_first", "_over", CLOSED_REPEAT_S, "_again")
    reasons = F.array_compact(F.array(F.when(F.col("_enters"), "score"), F.when(F.col("_again"), "eyes_closed")))
    return told.withColumn("reason", F.explode(reasons)).drop("_high", "_shut", "_over", "_enters", "_first", "_again")


#: Share of the open-eye mean that is the threshold, least share of the median of an open eye, plausible thresholds, the threshold otherwise.
EYE_FACTOR, OPEN_SHARE, EYE_RANGE, EYE_DEFAULT = 0.75, 0.8, (0.12, 0.30), 0.22
#: Rows of a task, about: whole keys lie in as many tasks as that takes.
EYE_ROWS = 250_000


def eye_threshold(df: DataFrame, key: str, value: str, seconds: float = 30, least: int = 60) -> DataFrame:
    """One row a key: done, n, threshold, fallback; needs `us`.

    A key is measured from its first row, with or without a value, to the first row `seconds` later or more, that one included; without such a row it
    isn't done and has the default. With under `least` values, or a threshold that isn't plausible, it falls back on the default. Rows with NULL key or
    time take no part, NULL and NaN values aren't counted.
    """
    rows = df.where(F.col(key).isNotNull() & F.col("us").isNotNull()).select(key, "us", F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("_x"))
    rows = rows.repartition(max(1, -(-rows.count() // EYE_ROWS)), key)
    first = rows.groupBy(key).agg(F.min("us").alias("_first"))
    since = rows.join(first, key)
    end = since.where(F.col("us") - F.col("_first") >= round(seconds * 1e6)).groupBy(key).agg(F.min("us").alias("_end"))
    taken = rows.join(end, key, "left").where(F.col("_end").isNull() | (F.col("us") <= F.col("_end")))
    mid = taken.groupBy(key).agg(F.median("_x").alias("_mid"), F.count("_x").alias("n"), F.max(F.col("_end").isNotNull()).alias("done"))
    mean = taken.join(mid, key).groupBy(key, "done", "n").agg((EYE_FACTOR * F.avg(F.when(F.col("_x") >= OPEN_SHARE * F.col("_mid"), F.col("_x")))).alias("_t"))
    good = F.coalesce(F.col("done") & (F.col("n") >= least) & F.col("_t").between(*EYE_RANGE), F.lit(False))
    return mean.select(key, "done", "n", F.when(good, F.col("_t")).otherwise(EYE_DEFAULT).alias("threshold"), (F.col("done") & ~good).alias("fallback"))
