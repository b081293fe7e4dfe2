"""Sensor validity and repair of single-reading glitches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def implausible(signal: str, low: float, high: float, gate: Column | None = None) -> Column:
    """Whether a reading is outside its range or missing; with a gate, only while that holds."""
    x = F.col(signal).cast("double")
    bad = x.isNull() | F.isnan(x) | (x < low) | (x > high)
    return bad & F.coalesce(gate, F.lit(False)) if gate is not None else bad


def repair_glitches(df: DataFrame, key: str, ranges: dict[str, tuple[float, float]], gap_seconds: float, gates: dict[str, Column] | None = None) -> DataFrame:
    """Replaces lone impossible readings by the last reading before, and names them in `glitch`.

    A glitch: exactly one signal is implausible, and it was plausible in the reading before,
    at most `gap_seconds` earlier. Other missing values stay missing. Needs a column `us`.
    """
    w = Window.partitionBy(key).orderBy("us")
    bad = {s: implausible(s, lo, hi, (gates or {}).get(s)) for s, (lo, hi) in ranges.items()}
    marked = df.withColumns({f"_bad_{s}": c for s, c in bad.items()})
    lone = sum((F.col(f"_bad_{s}").cast("int") for s in ranges), F.lit(0)) == 1
    near = F.coalesce(F.col("us") - F.lag("us").over(w) <= round(gap_seconds * 1_000_000), F.lit(False))
    new = {s: lone & near & F.col(f"_bad_{s}") & ~F.coalesce(F.lag(f"_bad_{s}").over(w), F.lit(True)) for s in ranges}
    marked = marked.withColumns({f"_new_{s}": c for s, c in new.items()})
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    valid = {s: F.last(F.when(~F.col(f"_new_{s}"), F.col(s)), ignorenulls=True).over(before) for s in ranges}
    fixed = marked.withColumns({f"_fix_{s}": F.when(F.col(f"_new_{s}"), c).otherwise(F.col(s)) for s, c in valid.items()})
    glitch = F.coalesce(*(F.when(F.col(f"_new_{s}"), F.lit(s)) for s in ranges))
    return fixed.withColumn("glitch", glitch).select(*(F.col(f"_fix_{c}").alias(c) if c in ranges else F.col(c) for c in df.columns), "glitch")
