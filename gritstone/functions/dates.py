"""Dates and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def monday(ts: Column) -> Column:
    """The Monday of a date's week."""
    return F.to_date(F.date_trunc("week", ts))


def hours_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / 3.6e9


def years(since: Column, at: Column) -> Column:
    """Age in years of 365.25 days, from whole days."""
    return F.datediff(at, since) / 365.25


def local(ts: Column, zone: str) -> Column:
    """Wall-clock time of a UTC time in a zone."""
    return F.from_utc_timestamp(ts, zone)


def iso(ts: Column) -> Column:
    """2024-01-31T23:59:59Z of a UTC time."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
