"""All registered queries and their SQL twins."""

from __future__ import annotations

from .queries import aggregates, alerts, density, evaluation, features, forecasts, forests, joins, lookups, named, recurrences, scans, sets, windows, analytics, sessions  # noqa: F401  they register
from .registry import ORACLE, QUERIES

FLAGSHIP = "weekly_segments"
