"""Queries of the driver contract and their SQL."""

from __future__ import annotations

from shiftspark.plans import basics, build, checked, detectors, models, sequences, streams  # noqa: F401  (importing registers their queries)

FLAGSHIP = "user_shifts"
QUERIES = build.QUERIES
ORACLE_SQL = build.ORACLE_SQL
