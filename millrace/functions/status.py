"""States of periods at a given time, and freshness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def period_status(start: Column, end: Column, now: Column) -> Column:
    """upcoming, expired or active; a period without end that has begun is unknown."""
    return F.when(start > now, "upcoming").when(end < now, "expired").when(end.isNotNull(), "active").otherwise("unknown")


def unit_status(start: Column, end: Column, now: Column) -> Column:
    """Like period_status, but a period without end that has begun is active."""
    return F.when(start > now, "upcoming").when(end < now, "expired").when(end.isNotNull() | start.isNotNull(), "active").otherwise("unknown")


def freshness(published: Column, now: Column, weight: float = 0.12) -> Column:
    """weight for what is new, falling to 0 over a year."""
    return F.greatest(F.lit(0.0), 1 - F.datediff(now, published) / F.lit(365.0)) * F.lit(weight)
