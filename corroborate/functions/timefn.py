"""Time functions over columns. Instants are TIMESTAMP columns read in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corroborate.config import LIMITS

HOUR_MICROS = 3_600_000_000


def iso(ts: Column) -> Column:
    """ISO-8601 text with milliseconds; text order equals time order."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def day_key(ts: Column) -> Column:
    """The UTC day of an instant."""
    return F.date_format(ts, "yyyy-MM-dd")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def time_proximity(a: Column, b: Column, hours: float = 48) -> Column:
    """1 for the same instant, falling to 0 at ``hours`` apart; 0 on null."""
    gap = F.abs(micros(a) - micros(b)) / F.lit(float(hours) * HOUR_MICROS)
    return F.coalesce(F.greatest(F.lit(0.0), F.lit(1.0) - gap), F.lit(0.0))


def window_end(ts: Column, minutes: int = LIMITS.window_minutes) -> Column:
    """The instant floored to the window grid."""
    width = minutes * 60
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / width) * width)


def window_start(ts: Column, minutes: int = LIMITS.window_minutes) -> Column:
    """Start of the window that closes at :func:`window_end`."""
    width = minutes * 60
    return F.timestamp_seconds((F.floor(F.unix_seconds(ts) / width) - 1) * width)


def age_hours(first_seen: Column, now: Column) -> Column:
    """Hours since ``first_seen``, never negative."""
    return F.greatest(F.lit(0.0), (micros(now) - micros(first_seen)) / F.lit(float(HOUR_MICROS)))


def is_stale(lease_at: Column, now: Column, minutes: int = LIMITS.stale_minutes) -> Column:
    """A missing lease, or one at least ``minutes`` old."""
    return lease_at.isNull() | F.coalesce(lease_at <= now - F.expr(f"interval {minutes} minutes"), F.lit(False))


def round_half_up(c: Column, digits: int = 0) -> Column:
    """Round half towards plus infinity, in double arithmetic."""
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
