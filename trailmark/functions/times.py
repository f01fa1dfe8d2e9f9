"""Time expressions. Everything that needs "now" takes `as_of`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Look-back presets in days; "all" has no lower bound.
DATE_PRESETS = {"today": 1, "week": 7, "month": 30, "quarter": 90}


def instant(value) -> Column:
    """A timestamp column from an ISO string or a column."""
    return value if isinstance(value, Column) else F.to_timestamp(F.lit(value))


def ntz_instant(local: Column) -> Column:
    """A zone-less timestamp read as UTC, whatever the session zone is."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, local))


def iso_instant(text: Column) -> Column:
    """Validated ISO-8601 parse: null when the text is no timestamp."""
    return F.try_to_timestamp(F.trim(text))


def days_since(ts: Column, as_of: Column) -> Column:
    """Fractional days, never negative, 0 when unknown."""
    days = (F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(86_400_000_000.0)
    return F.greatest(F.lit(0.0), F.coalesce(days, F.lit(0.0)))


def whole_days_since(ts: Column, as_of: Column) -> Column:
    """Whole days, never negative, 999 when unknown."""
    days = F.floor((F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(86_400_000_000.0))
    return F.coalesce(F.greatest(F.lit(0), days), F.lit(999)).cast("long")


def days_before(as_of: Column, days: float) -> Column:
    """A number of 24-hour days earlier, whatever the session zone does with its clocks."""
    return F.timestamp_micros(F.unix_micros(as_of) - F.lit(int(days * 86_400_000_000)))


def preset_start(preset: str, as_of: Column) -> Column:
    """Lower bound of a date preset, floored to midnight UTC; null for "all"."""
    days = DATE_PRESETS.get(preset)
    if days is None:
        return F.lit(None).cast("timestamp")
    day = F.lit(86_400_000_000)
    return days_before(F.timestamp_micros(F.unix_micros(as_of) - F.pmod(F.unix_micros(as_of), day)), days)


def between_dates(ts: Column, date_from: Column, date_to: Column) -> Column:
    """Inclusive range where a null bound is open."""
    return (date_from.isNull() | (ts >= date_from)) & (date_to.isNull() | (ts <= date_to))
