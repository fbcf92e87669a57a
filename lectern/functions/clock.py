"""Times, dates and small numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minutes_seconds(ms: Column) -> Column:
    """``mm:ss``; minutes never roll into hours, a negative time is 00:00."""
    s = F.greatest(F.lit(0), F.floor(ms / 1000)).cast("long")
    m = F.floor(s / 60).cast("string")
    return F.concat(F.when(F.length(m) < 2, F.lpad(m, 2, "0")).otherwise(m), F.lit(":"), F.lpad(F.pmod(s, F.lit(60)).cast("string"), 2, "0"))


def local_day(ts: Column, offset_hours: int = 8) -> Column:
    """Calendar day at a fixed offset from UTC."""
    return F.to_date(ts + F.make_interval(hours=F.lit(offset_hours)))


def flexible_time(text: Column) -> Column:
    """Ten digits are seconds, thirteen are milliseconds, anything else is tried as a timestamp."""
    return (
        F.when(text.rlike("^[0-9]{10}$"), F.timestamp_seconds(text.try_cast("long")))
        .when(text.rlike("^[0-9]{13}$"), F.timestamp_millis(text.try_cast("long")))
        .otherwise(text.try_cast("timestamp"))
    )


def strict_date(text: Column) -> Column:
    """A date only where the text is exactly YYYY-MM-DD and a day of the calendar."""
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text.try_cast("date"))


def progress(value: Column) -> Column:
    """Over 1 counts as a percentage; the result is within 0 and 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(value > 1, value / 100).otherwise(value)))


def escalated(current: Column, factor: float, cap: int) -> Column:
    """The next budget: never lower than before, never above the cap unless it was already."""
    return F.greatest(current, F.least(F.lit(cap), F.floor(current * factor))).cast("long")


def int_or_null(text: Column) -> Column:
    """Decimal or 0x text with surrounding space, within 2^53; null for anything else."""
    t = F.trim(text)
    plain = F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("long"))
    hexed = F.when(t.rlike(r"^[+-]?0[xX][0-9a-fA-F]+$"), F.conv(F.regexp_extract(t, r"^[+-]?0[xX]([0-9a-fA-F]+)$", 1), 16, 10).try_cast("long") * F.when(t.startswith("-"), -1).otherwise(1))
    found = F.coalesce(plain, hexed)
    return F.when(F.abs(found) <= (1 << 53) - 1, found)
