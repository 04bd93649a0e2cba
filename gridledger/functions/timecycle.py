"""Local time and billing cycles, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Kolkata"


def to_local(utc: Column, zone: str | Column = ZONE) -> Column:
    """UTC wall time to local wall time (both without zone); the zone may be a column."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def cycle_start(local: Column, billing_day: Column) -> Column:
    """The billing cycle that a local time is in: days before the billing day belong to the month before."""
    day = local.cast("date")
    back = billing_day.cast("int") - 1
    return F.date_add(F.trunc(F.date_sub(day, back), "MM"), back)


def cycle_end(start: Column) -> Column:
    return F.add_months(start, 1)


def all_cycles(first: Column, now: Column) -> Column:
    """array<date> of the cycle starts from the first to that of now."""
    return F.sequence(first, now, F.expr("interval 1 month"))


def name_time(name: Column) -> Column:
    """Capture time of a frame by its name, null where the name doesn't begin with one."""
    stamp = F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2}_\d{6})_", 1)
    return F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd_HHmmss")).cast("timestamp_ntz")


def mark_time(text: Column) -> Column:
    """A capture time that stands anywhere in a text."""
    stamp = F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2}_\d{6})", 1)
    return F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd_HHmmss")).cast("timestamp_ntz")


def day_label(day: Column) -> Column:
    """MM-DD."""
    return F.date_format(day, "MM-dd")


def cycle_label(start: Column) -> Column:
    """Month and year of a cycle's start: Jun 2026."""
    return F.date_format(start, "MMM yyyy")


def frame_label(name: Column) -> Column:
    """Date and time parts of a frame's name, with the time's dashes as colons."""
    parts = F.split(name, "_")
    return F.concat(F.coalesce(F.get(parts, F.lit(0)), F.lit("")), F.lit(" "), F.replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), F.lit("-"), F.lit(":")))


def frame_name(at: Column, suffix: Column) -> Column:
    return F.concat(F.date_format(at, "yyyy-MM-dd_HHmmss"), F.lit("_"), suffix, F.lit(".jpg"))


def period_start(period: str, as_of: Column, cycle: Column) -> Column:
    """First local date of a report period: cycle, 7d, 30d or all; anything else is cycle."""
    return {"7d": F.date_sub(as_of, 6), "30d": F.date_sub(as_of, 29), "all": F.lit("2000-01-01").cast("date")}.get(period, cycle)
