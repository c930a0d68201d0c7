"""Date and clock helpers.  Clock readings are UTC ``timestamp_ntz``."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = "timestamp_ntz"


def literal_stamp(value: str | datetime) -> Column:
    return F.lit(str(value)).cast(STAMP)


def literal_date(value: str | date) -> Column:
    return F.lit(str(value)).cast("date")


def truncated(unit: str, c: Column) -> Column:
    """Start of the day, week (Monday) or month."""
    return F.date_trunc(unit, c).cast(STAMP)


def iso_weekday(c: Column) -> Column:
    """Monday is 1, Sunday 7."""
    return F.weekday(c) + F.lit(1)


def elapsed_micros(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def minutes(n: Column) -> Column:
    return F.make_dt_interval(mins=n)


def add_seconds(c: Column, seconds: Column) -> Column:
    return c + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def at_time(day: Column, second_of_day: Column) -> Column:
    """A date and a time of day (seconds) as one clock reading."""
    return add_seconds(day.cast(STAMP), second_of_day)


def to_utc(local: Column, zone: str) -> Column:
    """Clock reading in ``zone`` as UTC; independent of the session zone."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)


def parse_date(c: Column) -> Column:
    """ISO date text, with or without a clock reading, as a date; null when it is not one."""
    clock = r"[T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s?(Z|[+-]\d{2}(:?\d{2})?)?"
    return F.when(c.rlike(rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}({clock})?$"), c.try_cast("date"))


def parse_stamp(c: Column) -> Column:
    """ISO clock text as UTC; a zone offset in the text is honoured.  Null if unreadable."""
    zoned = c.rlike(r"(Z|[+-]\d{2}(:?\d{2})?)$") & c.rlike(r"\d{1,2}:\d{2}")
    bare = c.try_cast(STAMP)
    # Counted from the epoch, because local clock readings repeat when summer time ends.
    micros = F.unix_micros(c.try_cast("timestamp")).cast("decimal(18,0)")
    shifted = add_seconds(literal_stamp("1970-01-01"), micros / F.lit(1_000_000).cast("decimal(7,0)"))
    return F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.when(zoned, shifted).otherwise(bare))


def parse_clock(c: Column) -> Column:
    """'HH:MM' or 'HH:MM:SS' as seconds since midnight; null if out of range."""
    pattern = r"^(\d{1,2}):(\d{2})(?::(\d{2}))?$"

    def part(i: int) -> Column:
        return F.regexp_extract(c, pattern, i).try_cast("int")

    h, m, s = part(1), part(2), F.coalesce(part(3), F.lit(0))
    return F.when((h < 24) & (m < 60) & (s < 60), h * 3600 + m * 60 + s)
