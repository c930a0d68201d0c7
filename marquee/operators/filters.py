"""Row filters whose parameters may be absent."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import contains_like, full_name, iso_weekday, literal_date

# A clause builder returns None for a parameter that was not given.  Zero and empty text
# count as not given, as they do for the callers this serves; negative ids do not.


def equal(column: str, value) -> Column | None:
    return F.col(column) == F.lit(value) if value else None


def since(column: str, day) -> Column | None:
    return F.col(column) >= literal_date(day) if day else None


def until(column: str, day) -> Column | None:
    return F.col(column) <= literal_date(day) if day else None


def enum_equal(column: str, value: str | None, trim: bool = True) -> Column | None:
    """Status or role given in any letter case; an unknown one matches no row."""
    if value and trim:
        value = value.strip()
    return equal(column, value.upper() if value else None)


def member_search(needle: str | None) -> Column | None:
    """Full name, email or department contains the needle, in any letter case."""
    needle = (needle or "").strip()
    if not needle:
        return None
    return (
        contains_like(full_name(F.col("first_name"), F.col("last_name")), needle)
        | contains_like(F.col("email"), needle)
        | contains_like(F.col("department"), needle)
    )


def optional_filter(df: DataFrame, *clauses: Column | None) -> DataFrame:
    """Rows that satisfy every clause given; all rows when none is."""
    given = [c for c in clauses if c is not None]
    return df.where(reduce(and_, given)) if given else df


def enum_filter(df: DataFrame, column: str, value: str | None, trim: bool = True) -> DataFrame:
    return optional_filter(df, enum_equal(column, value, trim))


def date_range(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Inclusive on both sides; either side may be left open."""
    return optional_filter(df, since(column, start), until(column, end))


def text_search(df: DataFrame, needle: str | None) -> DataFrame:
    return optional_filter(df, member_search(needle))


def upcoming(df: DataFrame, column: str, as_of) -> DataFrame:
    """Rows dated on or after the given day."""
    return df.where(F.col(column) >= literal_date(as_of))


def in_list(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    return df.where(F.col(column).isin(list(values)))


def morning_shift(member_id: Column, day: Column) -> Column:
    """Even ids work mornings on Monday, Wednesday, Friday; odd ids on the other three."""
    weekday = iso_weekday(day)
    even = F.pmod(member_id, F.lit(2)) == 0
    return (even & weekday.isin(1, 3, 5)) | (~even & weekday.isin(2, 4, 6))
