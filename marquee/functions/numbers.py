"""Number helpers, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions.text import WHITESPACE

_LEAD = f"^[{WHITESPACE}]*"


def _prefix(c: Column, pattern: str) -> Column:
    # No match gives '', which try_cast turns into null.
    return F.regexp_extract(c.cast("string"), _LEAD + pattern, 1)


def parse_int(c: Column, kind: str = "bigint") -> Column:
    """Leading integer of a text ('12abc' is 12); null if there is none or it does not fit."""
    return _prefix(c, r"([+-]?\d+)").try_cast(kind)


_DECIMAL = r"([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def parse_float(c: Column) -> Column:
    """Leading decimal number of a text; null if there is none."""
    return _prefix(c, _DECIMAL).try_cast("double")


def parse_money(c: Column) -> Column:
    """Leading decimal number kept exactly, two places, half away from zero."""
    return _prefix(c, _DECIMAL).try_cast("decimal(10,2)")


def at_most(c: Column, bound) -> Column:
    return F.least(c, F.lit(bound))


def at_least(c: Column, bound) -> Column:
    return F.greatest(c, F.lit(bound))


def round2(c: Column) -> Column:
    return F.round(c, 2)


def falsy_zero(c: Column) -> Column:
    """Zero counts as "not given"; negative numbers stay."""
    return F.nullif(c, F.lit(0).cast("bigint"))
