"""Text helpers, all built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character an ECMAScript string trim removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x20\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def strip(c: Column) -> Column:
    """Trim all Unicode white space, not only spaces."""
    return F.btrim(c, F.lit(WHITESPACE))


def lower_trim(c: Column) -> Column:
    return F.lower(strip(c))


def upper_trim(c: Column) -> Column:
    return F.upper(strip(c))


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def full_name(first: Column, last: Column) -> Column:
    """``first || ' ' || last``: null if either part is null."""
    return F.concat(first, F.lit(" "), last)


def join_skipping_nulls(*parts: Column) -> Column:
    """CONCAT as databases define it: a null part counts as empty text."""
    return F.concat_ws("", *[p.cast("string") for p in parts])


def contains_like(c: Column, needle: str) -> Column:
    """Case-insensitive substring test; ``%`` and ``_`` in the needle are wildcards.

    A backslash makes the next character literal, whichever it is.
    """

    def unescape(match: re.Match) -> str:
        return match[0] if match[1] in "%_\\" else match[1]

    return F.lower(c).like(re.sub(r"\\(.)", unescape, f"%{needle.lower()}%"))


def email_like(c: Column) -> Column:
    """Something@something.something anywhere in the text."""
    return c.rlike(r"\S+@\S+\.\S+")


def request_type(c: Column) -> Column:
    """Time-off type: known names as they are, SICK LEAVE as SICK, the rest OTHER."""
    name = upper_trim(c)
    return (
        F.when(name.isin("VACATION", "SICK", "PERSONAL"), name)
        .when(name == "SICK LEAVE", F.lit("SICK"))
        .otherwise(F.lit("OTHER"))
    )


def user_role(team_role: Column) -> Column:
    """Account role that goes with a team role."""
    return F.when(team_role == "ADMIN", F.lit("ADMIN")).otherwise(F.lit("STAFF"))
