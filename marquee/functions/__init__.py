from marquee.functions.numbers import (
    at_least,
    at_most,
    falsy_zero,
    parse_float,
    parse_int,
    parse_money,
    round2,
)
from marquee.functions.text import (
    contains_like,
    email_like,
    empty_to_null,
    full_name,
    join_skipping_nulls,
    lower_trim,
    request_type,
    strip,
    upper_trim,
    user_role,
)
from marquee.functions.times import (
    add_seconds,
    at_time,
    elapsed_micros,
    iso_weekday,
    literal_date,
    literal_stamp,
    minutes,
    parse_clock,
    parse_date,
    parse_stamp,
    to_utc,
    truncated,
)

__all__ = [name for name in dir() if not name.startswith("_")]
