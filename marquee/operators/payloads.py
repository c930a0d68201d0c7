"""Input batches: normalizing raw text fields and rejecting bad rows.

A raw batch has one text column per input field, null where the field was absent.  Every
kind has its fields (output column -> expression) and its rules in order; the first rule
that fails gives the error text.  Values are checked after normalizing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee import schema
from marquee.functions import (
    email_like,
    empty_to_null,
    lower_trim,
    parse_clock,
    parse_date,
    parse_float,
    parse_int,
    parse_money,
    parse_stamp,
    request_type,
    strip,
    upper_trim,
)

Rules = list[tuple[Column, str]]
Fields = dict[str, Column]


def _text(name: str) -> Column:
    return F.coalesce(strip(F.col(name)), F.lit(""))


def _email(name: str = "email") -> Column:
    return F.coalesce(lower_trim(F.col(name)), F.lit(""))


def _optional(name: str) -> Column:
    return empty_to_null(strip(F.col(name)))


def _choice(name: str, default: str | None) -> Column:
    return F.coalesce(upper_trim(F.col(name)), F.lit(default))


def _money(c: Column) -> Column:
    """Two places; an amount below zero that would round to zero has no value."""
    rounded = parse_money(c)
    return F.when((rounded != 0) | (parse_float(c) >= 0), rounded)


def _blank(*names: str) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | (F.col(n) == "")
    return out


def _outside(name: str, allowed: tuple[str, ...]) -> Column:
    return ~F.col(name).isin(list(allowed))


def _below(name: str, bound) -> Column:
    return F.col(name).isNull() | (F.col(name) < bound)


def _unreadable(parsed: str, raw: str) -> Column:
    """The text was given but is not a date, clock reading or time of day."""
    return F.col(parsed).isNull() & empty_to_null(strip(F.col(raw))).isNotNull()


# The error texts below.


def _item() -> tuple[Fields, Rules]:
    return (
        {"name": _text("name"), "value": _text("value")},
        [(_blank("name", "value"), "Both 'name' and 'value' are required.")],
    )


def _theater() -> tuple[Fields, Rules]:
    return (
        {
            "name": _text("name"),
            "location": _optional("location"),
            "address": _optional("address"),
            "city": _text("city"),
        },
        [(_blank("name", "city"), "name and city are required.")],
    )


def _screen() -> tuple[Fields, Rules]:
    return (
        {
            "theater_id": parse_int(F.col("theaterId")),
            "name": _text("name"),
            "total_seats": parse_int(F.col("totalSeats"), "int"),
        },
        [
            (_below("theater_id", 1), "theaterId is required."),
            (_blank("name"), "name is required."),
            (_below("total_seats", 1), "totalSeats must be greater than 0."),
        ],
    )


def _movie() -> tuple[Fields, Rules]:
    return (
        {
            "title": _text("title"),
            "description": _optional("description"),
            "duration_min": parse_int(F.col("durationMin"), "int"),
            "rating": _optional("rating"),
            "release_date": parse_date(_text("releaseDate")),
            "poster_url": _optional("posterUrl"),
            "status": _choice("status", "COMING_SOON"),
        },
        [
            (_blank("title"), "Title is required."),
            (_below("duration_min", 1), "durationMin must be greater than 0."),
            (_outside("status", schema.MOVIE_STATUS), "Invalid status."),
            (_unreadable("release_date", "releaseDate"), "Invalid releaseDate."),
        ],
    )


def _showtime() -> tuple[Fields, Rules]:
    missing = (F.coalesce(F.col("startTime"), F.lit("")) == "") | (
        F.coalesce(F.col("endTime"), F.lit("")) == ""
    )
    return (
        {
            "movie_id": parse_int(F.col("movieId")),
            "screen_id": parse_int(F.col("screenId")),
            "start_time": parse_stamp(F.col("startTime")),
            "end_time": parse_stamp(F.col("endTime")),
            "price": _money(F.col("price")),
            "language": _optional("language"),
            "format": _optional("format"),
        },
        [
            (_below("movie_id", 1), "movieId is required."),
            (_below("screen_id", 1), "screenId is required."),
            (missing, "startTime and endTime are required."),
            (_below("price", 0), "price must be 0 or greater."),
            (F.col("start_time").isNull() | F.col("end_time").isNull(), "Invalid time."),
            (F.col("end_time") <= F.col("start_time"), "endTime must be after startTime."),
        ],
    )


def _team_member() -> tuple[Fields, Rules]:
    return (
        {
            "first_name": _text("firstName"),
            "last_name": _text("lastName"),
            "email": _email(),
            "phone": _optional("phone"),
            "role": _choice("role", ""),
            "department": _optional("department"),
            "status": _choice("status", "ACTIVE"),
            "theater_id": parse_int(F.col("theaterId")),
            "hired_at": parse_date(_text("hiredAt")),
        },
        [
            (
                _blank("first_name", "last_name", "email", "role"),
                "firstName, lastName, email, and role are required.",
            ),
            (~email_like(F.col("email")), "Invalid email."),
            (_outside("role", schema.MEMBER_ROLE), "Invalid role."),
            (_outside("status", schema.MEMBER_STATUS), "Invalid status."),
            (_unreadable("hired_at", "hiredAt"), "Invalid hiredAt."),
        ],
    )


def _account() -> tuple[Fields, Rules]:
    return (
        {
            "first_name": _text("firstName"),
            "last_name": _text("lastName"),
            "email": _email(),
            "phone": _optional("phone"),
            "role": _choice("role", "CUSTOMER"),
        },
        [
            (_blank("first_name", "last_name", "email"), "Please fill in all required fields."),
            (~email_like(F.col("email")), "Please enter a valid email address."),
            (_outside("role", schema.USER_ROLE), "Invalid role."),
        ],
    )


def _profile() -> tuple[Fields, Rules]:
    given = F.coalesce(F.col("profilePhotoProvided"), F.lit(False))
    nothing = (
        F.col("firstName").isNull() & F.col("lastName").isNull() & F.col("phone").isNull() & ~given
    )
    return (
        {
            "first_name": strip(F.col("firstName")),
            "last_name": strip(F.col("lastName")),
            "phone": _optional("phone"),
            "profile_photo": F.when(given, _text("profilePhoto")),
            "profile_photo_provided": given,
            "_nothing": nothing,
        },
        [
            (F.col("_nothing"), "No updatable fields provided."),
            (
                F.coalesce(_blank("first_name"), F.lit(False))
                | F.coalesce(_blank("last_name"), F.lit(False)),
                "firstName and lastName cannot be empty.",
            ),
        ],
    )


def _task() -> tuple[Fields, Rules]:
    return (
        {
            "team_member_id": parse_int(F.col("teamMemberId")),
            "email": _email(),
            "title": _text("title"),
            "description": _optional("description"),
            "priority": _choice("priority", "MEDIUM"),
            "due_date": parse_date(_text("dueDate")),
            "due_sec": parse_clock(_text("dueTime")),
            "status": _choice("status", "PENDING"),
        },
        [
            (_blank("title"), "title is required."),
            (_outside("priority", schema.TASK_PRIORITY), "Invalid priority."),
            (_outside("status", schema.TASK_STATUS), "Invalid status."),
            (_unreadable("due_date", "dueDate"), "Invalid dueDate."),
            (_unreadable("due_sec", "dueTime"), "Invalid dueTime."),
        ],
    )


def _time_record() -> tuple[Fields, Rules]:
    pause = F.coalesce(parse_int(F.col("breakMinutes"), "int"), F.lit(0))
    required = (_text("workDate") == "") | (_text("clockInAt") == "")
    return (
        {
            "team_member_id": parse_int(F.col("teamMemberId")),
            "email": _email(),
            "work_date": parse_date(_text("workDate")),
            "clock_in_at": parse_stamp(_text("clockInAt")),
            "clock_out_at": parse_stamp(_text("clockOutAt")),
            "break_minutes": F.greatest(F.lit(0), pause),
            "notes": _optional("notes"),
            "status": _choice("status", "CLOCKED_IN"),
        },
        [
            (required, "workDate and clockInAt are required."),
            (_outside("status", schema.RECORD_STATUS), "Invalid status."),
            (_unreadable("work_date", "workDate"), "Invalid workDate."),
            (_unreadable("clock_in_at", "clockInAt"), "Invalid clockInAt."),
            (_unreadable("clock_out_at", "clockOutAt"), "Invalid clockOutAt."),
        ],
    )


def _time_off() -> tuple[Fields, Rules]:
    # Any text but '' switches the flag on, the word "false" included.
    partial = F.coalesce(F.col("partialDay") != "", F.lit(False))
    required = (_text("reason") == "") | (_text("startDate") == "") | (_text("endDate") == "")
    return (
        {
            "team_member_id": parse_int(F.col("teamMemberId")),
            "email": _email(),
            "request_type": request_type(
                F.coalesce(empty_to_null(F.col("type")), F.col("requestType"), F.lit(""))
            ),
            "start_date": parse_date(_text("startDate")),
            "end_date": parse_date(_text("endDate")),
            "partial_day": partial,
            "partial_start_sec": F.when(partial, parse_clock(_text("startTime"))),
            "partial_end_sec": F.when(partial, parse_clock(_text("endTime"))),
            "reason": _text("reason"),
            "status": F.lit("PENDING"),
        },
        [
            (required, "startDate, endDate, and reason are required."),
            (
                F.col("end_date") < F.col("start_date"),
                "endDate cannot be before startDate.",
            ),
            (_unreadable("start_date", "startDate"), "Invalid startDate."),
            (_unreadable("end_date", "endDate"), "Invalid endDate."),
            (partial & _unreadable("partial_start_sec", "startTime"), "Invalid startTime."),
            (partial & _unreadable("partial_end_sec", "endTime"), "Invalid endTime."),
        ],
    )


def _payment() -> tuple[Fields, Rules]:
    return (
        {
            "booking_id": parse_int(F.col("bookingId")),
            "amount": _money(F.col("amount")),
            "method": _choice("method", "WALLET"),
            "status": _choice("status", "PAID"),
            "transaction_ref": _optional("transactionRef"),
        },
        [
            (_below("booking_id", 1), "bookingId is required."),
            (_below("amount", 0), "amount must be 0 or greater."),
            (_outside("method", schema.PAYMENT_METHOD), "Invalid method."),
            (_outside("status", schema.PAYMENT_STATUS), "Invalid status."),
        ],
    )


def clean_seats(seats: Column) -> Column:
    """Seats as (seat_label, price); an absent list is an empty one."""

    def clean(seat: Column) -> Column:
        label = F.coalesce(strip(seat["seatLabel"]), F.lit(""))
        return F.struct(label.alias("seat_label"), _money(seat["price"]).alias("price"))

    none = F.array().cast("array<struct<seat_label:string,price:decimal(10,2)>>")
    return F.coalesce(F.transform(seats, clean), none)


def bad_seats(cleaned: Column) -> Column:
    """True if any cleaned seat lacks a label or has no price of 0 or more."""

    def bad(seat: Column) -> Column:
        return (seat["seat_label"] == "") | seat["price"].isNull() | (seat["price"] < 0)

    return F.exists(cleaned, bad)


def _booking() -> tuple[Fields, Rules]:
    pays = F.col("payment_method").isNotNull()
    return (
        {
            "user_id": parse_int(F.col("userId")),
            "showtime_id": parse_int(F.col("showtimeId")),
            "status": _choice("status", "CONFIRMED"),
            "total_amount": _money(F.col("totalAmount")),
            "clean_seats": clean_seats(F.col("seats")),
            "payment_method": empty_to_null(upper_trim(F.col("paymentMethod"))),
            "payment_status": _choice("paymentStatus", "PAID"),
            "transaction_ref": _optional("transactionRef"),
        },
        [
            (_below("user_id", 1), "userId is required."),
            (_below("showtime_id", 1), "showtimeId is required."),
            (_below("total_amount", 0), "totalAmount must be 0 or greater."),
            (_outside("status", schema.BOOKING_STATUS), "Invalid status."),
            (_outside("payment_method", schema.PAYMENT_METHOD), "Invalid paymentMethod."),
            (pays & _outside("payment_status", schema.PAYMENT_STATUS), "Invalid paymentStatus."),
            (
                bad_seats(F.col("clean_seats")),
                "Each seat must include seatLabel and non-negative price.",
            ),
        ],
    )


def _booking_update() -> tuple[Fields, Rules]:
    return (
        {"status": _choice("status", ""), "total_amount": _money(F.col("totalAmount"))},
        [
            (_outside("status", schema.BOOKING_STATUS), "Invalid status."),
            (_below("total_amount", 0), "totalAmount must be 0 or greater."),
        ],
    )


KINDS: dict[str, Callable[[], tuple[Fields, Rules]]] = {
    "items": _item,
    "theaters": _theater,
    "screens": _screen,
    "movies": _movie,
    "showtimes": _showtime,
    "team_members": _team_member,
    "accounts": _account,
    "profiles": _profile,
    "staff_tasks": _task,
    "staff_time_records": _time_record,
    "staff_time_off_requests": _time_off,
    "payments": _payment,
    "bookings": _booking,
    "booking_updates": _booking_update,
}


def first_error(rules: Rules) -> Column:
    return F.coalesce(*[F.when(failed, F.lit(text)) for failed, text in rules])


def normalize(df: DataFrame, kind: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, the normalized fields, and ``error`` (null for a valid row).

    Fields are computed from the raw columns, rules from the fields.  A field named with a
    leading underscore serves the rules only.
    """
    fields, rules = KINDS[kind]()
    judged = df.withColumns(fields).withColumn("error", first_error(rules))
    shown = [f for f in fields if not f.startswith("_")]
    return judged.select(*[c for c in keep if c not in fields], *shown, "error")


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows without the error column, rejected rows)."""
    return df.where(F.col("error").isNull()).drop("error"), df.where(F.col("error").isNotNull())
