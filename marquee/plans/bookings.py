"""Bookings with their seats and payments."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import join_skipping_nulls, literal_stamp
from marquee.operators.changes import with_paid_at
from marquee.operators.intake import Reference, Unique, admit, admitted
from marquee.operators.joins import missing_in, nest_children
from marquee.operators.payloads import normalize
from marquee.operators.ranking import running_totals
from marquee.plans.listings import booking_listing
from marquee.session import durable


def booking_with_seats(
    bookings: DataFrame,
    users: DataFrame,
    showtimes: DataFrame,
    movies: DataFrame,
    seats: DataFrame,
) -> DataFrame:
    """Each booking as listed, with its seats in id order as an array."""
    listing = booking_listing(bookings, users, showtimes, movies)
    fields = ["id", "seat_label", "price", "created_at"]
    return nest_children(listing, seats, "booking_id", ["id"], fields, "seats")


class FanOut(NamedTuple):
    bookings: DataFrame
    booking_seats: DataFrame
    payments: DataFrame


def fan_out(
    docs: DataFrame, seq: str, now: str, after: tuple[Column | int, Column | int, Column | int]
) -> FanOut:
    """Valid booking documents as booking, seat and payment rows.

    ``after`` holds the highest ids present in the three tables; ids follow the order of
    ``seq``, and of the seats inside a document.  A payment row, over the booking's total,
    is made only where a payment method is given.  One numbering serves all three: the seats and
    payments of the documents before are running sums, so children need no order of their own.
    """
    pays = F.col("payment_method").isNotNull()
    counts = {"_bookings": F.lit(1), "_seats": F.size("clean_seats"), "_payments": F.when(pays, 1).otherwise(0)}
    placed = running_totals(docs, [seq], counts)
    starts = [F.lit(a) if isinstance(a, int) else a for a in after]
    numbered = placed.withColumns(
        {
            "_booking": starts[0] + F.col("_bookings") + 1,
            "_first_seat": starts[1] + F.col("_seats") + 1,
            "_payment": starts[2] + F.col("_payments") + 1,
        }
    )
    created = literal_stamp(now)
    bookings = numbered.select(
        F.col("_booking").alias("id"), "user_id", "showtime_id", "status", "total_amount", created.alias("booked_at")
    )
    seats = numbered.select("_booking", "_first_seat", F.posexplode("clean_seats").alias("_at", "_seat")).select(
        (F.col("_first_seat") + F.col("_at")).alias("id"),
        F.col("_booking").alias("booking_id"),
        "_seat.seat_label",
        "_seat.price",
        created.alias("created_at"),
    )
    payments = numbered.where(pays).select(
        F.col("_payment").alias("id"),
        F.col("_booking").alias("booking_id"),
        F.col("payment_method").alias("method"),
        F.col("total_amount").alias("amount"),
        F.col("payment_status").alias("status"),
        "transaction_ref",
    )
    return FanOut(bookings, seats, with_paid_at(payments, now).withColumn("created_at", created))


def take_bookings(
    raw: DataFrame,
    seq: str,
    now: str,
    after: tuple[Column | int, Column | int, Column | int],
    stored: Mapping[str, DataFrame] | None = None,
) -> tuple[FanOut, DataFrame]:
    """Raw booking documents: (new rows of the three tables, rejected documents with the error).

    A document is taken whole or not at all, as in a transaction.  It is rejected for an input
    error, an unknown user or showtime, a seat named twice, or a transaction_ref that a stored
    payment or a document taken before it has; the error then names the rule.  ``stored`` holds the
    tables ``users``, ``showtimes`` and ``payments``; what is absent is not checked.  The decided
    documents are kept once, because both halves and the numbering read them.
    """
    stored = stored or {}
    parsed = normalize(raw, "bookings", [seq])
    labels = F.transform("clean_seats", lambda seat: seat["seat_label"])
    rules = {
        "input": F.col("error").isNotNull(),
        "unique booking_id, seat_label": F.size(F.array_distinct(labels)) < F.size(labels),
    }
    references = [Reference(f"{t[:-1]}_id", stored[t], t) for t in ("users", "showtimes") if t in stored]
    pays = F.col("payment_method").isNotNull()
    unique = Unique(("transaction_ref",), stored.get("payments"), among=pays)
    checked = durable(admit(parsed, seq, references, unique, rules))
    refused = checked.where(F.col("refused").isNotNull())
    return (
        fan_out(admitted(checked), seq, now, after),
        refused.select(seq, F.coalesce("error", "refused").alias("error")),
    )


def backfill_payments(bookings: DataFrame, payments: DataFrame, now: str) -> DataFrame:
    """One paid payment for every confirmed booking that has no payment at all."""
    confirmed = bookings.where(F.col("status") == "CONFIRMED")
    paid = payments.select(F.col("booking_id").alias("id"))
    return missing_in(confirmed, paid, ["id"]).select(
        F.col("id").alias("booking_id"),
        F.lit("ONLINE_BANKING").alias("method"),
        F.col("total_amount").alias("amount"),
        F.lit("PAID").alias("status"),
        F.coalesce("booked_at", literal_stamp(now)).alias("paid_at"),
        join_skipping_nulls(F.lit("AUTO-PAY-"), F.col("id")).alias("transaction_ref"),
    )
