"""Counts and sums.  Money is summed as decimal, hours as whole microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import elapsed_micros, literal_stamp, truncated

RANGES = ("today", "week", "month", "all")
_UNIT = {"today": "day", "week": "week", "month": "month"}

_MICROS_PER_MINUTE = 60_000_000
_MICROS_PER_HOUR = 3_600_000_000


def zero_if_none(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.lit(0)).cast(kind)


def count_when(condition: Column, alias: str) -> Column:
    return F.count(F.when(condition, 1)).alias(alias)


def money_sum(amount: Column, condition: Column | None = None) -> Column:
    kept = amount if condition is None else F.when(condition, amount)
    return zero_if_none(F.round(F.sum(kept), 2), "double")


def effective_at() -> Column:
    """When a payment counts: the time it was paid, else the time it was entered."""
    return F.coalesce("paid_at", "created_at")


def normal_range(value: str | None) -> str:
    value = (value or "week").strip().lower()
    return value if value in RANGES else "week"


def _within(rng: str, as_of: str) -> Column:
    if rng == "all":
        return F.lit(True)
    return effective_at() >= truncated(_UNIT[rng], literal_stamp(as_of))


def revenue(payments: DataFrame, rng: str | None = "all", as_of: str | None = None) -> DataFrame:
    """Number and sum of paid payments since the start of the day, week or month.

    There is no upper bound: payments dated after ``as_of`` count.
    """
    paid = payments.where(F.col("status") == "PAID").where(_within(normal_range(rng), as_of))
    return paid.agg(
        F.count("*").alias("paid_count"),
        money_sum(F.col("amount")).alias("paid_total"),
    )


def revenue_all_ranges(payments: DataFrame, as_of: str) -> DataFrame:
    """One row per range, from one pass over the payments."""
    aggs = []
    for rng in RANGES:
        inside = _within(rng, as_of)
        aggs.append(count_when(inside, f"n_{rng}"))
        aggs.append(money_sum(F.col("amount"), inside).alias(f"s_{rng}"))
    one = payments.where(F.col("status") == "PAID").agg(*aggs)
    entries = [
        F.struct(
            F.lit(r).alias("range"),
            F.col(f"n_{r}").alias("paid_count"),
            F.col(f"s_{r}").alias("paid_total"),
        )
        for r in RANGES
    ]
    return one.select(F.inline(F.array(*entries)))


def hours(micros: Column) -> Column:
    """Microseconds as hours, two decimals, half away from zero.

    The quotient keeps ten decimals, finer than one microsecond in hours, so rounding it
    again cannot move a value across a half.
    """
    return F.round(micros.cast("decimal(28,0)") / F.lit(_MICROS_PER_HOUR).cast("decimal(10,0)"), 2)


def net_micros() -> Column:
    """Time at work less the break, never below zero; an open record counts zero."""
    worked = elapsed_micros(F.col("clock_in_at"), F.col("clock_out_at"))
    pause = F.col("break_minutes").cast("bigint") * F.lit(_MICROS_PER_MINUTE)
    zero = F.lit(0).cast("bigint")
    return F.when(F.col("clock_out_at").isNull(), zero).otherwise(F.greatest(zero, worked - pause))


def net_hours(records: DataFrame, key: str = "team_member_id") -> DataFrame:
    """Hours worked per member, from completed records."""
    done = records.where(F.col("status") == "COMPLETED")
    return done.groupBy(key).agg(
        zero_if_none(hours(F.sum(net_micros().cast("decimal(18,0)"))), "double").alias("total_hours")
    )


def paid_by_user(payments: DataFrame, bookings: DataFrame) -> DataFrame:
    """Paid sum per user, whatever the status of the booking.

    Payments are summed per booking before the join, so a booking with a large part of
    all payments meets its user as one row.
    """
    per_booking = (
        payments.where(F.col("status") == "PAID")
        .groupBy(F.col("booking_id").alias("_booking"))
        .agg(F.sum("amount").alias("_paid"))
    )
    return (
        bookings.select("id", "user_id")
        .join(per_booking, F.col("id") == F.col("_booking"))
        .groupBy("user_id")
        .agg(money_sum(F.col("_paid")).alias("paid_total"))
    )


def profile_metrics(
    users: DataFrame, watchlist: DataFrame, bookings: DataFrame, payments: DataFrame
) -> DataFrame:
    """Watchlist size, number of bookings and paid sum for every user."""

    def per_user(df: DataFrame, alias: str) -> DataFrame:
        return df.groupBy(F.col("user_id").alias(f"_{alias}")).agg(F.count("*").alias(alias))

    listed = per_user(watchlist, "watchlist_total")
    booked = per_user(bookings, "booking_total")
    spent = paid_by_user(payments, bookings).withColumnRenamed("user_id", "_spent")
    return (
        users.select("id", "email")
        .join(listed, F.col("id") == F.col("_watchlist_total"), "left")
        .join(booked, F.col("id") == F.col("_booking_total"), "left")
        .join(spent, F.col("id") == F.col("_spent"), "left")
        .select(
            "id",
            "email",
            zero_if_none(F.col("watchlist_total"), "int").alias("watchlist_total"),
            zero_if_none(F.col("booking_total"), "int").alias("booking_total"),
            zero_if_none(F.col("paid_total"), "double").alias("paid_total"),
        )
    )


def shift_counts(schedules: DataFrame, as_of: str) -> DataFrame:
    """Completed and upcoming shifts per member in one pass."""
    ahead = (F.col("status") == "SCHEDULED") & (F.col("shift_date") >= F.lit(as_of).cast("date"))
    return schedules.groupBy("team_member_id").agg(
        count_when(F.col("status") == "COMPLETED", "shifts_completed"),
        count_when(ahead, "upcoming_shifts"),
    )


def task_counts(tasks: DataFrame) -> DataFrame:
    """Completed and open tasks per member in one pass."""
    return tasks.groupBy("team_member_id").agg(
        count_when(F.col("status") == "COMPLETED", "tasks_completed"),
        count_when(F.col("status").isin("PENDING", "IN_PROGRESS"), "open_tasks"),
    )


def pending_time_off(requests: DataFrame) -> DataFrame:
    return requests.groupBy("team_member_id").agg(
        count_when(F.col("status") == "PENDING", "pending_time_off_requests")
    )


def work_summary(
    members: DataFrame,
    records: DataFrame,
    schedules: DataFrame,
    tasks: DataFrame,
    time_off: DataFrame,
    as_of: str,
) -> DataFrame:
    """Hours, shifts, tasks and time-off requests for every member; 0 where there are none.

    Each table is read once and reduced to one row per member before any join.
    """
    out = members.select(F.col("id").alias("team_member_id"))
    for part in (
        net_hours(records),
        shift_counts(schedules, as_of),
        task_counts(tasks),
        pending_time_off(time_off),
    ):
        out = out.join(part, "team_member_id", "left")
    counts = (
        "shifts_completed",
        "tasks_completed",
        "pending_time_off_requests",
        "upcoming_shifts",
        "open_tasks",
    )
    return out.select(
        "team_member_id",
        zero_if_none(F.col("total_hours"), "double").alias("total_hours"),
        *[zero_if_none(F.col(c), "int").alias(c) for c in counts],
    )
