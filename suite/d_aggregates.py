"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.operators import metrics
from marquee.operators.filters import equal, optional_filter
from marquee.operators.paging import total
from suite.registry import query

AS_OF = "2001-08-01"
EVENTS_AS_OF = "2000-06-01"

_HOURS = (
    "CAST(ROUND(CAST(SUM(CASE WHEN clock_out_at IS NULL THEN 0 ELSE GREATEST(0, "
    "date_diff('microsecond', clock_in_at, clock_out_at) - CAST(break_minutes AS BIGINT) * 60000000) "
    "END) AS DECIMAL(28,0)) / 3600000000, 2) AS DOUBLE)"
)


@query("count_all", "SELECT CAST(COUNT(*) AS BIGINT) AS total FROM payments")
def count_all(d):
    return total(d.payments)


@query(
    "count_filtered",
    "SELECT CAST(COUNT(*) AS BIGINT) AS total FROM staff_tasks WHERE status = 'PENDING' "
    "AND team_member_id = 3",
)
def count_filtered(d):
    kept = optional_filter(
        d.staff_tasks, equal("team_member_id", 3), equal("status", "PENDING"), equal("priority", "")
    )
    return total(kept)


@query(
    "revenue_summary",
    "SELECT CAST(COUNT(*) AS BIGINT) AS paid_count, "
    "CAST(COALESCE(ROUND(SUM(amount), 2), 0) AS DOUBLE) AS paid_total FROM payments "
    "WHERE status = 'PAID'",
)
def revenue_summary(d):
    return metrics.revenue(d.payments)


def _range_sql(name: str, unit: str | None) -> str:
    bound = (
        f"AND COALESCE(paid_at, created_at) >= DATE_TRUNC('{unit}', TIMESTAMP '{AS_OF}')"
        if unit
        else ""
    )
    return (
        f"SELECT '{name}' AS range, CAST(COUNT(*) AS BIGINT) AS paid_count, "
        "CAST(COALESCE(ROUND(SUM(amount), 2), 0) AS DOUBLE) AS paid_total FROM payments "
        f"WHERE status = 'PAID' {bound}"
    )


@query(
    "revenue_range",
    " UNION ALL ".join(
        _range_sql(n, u)
        for n, u in (("today", "day"), ("week", "week"), ("month", "month"), ("all", None))
    ),
)
def revenue_range(d):
    return metrics.revenue_all_ranges(d.payments, AS_OF)


@query(
    "profile_metrics",
    "SELECT u.id, u.email, CAST(COALESCE(SUM(f.listed), 0) AS BIGINT) AS watchlist_total, "
    "CAST(COALESCE(SUM(f.booked), 0) AS BIGINT) AS booking_total, "
    "CAST(COALESCE(ROUND(SUM(f.paid), 2), 0) AS DOUBLE) AS paid_total FROM users u "
    "LEFT JOIN facts f ON f.user_id = u.id GROUP BY u.id, u.email",
    let={
        "facts": "SELECT user_id, 1 AS listed, 0 AS booked, 0 AS paid FROM watchlist UNION ALL "
        "SELECT user_id, 0, 1, 0 FROM bookings UNION ALL SELECT b.user_id, 0, 0, p.amount "
        "FROM bookings b JOIN payments p ON p.booking_id = b.id AND p.status = 'PAID'"
    },
)
def profile_metrics(d):
    return metrics.profile_metrics(d.users, d.watchlist, d.bookings, d.payments)


@query(
    "work_summary",
    "SELECT m.id AS team_member_id, COALESCE(CAST(ROUND(CAST(SUM(f.micros) AS DECIMAL(28,0)) "
    "/ 3600000000, 2) AS DOUBLE), 0) AS total_hours, "
    "CAST(COUNT(*) FILTER (WHERE f.kind = 'shift done') AS BIGINT) AS shifts_completed, "
    "CAST(COUNT(*) FILTER (WHERE f.kind = 'task done') AS BIGINT) AS tasks_completed, "
    "CAST(COUNT(*) FILTER (WHERE f.kind = 'time off') AS BIGINT) AS pending_time_off_requests, "
    "CAST(COUNT(*) FILTER (WHERE f.kind = 'shift ahead') AS BIGINT) AS upcoming_shifts, "
    "CAST(COUNT(*) FILTER (WHERE f.kind = 'task open') AS BIGINT) AS open_tasks "
    "FROM team_members m LEFT JOIN facts f ON f.member = m.id GROUP BY m.id",
    let={
        "facts": "SELECT team_member_id AS member, 'record' AS kind, CASE WHEN clock_out_at "
        "IS NULL THEN 0 ELSE GREATEST(0, date_diff('microsecond', clock_in_at, clock_out_at) "
        "- CAST(break_minutes AS BIGINT) * 60000000) END AS micros FROM staff_time_records "
        "WHERE status = 'COMPLETED' UNION ALL SELECT team_member_id, 'shift done', 0 "
        "FROM staff_schedules WHERE status = 'COMPLETED' UNION ALL "
        "SELECT team_member_id, 'shift ahead', 0 FROM staff_schedules WHERE status = 'SCHEDULED' "
        f"AND shift_date >= DATE '{EVENTS_AS_OF}' UNION ALL SELECT team_member_id, "
        "CASE status WHEN 'COMPLETED' THEN 'task done' WHEN 'CANCELLED' THEN 'task off' "
        "ELSE 'task open' END, 0 FROM staff_tasks UNION ALL SELECT team_member_id, 'time off', 0 "
        "FROM staff_time_off_requests WHERE status = 'PENDING'"
    },
)
def work_summary(d):
    return metrics.work_summary(
        d.team_members,
        d.staff_time_records,
        d.staff_schedules,
        d.staff_tasks,
        d.staff_time_off_requests,
        EVENTS_AS_OF,
    )


@query(
    "net_hours",
    f"SELECT team_member_id, {_HOURS} AS total_hours FROM staff_time_records "
    "WHERE status = 'COMPLETED' GROUP BY team_member_id",
)
def net_hours(d):
    return metrics.net_hours(d.staff_time_records)


@query(
    "conditional_counts",
    "SELECT team_member_id, CAST(COUNT(*) FILTER (WHERE status = 'COMPLETED') AS BIGINT) "
    "AS shifts_completed, CAST(COUNT(*) FILTER (WHERE status = 'SCHEDULED' "
    f"AND shift_date >= DATE '{EVENTS_AS_OF}') AS BIGINT) AS upcoming_shifts "
    "FROM staff_schedules GROUP BY team_member_id",
)
def conditional_counts(d):
    return metrics.shift_counts(d.staff_schedules, EVENTS_AS_OF)


@query(
    "empty_group_defaults",
    "SELECT CAST(COALESCE(COUNT(*), 0) AS BIGINT) AS failed_count, "
    "CAST(COALESCE(ROUND(SUM(amount), 2), 0) AS DOUBLE) AS failed_total FROM payments "
    "WHERE status = 'FAILED'",
)
def empty_group_defaults(d):
    failed = d.payments.where(F.col("status") == "FAILED")
    return failed.agg(
        F.count("*").alias("failed_count"),
        metrics.money_sum(F.col("amount")).alias("failed_total"),
    )
