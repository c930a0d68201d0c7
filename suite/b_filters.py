"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions import iso_weekday
from marquee.operators.filters import (
    date_range as in_date_range,
)
from marquee.operators.filters import (
    enum_equal,
    equal,
    morning_shift,
    optional_filter,
    since,
    until,
    upcoming,
)
from marquee.operators.filters import (
    enum_filter as keep_status,
)
from marquee.operators.filters import (
    in_list as keep_listed,
)
from marquee.operators.filters import (
    text_search as search_members,
)
from marquee.operators.identity import lookup, scoped
from marquee.plans.accounts import to_user_payload
from marquee.plans.schedules import shift_role
from suite.registry import query


@query("project_columns", "SELECT id, title, duration_min, rating, status FROM movies")
def project_columns(d):
    return d.movies.select("id", "title", "duration_min", "rating", "status")


@query(
    "rename_shape",
    'SELECT id, first_name AS "firstName", email, phone, '
    "COALESCE(profile_photo, '') AS \"profilePhoto\", role, updated_at AS \"updatedAt\" FROM users",
)
def rename_shape(d):
    return to_user_payload(d.users)


@query(
    "lookup_by_id",
    "SELECT e.event_id, e.id, u.email, CASE WHEN e.id < 1 THEN 'INVALID' "
    "WHEN u.id IS NULL THEN 'NOT_FOUND' ELSE 'FOUND' END AS outcome FROM (SELECT event_id, "
    "CASE WHEN event_type = 'error' THEN user_id + 1000000000 ELSE user_id - 1 END AS id "
    "FROM events) AS e LEFT JOIN users u ON u.id = e.id AND e.id >= 1",
)
def lookup_by_id(d):
    user = F.col("user_id")
    number = F.when(F.col("event_type") == "error", user + 1000000000).otherwise(user - 1)
    asked = d.events.select("event_id", number.alias("id"))
    return lookup(asked, d.users.select("id", "email"))


@query(
    "optional_filters",
    "SELECT id, team_member_id, work_date, status FROM staff_time_records "
    "WHERE work_date >= DATE '2024-01-10' AND status = 'COMPLETED'",
)
def optional_filters(d):
    given = {"member": None, "start": "2024-01-10", "end": "", "status": " completed"}
    return optional_filter(
        d.staff_time_records,
        equal("team_member_id", given["member"]),
        since("work_date", given["start"]),
        until("work_date", given["end"]),
        enum_equal("status", given["status"]),
    ).select("id", "team_member_id", "work_date", "status")


@query(
    "enum_filter", "SELECT id, email, status FROM team_members WHERE status = UPPER('inactive')"
)
def enum_filter(d):
    return keep_status(d.team_members, "status", " inactive ").select("id", "email", "status")


@query(
    "in_list",
    "SELECT id, team_member_id, status FROM staff_tasks WHERE status IN ('PENDING', 'IN_PROGRESS')",
)
def in_list(d):
    kept = keep_listed(d.staff_tasks, "status", ["PENDING", "IN_PROGRESS"])
    return kept.select("id", "team_member_id", "status")


@query(
    "between_filter",
    "SELECT id, shift_date FROM staff_schedules WHERE EXTRACT(ISODOW FROM shift_date) "
    "BETWEEN 1 AND 6",
)
def between_filter(d):
    kept = d.staff_schedules.where(iso_weekday(F.col("shift_date")).between(1, 6))
    return kept.select("id", "shift_date")


@query(
    "date_range",
    "SELECT id, work_date FROM staff_time_records "
    "WHERE work_date >= DATE '2024-01-10' AND work_date <= DATE '2024-01-20'",
)
def date_range(d):
    kept = in_date_range(d.staff_time_records, "work_date", "2024-01-10", "2024-01-20")
    return kept.select("id", "work_date")


@query(
    "ci_equality",
    "SELECT u.id AS user_id, t.id AS team_member_id FROM users u JOIN "
    "(SELECT id, UPPER(email) AS email FROM team_members) AS t ON LOWER(u.email) = LOWER(t.email)",
)
def ci_equality(d):
    shouted = d.team_members.select(F.col("id").alias("team_member_id"), F.upper("email").alias("m"))
    people = d.users.select(F.col("id").alias("user_id"), "email")
    return people.join(shouted, F.lower("email") == F.lower("m")).select(
        "user_id", "team_member_id"
    )


@query(
    "text_search",
    "SELECT id, first_name, last_name, department FROM team_members "
    "WHERE LOWER(first_name || ' ' || last_name) LIKE '%9_b%g%' OR LOWER(email) LIKE '%9_b%g%' "
    "OR LOWER(department) LIKE '%9_b%g%'",
)
def text_search(d):
    found = search_members(d.team_members, " 9_B%g ")
    return found.select("id", "first_name", "last_name", "department")


@query(
    "ilike_filter",
    "SELECT id, CASE WHEN COALESCE(department, '') ILIKE '%box%' THEN 'Box Office' "
    "WHEN COALESCE(department, '') ILIKE '%floor%' THEN 'Floor Staff' "
    "ELSE 'Guest Support' END AS role_on_shift FROM team_members",
)
def ilike_filter(d):
    return d.team_members.select("id", shift_role(F.col("department")).alias("role_on_shift"))


@query(
    "null_predicates",
    "SELECT id, clock_out_at IS NULL AS open_record, "
    "CAST(clock_out_at AS DATE) IS NOT DISTINCT FROM work_date AS same_day FROM staff_time_records",
)
def null_predicates(d):
    left_on = F.col("clock_out_at").cast("date")
    return d.staff_time_records.select(
        "id",
        F.col("clock_out_at").isNull().alias("open_record"),
        left_on.eqNullSafe(F.col("work_date")).alias("same_day"),
    )


@query(
    "parity_predicate",
    "SELECT id, shift_date, isodow(shift_date) < 7 AND (team_member_id + isodow(shift_date)) % 2 = 1 "
    "AS morning FROM staff_schedules",
)
def parity_predicate(d):
    morning = morning_shift(F.col("team_member_id"), F.col("shift_date"))
    return d.staff_schedules.select("id", "shift_date", morning.alias("morning"))


@query(
    "as_of_date_filter",
    "SELECT id, shift_date FROM staff_schedules WHERE shift_date >= DATE '2001-07-01'",
)
def as_of_date_filter(d):
    return upcoming(d.staff_schedules, "shift_date", "2001-07-01").select("id", "shift_date")


@query(
    "scoped_lookup",
    "SELECT id, team_member_id FROM staff_time_off_requests r WHERE EXISTS (SELECT 1 FROM events e "
    "WHERE e.event_id = r.id AND CASE WHEN e.value < 50 THEN e.user_id ELSE e.user_id + 1 END = "
    "r.team_member_id)",
)
def scoped_lookup(d):
    owner = F.when(F.col("value") < 50, F.col("user_id")).otherwise(F.col("user_id") + 1)
    asked = d.events.select(F.col("event_id").alias("id"), owner.alias("team_member_id"))
    found = scoped(asked, d.staff_time_off_requests, "id", "team_member_id")
    return found.select("id", "team_member_id")


@query(
    "column_compare",
    "SELECT id, clock_in_at, clock_out_at FROM staff_time_records WHERE clock_out_at > clock_in_at",
)
def column_compare(d):
    kept = d.staff_time_records.where(F.col("clock_out_at") > F.col("clock_in_at"))
    return kept.select("id", "clock_in_at", "clock_out_at")
