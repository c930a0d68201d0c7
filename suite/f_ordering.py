"""Row numbers, sorts, limits and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions import literal_stamp
from marquee.operators import paging
from marquee.operators.identity import one_per_email
from marquee.operators.joins import missing_in
from marquee.operators.ranking import number_rows, stagger
from marquee.plans.listings import RECORD_ORDER, TASK_ORDER, list_tasks, showtime_listing
from marquee.plans.schedules import bookable
from suite.registry import query

START = "2026-12-01 05:00:00"


@query(
    "row_number_slots",
    "SELECT m.id, m.title, "
    f"TIMESTAMP '{START}' + CAST(ROW_NUMBER() OVER (ORDER BY m.id) - 1 AS INT) * INTERVAL '3' HOUR "
    "AS start_time FROM movies m WHERE NOT EXISTS "
    "(SELECT 1 FROM watchlist w WHERE w.movie_id = m.id)",
)
def row_number_slots(d):
    listed = d.watchlist.select(F.col("movie_id").alias("id"))
    idle = missing_in(d.movies.select("id", "title"), listed, ["id"])
    return stagger(idle, ["id"], literal_stamp(START), 3 * 3600, "start_time")


@query(
    "sort_single",
    "SELECT id, created_at, status FROM staff_time_off_requests ORDER BY created_at DESC, id DESC",
)
def sort_single(d):
    order = [F.col("created_at").desc(), F.col("id").desc()]
    return d.staff_time_off_requests.orderBy(*order).select("id", "created_at", "status")


@query(
    "sort_multi",
    "SELECT id, work_date, clock_in_at, ROW_NUMBER() OVER (ORDER BY work_date DESC, "
    "clock_in_at DESC, id DESC) AS position FROM staff_time_records",
)
def sort_multi(d):
    records = d.staff_time_records.select("id", "work_date", "clock_in_at")
    return number_rows(records, RECORD_ORDER, "position")


@query(
    "sort_nulls_last",
    "SELECT id, due_date, due_sec, ROW_NUMBER() OVER (ORDER BY due_date ASC NULLS LAST, "
    "due_sec ASC NULLS LAST, id DESC) AS position FROM staff_tasks",
)
def sort_nulls_last(d):
    tasks = d.staff_tasks.select("id", "due_date", "due_sec")
    return number_rows(tasks, TASK_ORDER, "position")


@query(
    "paginate",
    "SELECT s.order_no, s.line_no, s.start_time, m.title AS movie_title, sc.name AS screen_name, "
    "t.name AS theater_name FROM showtimes s JOIN movies m ON m.id = s.movie_id "
    "JOIN screens sc ON sc.id = s.screen_id JOIN theaters t ON t.id = sc.theater_id "
    "ORDER BY s.start_time, s.order_no, s.line_no, s.movie_id, s.screen_id LIMIT 200 OFFSET 400",
)
def paginate(d):
    order = ["start_time", "order_no", "line_no", "movie_id", "screen_id"]
    named = lambda rows: showtime_listing(rows, d.movies, d.screens, d.theaters)
    page = paging.page_of(d.showtimes, order, page="3rd", limit="900", named=named)
    return page.rows.select(
        "order_no", "line_no", "start_time", "movie_title", "screen_name", "theater_name"
    )


@query(
    "page_with_total",
    "SELECT st.id, st.due_date, st.due_sec, tm.email, (SELECT CAST(COUNT(*) AS BIGINT) "
    "FROM staff_tasks WHERE status = 'PENDING') AS total FROM staff_tasks st "
    "JOIN team_members tm ON tm.id = st.team_member_id WHERE st.status = 'PENDING' "
    "ORDER BY st.due_date ASC NULLS LAST, st.due_sec ASC NULLS LAST, st.id DESC "
    "LIMIT 50 OFFSET 50",
)
def page_with_total(d):
    page = list_tasks(
        d.tables("staff_tasks", "team_members"), page=2, limit="many", status="pending"
    )
    return page.with_total().select("id", "due_date", "due_sec", "email", "total")


@query(
    "top_k",
    "SELECT id, title FROM movies WHERE status IN ('NOW_SHOWING', 'COMING_SOON') "
    "ORDER BY id LIMIT 3",
)
def top_k(d):
    return bookable(d.movies).orderBy("id").limit(3).select("id", "title")


@query(
    "limit_one",
    "SELECT LOWER(email) AS email, MIN(id) AS id FROM (SELECT id, email FROM users UNION ALL "
    "SELECT user_id + 7, 'CUSTOMER.' || LPAD(CAST(user_id AS VARCHAR), 9, '0') || '@EXAMPLE.COM' "
    "FROM events) AS everyone GROUP BY LOWER(email)",
)
def limit_one(d):
    spelled = F.concat(
        F.lit("CUSTOMER."), F.lpad(F.col("user_id").cast("string"), 9, "0"), F.lit("@EXAMPLE.COM")
    )
    again = d.events.select((F.col("user_id") + 7).alias("id"), spelled.alias("email"))
    return one_per_email(d.users.select("id", "email").unionByName(again))
