"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.operators import identity
from marquee.operators.filters import morning_shift
from marquee.operators.joins import (
    child_facts,
    first_by,
    missing_in,
    nest_children,
    semi_topk,
    with_each,
)
from marquee.operators.metrics import paid_by_user
from marquee.plans.listings import (
    booking_listing,
    showtime_listing,
    with_member,
    with_optional_theater,
    with_theater,
)
from marquee.plans.schedules import active_staff, bookable, resolve_slots, shift_start
from suite.domain import some_movie
from suite.registry import query


@query(
    "join_inner",
    "SELECT 'screen' AS kind, s.id, t.name AS parent FROM screens s JOIN theaters t "
    "ON t.id = s.theater_id UNION ALL SELECT 'task', st.id, tm.email FROM staff_tasks st "
    "JOIN team_members tm ON tm.id = st.team_member_id",
)
def join_inner(d):
    screens = with_theater(d.screens, d.theaters)
    tasks = with_member(d.staff_tasks, d.team_members)

    def flat(df, kind, parent):
        return df.select(F.lit(kind).alias("kind"), "id", F.col(parent).alias("parent"))

    return flat(screens, "screen", "theater_name").unionByName(flat(tasks, "task", "email"))


@query(
    "join_star",
    "SELECT s.order_no, s.line_no, s.start_time, CAST(s.price AS DOUBLE) AS price, "
    "m.title AS movie_title, sc.name AS screen_name, sc.total_seats AS screen_total_seats, "
    "t.name AS theater_name FROM showtimes s JOIN movies m ON m.id = s.movie_id "
    "JOIN screens sc ON sc.id = s.screen_id JOIN theaters t ON t.id = sc.theater_id",
)
def join_star(d):
    listing = showtime_listing(d.showtimes, d.movies, d.screens, d.theaters)
    return listing.select(
        "order_no",
        "line_no",
        "start_time",
        F.col("price").cast("double").alias("price"),
        "movie_title",
        "screen_name",
        "screen_total_seats",
        "theater_name",
    )


@query(
    "join_booking_detail",
    "SELECT l_orderkey AS order_no, l_linenumber AS line_no, l_partkey AS user_id, "
    "p_name AS user_email, c_name AS movie_title, o_orderdate AS start_time FROM lineitem "
    "JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey "
    "JOIN customer ON c_custkey = o_custkey",
)
def join_booking_detail(d):
    # The raw tables link lineitem to part, and lineitem to orders to customer; that is the
    # shape booking to user, and booking to showtime to movie.
    booked = d.lineitem.select(
        F.col("l_orderkey").alias("showtime_id"),
        F.col("l_partkey").alias("user_id"),
        F.col("l_orderkey").alias("order_no"),
        F.col("l_linenumber").alias("line_no"),
    )
    people = d.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("email"))
    shown = d.orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("movie_id"),
        F.col("o_orderdate").alias("start_time"),
    )
    films = d.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    return booking_listing(booked, people, shown, films).drop("showtime_id")


@query(
    "join_left",
    "SELECT tm.id, tm.theater_id, th.name AS theater_name FROM team_members tm "
    "LEFT JOIN theaters th ON th.id = tm.theater_id",
)
def join_left(d):
    return with_optional_theater(d.team_members, d.theaters).select(
        "id", "theater_id", "theater_name"
    )


@query(
    "join_composite_key",
    "SELECT s.order_no, s.line_no, m.id AS movie_id, sc.id AS screen_id FROM seed s "
    "JOIN movies m ON m.title = s.movie_title JOIN theaters th ON th.name = s.theater_name "
    "JOIN screens sc ON sc.theater_id = th.id AND sc.name = s.screen_name",
    let={
        "seed": "SELECT st.order_no, st.line_no, m.title AS movie_title, th.name AS theater_name, "
        "sc.name AS screen_name FROM showtimes st JOIN movies m ON m.id = st.movie_id "
        "JOIN screens sc ON sc.id = st.screen_id JOIN theaters th ON th.id = sc.theater_id"
    },
)
def join_composite_key(d):
    names = showtime_listing(d.showtimes, d.movies, d.screens, d.theaters).select(
        "order_no", "line_no", "movie_title", "theater_name", "screen_name"
    )
    return resolve_slots(names, d.movies, d.screens, d.theaters)


@query(
    "join_natural_key",
    "SELECT c.c_custkey AS member_id, th.id AS theater_id FROM customer c "
    "JOIN theaters th ON th.name = CONCAT('NATION_', CAST(c.c_custkey % 30 AS VARCHAR))",
)
def join_natural_key(d):
    named = d.customer.select(
        F.col("c_custkey").alias("member_id"),
        F.concat(F.lit("NATION_"), (F.col("c_custkey") % 30).cast("string")).alias("theater_name"),
    )
    halls = d.theaters.select(F.col("id").alias("theater_id"), F.col("name").alias("theater_name"))
    return named.join(halls, "theater_name").select("member_id", "theater_id")


@query(
    "join_cross",
    "SELECT tm.id AS team_member_id, r.code, r.weight FROM team_members tm CROSS JOIN "
    "(VALUES ('a', 1), ('b', NULL), ('b', 3), ('', 4), (NULL, 5)) AS r(code, weight)",
)
def join_cross(d):
    pairs = [("a", 1), ("b", None), ("b", 3), ("", 4), (None, 5)]
    rows = [[F.lit(code).cast("string"), F.lit(weight).cast("int")] for code, weight in pairs]
    members = d.team_members.select(F.col("id").alias("team_member_id"))
    return with_each(members, rows, ["code", "weight"])


@query(
    "join_constant_on",
    "SELECT tm.id AS team_member_id, r.quarter, r.opens FROM (VALUES "
    "(1, DATE '1999-01-01'), (2, DATE '1999-04-01'), (3, DATE '1999-07-01'), (4, NULL)) "
    "AS r(quarter, opens) JOIN team_members tm ON tm.role = 'STAFF' AND tm.status = 'ACTIVE'",
)
def join_constant_on(d):
    opens = ["1999-01-01", "1999-04-01", "1999-07-01", None]
    rows = [[F.lit(i), F.lit(day).cast("date")] for i, day in enumerate(opens, start=1)]
    staff = active_staff(d.team_members).select(F.col("id").alias("team_member_id"))
    return with_each(staff, rows, ["quarter", "opens"])


@query(
    "join_lateral_top1",
    "SELECT m.id AS movie_id, sc.name AS screen_name FROM movies m CROSS JOIN LATERAL "
    "(SELECT s.name FROM screens s ORDER BY s.id LIMIT 1) AS sc",
)
def join_lateral_top1(d):
    return d.movies.select(
        F.col("id").alias("movie_id"), first_by(d.screens, "id", "name").alias("screen_name")
    )


@query(
    "join_anti",
    "SELECT b.id, b.user_id FROM bookings b LEFT JOIN payments p ON p.booking_id = b.id "
    "WHERE b.status = 'CONFIRMED' AND p.booking_id IS NULL",
)
def join_anti(d):
    confirmed = d.bookings.where(F.col("status") == "CONFIRMED").select("id", "user_id")
    return missing_in(confirmed, d.payments.select(F.col("booking_id").alias("id")), ["id"])


CLICKS = (
    "SELECT DISTINCT user_id, event_id % (SELECT COUNT(*) FROM part) AS movie_id FROM events "
    "WHERE event_type = 'click' OR (event_type = 'view' AND event_id % 3 = 0)"
)


def clicked(d):
    kind = F.col("event_type")
    clicks = d.events.where((kind == "click") | ((kind == "view") & (F.col("event_id") % 3 == 0)))
    return clicks.select("user_id", some_movie(d).alias("movie_id")).distinct()


@query(
    "join_anti_composite",
    "SELECT user_id, movie_id FROM clicks EXCEPT SELECT user_id, movie_id FROM watchlist",
    let={"clicks": CLICKS},
)
def join_anti_composite(d):
    return missing_in(clicked(d), d.watchlist, ["user_id", "movie_id"])


@query(
    "join_anti_ci",
    "SELECT n.name FROM (SELECT UPPER(c_name) AS name FROM customer UNION ALL "
    "SELECT s_name FROM supplier) AS n WHERE NOT EXISTS (SELECT 1 FROM users u "
    "WHERE LOWER(u.first_name) = LOWER(n.name))",
)
def join_anti_ci(d):
    names = d.customer.select(F.upper("c_name").alias("name")).unionByName(
        d.supplier.select(F.col("s_name").alias("name"))
    )
    taken = d.users.select(F.col("first_name").alias("name"))
    return missing_in(names, taken, ["name"], ci=["name"])


@query(
    "join_anti_null_safe",
    "SELECT id, team_member_id, due_date, due_sec FROM staff_tasks o WHERE status = 'PENDING' "
    "AND NOT EXISTS (SELECT 1 FROM staff_tasks c WHERE c.status <> 'PENDING' "
    "AND c.team_member_id = o.team_member_id AND c.due_date IS NOT DISTINCT FROM o.due_date "
    "AND c.due_sec IS NOT DISTINCT FROM o.due_sec)",
)
def join_anti_null_safe(d):
    pending = F.col("status") == "PENDING"
    columns = ["id", "team_member_id", "due_date", "due_sec"]
    return missing_in(
        d.staff_tasks.where(pending).select(*columns),
        d.staff_tasks.where(~pending),
        ["team_member_id", "due_date", "due_sec"],
        null_safe=["due_date", "due_sec"],
    )


@query(
    "join_anti_expr",
    "SELECT r.id, r.team_member_id, r.work_date FROM staff_time_records r WHERE NOT EXISTS "
    "(SELECT 1 FROM taken s WHERE s.team_member_id = r.team_member_id "
    "AND s.work_date = r.work_date AND s.start_sec = CASE WHEN isodow(r.work_date) < 7 "
    "AND (r.team_member_id + isodow(r.work_date)) % 2 = 1 THEN 32400 ELSE 50400 END)",
    let={
        "taken": "SELECT team_member_id, due_date AS work_date, CASE WHEN due_sec < 43200 "
        "THEN 32400 ELSE 50400 END AS start_sec FROM staff_tasks"
    },
)
def join_anti_expr(d):
    taken = d.staff_tasks.select(
        "team_member_id",
        F.col("due_date").alias("work_date"),
        F.when(F.col("due_sec") < 43200, 32400).otherwise(50400).alias("start_sec"),
    )
    due = shift_start(morning_shift(F.col("team_member_id"), F.col("work_date")))
    return missing_in(
        d.staff_time_records.select("id", "team_member_id", "work_date"),
        taken,
        ["team_member_id", "work_date", "start_sec"],
        computed={"start_sec": due},
    )


@query(
    "join_semi_topk",
    "SELECT user_id, movie_id FROM watchlist WHERE movie_id IN (SELECT id FROM movies "
    "WHERE status IN ('NOW_SHOWING', 'COMING_SOON') ORDER BY id LIMIT 3)",
)
def join_semi_topk(d):
    return semi_topk(d.watchlist, bookable(d.movies), "movie_id", "id", 3)


@query(
    "join_then_aggregate",
    "SELECT b.user_id, CAST(ROUND(SUM(p.amount), 2) AS DOUBLE) AS paid_total FROM payments p "
    "JOIN bookings b ON b.id = p.booking_id WHERE p.status = 'PAID' GROUP BY b.user_id",
)
def join_then_aggregate(d):
    return paid_by_user(d.payments, d.bookings)


@query(
    "nest_children",
    "SELECT b.id, b.status, COALESCE(string_agg(s.seat_label || ' ' || CAST(s.price AS VARCHAR), ';' "
    "ORDER BY s.seat_label, s.price), '') AS seats FROM bookings b "
    "LEFT JOIN booking_seats s ON s.booking_id = b.id GROUP BY b.id, b.status",
)
def nest_children_query(d):
    """Every booking with its seats as an ordered array, written out for the comparison."""
    bookings = d.bookings.select("id", "status")
    nested = nest_children(
        bookings, d.booking_seats, "booking_id", ["seat_label", "price"], ["seat_label", "price"], "seats"
    )
    seat = lambda s: F.concat_ws(" ", s["seat_label"], s["price"].cast("string"))
    return nested.withColumn("seats", F.array_join(F.transform("seats", seat), ";"))


@query(
    "child_facts",
    "SELECT b.id, b.status, CAST(COUNT(s.seat_label) AS INT) AS seats, MIN(s.seat_label) "
    "AS first_label, MAX(s.seat_label) AS last_label, "
    "COALESCE(CAST(SUM(s.price) AS DOUBLE), 0) AS seat_total FROM bookings b "
    "LEFT JOIN booking_seats s ON s.booking_id = b.id GROUP BY b.id, b.status",
)
def child_facts_query(d):
    facts = [
        F.count("seat_label").cast("int").alias("seats"),
        F.min("seat_label").alias("first_label"),
        F.max("seat_label").alias("last_label"),
        F.sum("price").cast("double").alias("seat_total"),
    ]
    bookings = d.bookings.select("id", "status")
    return child_facts(bookings, d.booking_seats, "booking_id", facts).fillna(
        {"seats": 0, "seat_total": 0.0}
    )


_MAIL = "LOWER(TRIM(r.email, ' ' || chr(9)))"
_PEOPLE = "SELECT id, email FROM users"


def people(d):
    return d.users.select("id", "email")


@query(
    "resolve_identity_fallback",
    "SELECT r.request_id, COALESCE(a.id, b.id) AS user_id FROM requests r "
    "LEFT JOIN people a ON a.id = NULLIF(r.id, 0) "
    f"LEFT JOIN people b ON LOWER(b.email) = {_MAIL}",
    let={"people": _PEOPLE},
)
def resolve_identity_fallback(d):
    return identity.resolve_user(d.requests, people(d)).select("request_id", "user_id")


@query(
    "resolve_identity_exclusive",
    "SELECT r.request_id, COALESCE(a.id, b.id) AS user_id FROM requests r "
    "LEFT JOIN people a ON r.id >= 1 AND a.id = r.id "
    f"LEFT JOIN people b ON (r.id IS NULL OR r.id < 1) AND LOWER(b.email) = {_MAIL}",
    let={"people": _PEOPLE},
)
def resolve_identity_exclusive(d):
    return identity.resolve_user_strict(d.requests, people(d)).select("request_id", "user_id")


@query(
    "resolve_member",
    "SELECT r.request_id, COALESCE(NULLIF(r.id, 0), m.id) AS any_id, "
    "COALESCE(CASE WHEN r.id >= 1 THEN r.id END, m.id) AS positive_id FROM requests r "
    f"LEFT JOIN people m ON LOWER(m.email) = {_MAIL}",
    let={"people": _PEOPLE},
)
def resolve_member(d):
    loose = identity.resolve_member(d.requests, people(d))
    loose = loose.withColumnRenamed("team_member_id", "any_id")
    strict = identity.resolve_member(loose, people(d), positive_only=True)
    return strict.select("request_id", "any_id", F.col("team_member_id").alias("positive_id"))
