"""Generators of rows: each test states its own few rows and works its result out from them."""

from __future__ import annotations

from datetime import date, datetime

from marquee.operators import metrics
from marquee.operators.changes import insert_missing
from marquee.plans import schedules
from marquee.plans.bookings import backfill_payments
from marquee.plans.listings import list_showtimes, with_optional_theater
from marquee.schema import TABLES
from marquee.session import durable
from marquee.sources import conform, values_df
from pyspark.sql import functions as F

NOW = "2024-05-01 00:00:00"


def table(spark, name, columns, rows):
    if not rows:
        return spark.createDataFrame([], TABLES[name].ddl)
    return conform(values_df(spark, columns, rows), name, NOW)


def movies(spark, *rows):
    return table(spark, "movies", "id bigint, title string, duration_min int, status string", rows)


def members(spark, *rows):
    kinds = "id bigint, email string, role string, status string, department string, theater_id bigint"
    return table(spark, "team_members", kinds, rows)


def hall(spark):
    theaters = table(spark, "theaters", "id bigint, name string", [(40, "North")])
    kinds = "id bigint, theater_id bigint, name string"
    return theaters, table(spark, "screens", kinds, [(9, 40, "Red"), (7, 40, "Blue")])


def test_a_title_known_in_other_letters_is_not_added(spark):
    current = movies(spark, (1, "alpha", 60, "ARCHIVED"), (2, "Beta", 61, "ARCHIVED"))
    batch = values_df(spark, "title string", [("ALPHA",), ("Gamma",)])
    once = durable(insert_missing(current, batch, ["title"], ci=["title"]))
    assert once.count() == 3
    assert insert_missing(once, batch, ["title"], ci=["title"]).count() == 3


def test_shifts_skip_sundays_and_whoever_is_not_active_staff(spark):
    people = members(
        spark,
        (2, "p@x", "STAFF", "ACTIVE", "box desk", None),
        (3, "q@x", "STAFF", "INACTIVE", "Floor", None),
        (4, "r@x", "MANAGER", "ACTIVE", "Floor", None),
        (5, "s@x", "STAFF", "ACTIVE", None, None),
    )
    # Sunday 1 June to Tuesday 10 June: two Sundays, eight other days.
    make = lambda known: schedules.generate_shifts(people, "2025-06-01", "2025-06-10", known)
    shifts = durable(make(table(spark, "staff_schedules", "", [])))
    got = {(r.team_member_id, r.shift_date.day): r for r in shifts.collect()}
    assert sorted(got) == [(m, d) for m in (2, 5) for d in (2, 3, 4, 5, 6, 7, 9, 10)]
    assert {r.role_on_shift for (m, _), r in got.items() if m == 2} == {"Box Office"}
    assert {r.role_on_shift for (m, _), r in got.items() if m == 5} == {"Guest Support"}
    # Mornings of even ids: Monday, Wednesday, Friday.
    assert [d for (m, d), r in sorted(got.items()) if m == 2 and r.start_sec == 32400] == [2, 4, 6, 9]
    assert make(shifts).count() == 0
    gap = shifts.where(F.col("shift_date") != date(2025, 6, 4))
    assert {(r.team_member_id, r.shift_date.day) for r in make(gap).collect()} == {(2, 4), (5, 4)}


def test_rows_for_each_member_with_a_null_in_the_key(spark):
    people = members(
        spark,
        (1, "a@x", "STAFF", "ACTIVE", None, None),
        (2, "b@x", "ADMIN", "ACTIVE", None, None),
        (3, "c@x", "STAFF", "ACTIVE", None, None),
    )
    rows = [
        [F.lit(title), F.lit(due).cast("date")]
        for title, due in (("first", "2024-01-31"), ("second", None), ("third", None))
    ]

    def build(known, **how):
        keys = ["title", "due_date"]
        return schedules.assign_members(people, rows, keys, known, keys, **how)

    given = durable(build(table(spark, "staff_tasks", "", [])))
    assert given.count() == 6
    assert build(given, null_safe=["due_date"]).count() == 0
    # Compared plainly a null date equals nothing: two rows for each of two members.
    assert build(given).count() == 4


def test_watchlist_takes_the_first_bookable_movies(spark):
    films = movies(
        spark,
        (14, "d", 50, "NOW_SHOWING"),
        (12, "c", 50, "COMING_SOON"),
        (10, "a", 50, "ARCHIVED"),
        (11, "b", 50, "NOW_SHOWING"),
    )
    kinds = "id bigint, email string, role string"
    users = [(5, "e@x", "CUSTOMER"), (6, "f@x", "STAFF"), (7, "g@x", "CUSTOMER")]
    users = table(spark, "users", kinds, users)
    known = table(spark, "watchlist", "user_id bigint, movie_id bigint", [(5, 12), (6, 14)])
    pairs = schedules.seed_watchlist(users, films, known, k=2)
    assert sorted((r.user_id, r.movie_id) for r in pairs.collect()) == [(5, 11), (7, 11), (7, 12)]


def test_templates_run_daily_past_midnight_and_leap_day(spark):
    films, (theaters, screens) = movies(spark, (3, "Kite", 80, "NOW_SHOWING")), hall(spark)
    kinds = (
        "movie_title string, theater_name string, screen_name string, start_sec int, "
        "duration_min int, price string"
    )
    templates = [
        ("Kite", "North", "Blue", 82800, 80, "9.50"),
        ("Kite", "Nowhere", "Blue", 82800, 80, "9.50"),
        ("Stone", "North", "Red", 82800, 80, "9.50"),
    ]
    listed = [(1, 3, 7, "2024-02-29 01:00:00")]
    listed = table(
        spark, "showtimes", "id bigint, movie_id bigint, screen_id bigint, start_time string", listed
    )
    made = schedules.generate_showtimes(
        values_df(spark, kinds, templates),
        "2024-02-27", "2024-03-01", films, screens, theaters, listed, shift_hours=2,
    )
    got = sorted((r.movie_id, r.screen_id, r.start_time, r.end_time) for r in made.collect())
    # 23:00 and two hours; the one of 28 February is listed already.
    assert got == [
        (3, 7, datetime(y, m, d, 1), datetime(y, m, d, 2, 20))
        for y, m, d in ((2024, 2, 28), (2024, 3, 1), (2024, 3, 2))
    ]


def test_idle_movies_get_slots_a_step_apart(spark):
    films = movies(spark, *[(i, f"m{i}", 45, "ARCHIVED") for i in (9, 3, 5)])
    shown = table(
        spark, "showtimes", "id bigint, movie_id bigint, screen_id bigint, start_time string",
        [(1, 3, 9, "2020-01-01 00:00:00"), (2, 3, 9, "2020-01-02 00:00:00")],
    )
    slots = schedules.fallback_slots(films, hall(spark)[1], shown, "2024-05-05 22:30:00")
    assert [(r.movie_id, r.screen_id, r.start_time, r.end_time) for r in slots.orderBy("movie_id").collect()] == [
        (5, 7, datetime(2024, 5, 5, 22, 30), datetime(2024, 5, 6, 0, 30)),
        (9, 7, datetime(2024, 5, 6, 1, 30), datetime(2024, 5, 6, 3, 30)),
    ]


def test_pages_join_up_over_a_tie(spark):
    theaters, screens = hall(spark)
    days = [(11, 4), (12, 2), (13, 2), (14, 2), (15, 9), (16, 1), (17, 2)]
    shown = table(
        spark, "showtimes", "id bigint, movie_id bigint, screen_id bigint, start_time string",
        [(i, 3, 9, f"2024-05-0{d} 20:00:00") for i, d in days],
    )
    t = {
        "showtimes": shown,
        "movies": movies(spark, (3, "Kite", 80, "NOW_SHOWING")),
        "screens": screens,
        "theaters": theaters,
    }
    pages = [list_showtimes(t, page=p, limit=3) for p in range(1, 5)]
    assert pages[0].total.first().total == 7
    assert [[r.id for r in p.rows.collect()] for p in pages] == [[16, 12, 13], [14, 17, 11], [15], []]


def test_work_summary(spark):
    people = members(
        spark,
        (1, "a@x", "STAFF", "ACTIVE", None, None),
        (2, "b@x", "ADMIN", "ACTIVE", None, None),
    )
    records = table(
        spark, "staff_time_records",
        "team_member_id bigint, work_date string, clock_in_at string, clock_out_at string, "
        "break_minutes int, status string",
        [
            (1, "2024-05-01", "2024-05-01 08:00:00", "2024-05-01 12:30:00", 30, "COMPLETED"),
            (1, "2024-05-02", "2024-05-02 23:00:00", "2024-05-03 01:15:00", 0, "COMPLETED"),
            (1, "2024-05-03", "2024-05-03 08:00:00", None, 0, "CLOCKED_IN"),
        ],
    )
    shifts = table(
        spark, "staff_schedules",
        "team_member_id bigint, shift_date string, start_sec int, end_sec int, status string",
        [
            (1, "2024-05-02", 0, 60, "SCHEDULED"),
            (1, "2024-05-03", 0, 60, "SCHEDULED"),
            (1, "2024-05-08", 0, 60, "SCHEDULED"),
        ],
    )
    tasks = table(
        spark, "staff_tasks", "team_member_id bigint, title string, status string",
        [(1, "x", "COMPLETED"), (1, "y", "PENDING"), (1, "z", "IN_PROGRESS"), (1, "w", "PENDING")],
    )
    away = table(
        spark, "staff_time_off_requests",
        "team_member_id bigint, request_type string, start_date string, end_date string, status string",
        [(1, "OTHER", "2024-06-01", "2024-06-01", s) for s in ("PENDING", "APPROVED")],
    )
    rows = metrics.work_summary(people, records, shifts, tasks, away, "2024-05-03").collect()
    got = {r.team_member_id: r.asDict() for r in rows}
    assert got[1] == {
        "team_member_id": 1,
        "total_hours": 6.25,
        "shifts_completed": 0,
        "tasks_completed": 1,
        "pending_time_off_requests": 1,
        "upcoming_shifts": 2,
        "open_tasks": 3,
    }
    assert {v for k, v in got[2].items() if k != "team_member_id"} == {0}


def test_nothing_booked_yet(spark):
    bookings, payments, watchlist = (table(spark, n, "", []) for n in ("bookings", "payments", "watchlist"))
    users = table(spark, "users", "id bigint, email string", [(1, "a@x"), (2, "b@x")])
    assert tuple(metrics.revenue(payments).first()) == (0, 0.0)
    assert backfill_payments(bookings, payments, NOW).count() == 0
    per_user = metrics.profile_metrics(users, watchlist, bookings, payments)
    assert [tuple(r)[2:] for r in per_user.collect()] == [(0, 0, 0.0)] * 2


def test_member_without_theater(spark):
    people = members(
        spark,
        (1, "a@x", "STAFF", "ACTIVE", None, 40),
        (2, "b@x", "STAFF", "ACTIVE", None, None),
    )
    rows = with_optional_theater(people, hall(spark)[0]).collect()
    assert {r.email: r.theater_name for r in rows} == {"a@x": "North", "b@x": None}
