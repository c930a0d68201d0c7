"""Batches taken in end to end."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from marquee.operators import changes
from marquee.operators.payloads import normalize
from marquee.plans.accounts import add_members, register
from marquee.plans.bookings import booking_with_seats
from marquee.plans.staff import admit
from marquee.sources import conform, values_df

NOW = "2026-02-18 09:00:00"
MEMBERS = [(1, "ann@example.com"), (4, "bob@example.com")]


def test_tasks_are_admitted(spark):
    members = values_df(spark, "id bigint, email string", MEMBERS)
    current = values_df(spark, "id bigint", [(10,)])
    raw = values_df(
        spark,
        "n bigint, teamMemberId string, email string, title string, description string, "
        "priority string, dueDate string, dueTime string, status string",
        [
            (1, "77", None, " Sweep ", "", None, None, "10:00", "completed"),
            (2, None, " BOB@example.com", "Count", "all", "low", "2026-03-01", None, None),
            (3, "0", "who@example.com", "Count", None, None, None, None, None),
            (4, "1", None, "", None, None, None, None, None),
        ],
    )
    rows, rejected = admit(raw, "staff_tasks", current, members, "n", NOW)
    got = {r.id: r for r in rows.collect()}
    assert sorted(got) == [11, 12]
    assert (got[11].team_member_id, got[11].title, got[11].due_sec) == (77, "Sweep", 36000)
    assert got[11].completed_at == datetime(2026, 2, 18, 9)
    assert (got[12].team_member_id, got[12].priority, got[12].status) == (4, "LOW", "PENDING")
    assert got[12].completed_at is None and got[11].description is None
    assert {r.n: r.error for r in rejected.collect()} == {
        3: "Team member not found.",
        4: "title is required.",
    }


def test_registrations(spark):
    users = values_df(spark, "id bigint, email string", [(5, "ann@example.com")])
    raw = values_df(
        spark,
        "n bigint, firstName string, lastName string, email string, phone string, role string, "
        "password_hash string",
        [
            (1, "A", "B", "Ann@example.com ", None, None, "h1"),
            (2, "C", "D", "cy@example.com", "", "staff", "h2"),
            (3, "C", "D", "CY@example.com", None, None, "h3"),
            (4, "C", "", "di@example.com", None, None, "h4"),
        ],
    )
    rows, rejected = register(users, raw, "n", NOW, ["password_hash"])
    row = rows.collect()
    assert [(r.id, r.email, r.role, r.phone, r.password_hash) for r in row] == [
        (6, "cy@example.com", "STAFF", None, "h2")
    ]
    taken = "An account with this email already exists."
    assert {r.n: r.error for r in rejected.collect()} == {
        1: taken,
        3: taken,
        4: "Please fill in all required fields.",
    }


def test_new_members_get_accounts(spark):
    members = conform(values_df(spark, "id bigint, email string", MEMBERS), "team_members", NOW)
    users = conform(
        values_df(
            spark,
            "id bigint, email string, first_name string, password_hash string",
            [(3, "eve@example.com", "Old", "own")],
        ),
        "users",
        "2020-01-01 00:00:00",
    )
    raw = values_df(
        spark,
        "firstName string, lastName string, email string, phone string, role string, "
        "department string, status string, theaterId string, hiredAt string",
        [
            ("Eve", "F", "EVE@example.com", "1", "admin", None, None, "2", "2026-01-01"),
            ("Gus", "H", "gus@example.com", "", "manager", "", None, None, None),
        ],
    )
    new = normalize(raw, "team_members", []).drop("error")
    all_members, accounts = add_members(members, users, new, "start", NOW)
    assert sorted((r.id, r.email) for r in all_members.collect()) == MEMBERS + [
        (5, "eve@example.com"),
        (6, "gus@example.com"),
    ]
    got = {r.email: r for r in accounts.collect()}
    eve, gus = got["eve@example.com"], got["gus@example.com"]
    assert (eve.id, eve.first_name, eve.role, eve.password_hash) == (3, "Eve", "ADMIN", "own")
    assert (gus.id, gus.role, gus.phone, gus.password_hash) == (4, "STAFF", None, "start")
    assert eve.created_at == datetime(2020, 1, 1) and eve.updated_at == gus.created_at


def test_changes_of_one_key_take_effect_in_order(spark):
    users = values_df(
        spark,
        "id bigint, email string, first_name string, phone string, profile_photo string",
        [(1, "a@b.c", "A", "1", "p")],
    )
    patch = values_df(
        spark,
        "n int, id bigint, first_name string, phone string, profile_photo string, given boolean",
        [
            (1, 1, "B", "2", "q", True),
            (2, 1, None, "3", None, False),
            (3, 1, "C", None, "", True),
            (4, 1, None, None, "ignored", False),
        ],
    )
    flags = {"profile_photo": "given"}
    out = changes.update_sparse(users, patch, ["first_name", "phone"], flags, NOW, seq="n")
    assert [tuple(r) for r in out.collect()] == [(1, "a@b.c", "C", "3", "")]

    new = values_df(
        spark,
        "n int, email string, first_name string, phone string",
        [(1, "a@b.c", "X", "8"), (2, "a@b.c", "Y", "9"), (3, "z@b.c", "Z", "7"), (4, "z@b.c", "W", "6")],
    )
    out = changes.upsert(users, new, "email", ["first_name"], NOW, seq="n")
    assert sorted(tuple(r)[:4] for r in out.collect()) == [
        (1, "a@b.c", "Y", "1"),
        (2, "z@b.c", "W", "7"),
    ]

    full = patch.select("n", "id", "first_name", "phone")
    out = changes.update_full(users, full, ["first_name", "phone"], NOW, seq="n")
    assert [tuple(r)[2:4] for r in out.collect()] == [(None, None)]


def test_booking_with_seats(spark):
    stamp = F.lit("2026-01-01 10:00:00").cast("timestamp_ntz")
    one = lambda schema, *rows: values_df(spark, schema, list(rows))
    bookings = one("id bigint, user_id bigint, showtime_id bigint", (1, 7, 3), (2, 7, 3))
    users = one("id bigint, email string", (7, "a@b.c"))
    showtimes = one("id bigint, movie_id bigint", (3, 9)).withColumn("start_time", stamp)
    movies = one("id bigint, title string", (9, "Dunes"))
    seats = one(
        "id bigint, booking_id bigint, seat_label string, price decimal(10,2)",
        (12, 1, "B1", "2"),
        (11, 1, "C1", "1"),
    ).withColumn("created_at", stamp)
    rows = booking_with_seats(bookings, users, showtimes, movies, seats).orderBy("id").collect()
    assert [[s.seat_label for s in r.seats] for r in rows] == [["C1", "B1"], []]
    assert (rows[0].movie_title, rows[0].user_email) == ("Dunes", "a@b.c")
