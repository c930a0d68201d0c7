"""Edge rows made by hand."""

from __future__ import annotations

import math
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marquee import functions as fn
from marquee.functions.text import WHITESPACE
from marquee.operators import changes, filters, identity, metrics, paging, quality
from marquee.operators.payloads import normalize, split
from marquee.plans import accounts, listings
from marquee.plans.bookings import take_bookings
from marquee.sources import conform, date_series, values_df

NOW = "2026-02-18 09:00:00"


def column(df, name):
    return [r[name] for r in df.collect()]


def texts(spark, *values):
    return values_df(spark, "n int, c string", list(enumerate(values)))


@pytest.mark.parametrize(
    ("page", "expected"), [(0, 1), (-1, 1), ("x", 1), (None, 1), ("2b", 2), ("", 1), (7, 7)]
)
def test_page_number(page, expected):
    assert paging.clamp_page(page) == expected


@pytest.mark.parametrize(
    ("limit", "expected"), [(0, 50), (201, 200), ("x", 50), (None, 50), ("1000000000", 200), (1, 1)]
)
def test_page_size(limit, expected):
    assert paging.clamp_limit(limit) == expected


def test_items_have_larger_pages():
    bounds = (paging.ITEMS_DEFAULT_LIMIT, paging.ITEMS_MAX_LIMIT)
    assert paging.clamp_limit(None, *bounds) == 100
    assert paging.clamp_limit(501, *bounds) == 500


def test_trim_removes_every_kind_of_space(spark):
    df = texts(spark, *[c + "a b" + c for c in WHITESPACE], "\u200ba", "")
    assert column(df.select(fn.strip(F.col("c")).alias("c")), "c") == (
        ["a b"] * len(WHITESPACE) + ["\u200ba", ""]
    )


def test_number_prefixes(spark):
    df = texts(spark, "12abc", " -3.9", "abc", "", None, "+7", "99999999999999999999", "1e3")
    out = df.orderBy("n").select(
        fn.parse_int(F.col("c")).alias("i"), fn.parse_float(F.col("c")).alias("f")
    )
    assert column(out, "i") == [12, -3, None, None, None, 7, None, 1]
    assert column(out, "f") == [12.0, -3.9, None, None, None, 7.0, 1e20, 1000.0]


def test_money_prefix_rounds_half_away_from_zero(spark):
    df = texts(spark, "1.005", "-1.005", ".5 THB", "123456789.00")
    assert column(df.orderBy("n").select(fn.parse_money(F.col("c")).alias("m")), "m") == [
        Decimal("1.01"),
        Decimal("-1.01"),
        Decimal("0.50"),
        None,
    ]


def test_dates_and_clocks(spark):
    df = texts(spark, "2026-02-30", "2026-02-28", "2026", "10:30", "24:00", "23:59:59", "9:05")
    out = df.orderBy("n").select(
        fn.parse_date(F.col("c")).alias("d"), fn.parse_clock(F.col("c")).alias("s")
    )
    assert [d and d.isoformat() for d in column(out, "d")] == [None, "2026-02-28"] + [None] * 5
    assert column(out, "s") == [None, None, None, 37800, None, 86399, 32700]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Bangkok", "America/New_York"])
def test_zoned_text_is_read_as_utc(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = texts(spark, "2026-02-19T10:00:00+07:00", "2026-02-19T03:00:00Z", "2026-02-19 03:00:00")
        # In New York both are 01:30, before and after the clock goes back.
        twice = texts(spark, "2026-11-01T05:30:00.25Z", "2026-11-01T06:30:00.25Z").orderBy("n")
        assert column(twice.select(fn.parse_stamp(F.col("c")).alias("t")), "t") == [
            datetime(2026, 11, 1, hour, 30, 0, 250_000) for hour in (5, 6)
        ]
        out = column(df.select(fn.parse_stamp(F.col("c")).alias("t")), "t")
        # 02:30 does not exist in New York that night; plain clock readings keep it.
        odd = texts(spark, "2026-03-08 02:30:00")
        assert column(odd.select(fn.parse_stamp(F.col("c")).alias("t")), "t") == [
            datetime(2026, 3, 8, 2, 30)
        ]
        local = values_df(spark, "t timestamp_ntz", [("2026-03-08 02:30:00",)])
        assert column(local.select(fn.to_utc(F.col("t"), "+07:00").alias("u")), "u") == [
            datetime(2026, 3, 7, 19, 30)
        ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert out == [datetime(2026, 2, 19, 3)] * 3


def test_date_series_has_both_ends(spark):
    days = [d.isoformat() for d in column(date_series(spark, "2024-02-28", "2024-03-01"), "day")]
    assert days == ["2024-02-28", "2024-02-29", "2024-03-01"]


def test_conform_adds_columns_and_defaults(spark):
    loose = values_df(spark, "id int, title string, status string", [(1, "T", None)])
    row = conform(loose, "movies", NOW).first()
    assert (row.status, row.description, row.created_at) == (
        "COMING_SOON",
        None,
        datetime(2026, 2, 18, 9),
    )


@pytest.fixture(scope="module")
def members(spark):
    return values_df(
        spark,
        "id bigint, first_name string, last_name string, email string, role string, "
        "department string, status string, theater_id bigint",
        [
            (1, "Ann", "Bo", "ann@example.com", "STAFF", None, "ACTIVE", 5),
            (2, "Cy", "Di", "CY_D@example.com", "ADMIN", "Box 100%", "ON_LEAVE", None),
            (3, "Ed", "Fu", "cy_d@Example.com", "STAFF", "Floor", "ACTIVE", 6),
        ],
    )


def test_status_filters(spark, members):
    t = {"movies": values_df(spark, "id bigint, status string", [(1, "ARCHIVED"), (2, "X")])}
    ids = lambda p: column(p.rows, "id")
    assert ids(listings.list_movies(t, status="archived")) == [1]
    # Movies keep the blanks of the parameter, members do not.
    assert ids(listings.list_movies(t, status=" ARCHIVED ")) == []
    assert ids(listings.list_movies(t, status="NOPE")) == []
    t = {"team_members": members, "theaters": values_df(spark, "id bigint, name string", [(5, "C")])}
    assert ids(listings.list_members(t, status=" on_leave ")) == [2]
    assert ids(listings.list_members(t, role="staff")) == [3, 1]
    assert ids(listings.list_members(t)) == [3, 2, 1]


def test_zero_is_not_a_filter_but_a_negative_number_is(spark):
    t = {
        "screens": values_df(spark, "id bigint, theater_id bigint, name string", [(1, 5, "S")]),
        "theaters": values_df(spark, "id bigint, name string", [(5, "C")]),
    }
    assert listings.list_screens(t, theater_id=0).rows.count() == 1
    assert listings.list_screens(t, theater_id="x").rows.count() == 1
    assert listings.list_screens(t, theater_id=-1).rows.count() == 0


def test_search(members):
    found = lambda q: sorted(column(filters.text_search(members, q), "id"))
    assert found("NN B") == [1]
    assert found("100%") == [2]
    assert found("y_d") == [2, 3]
    assert found(" floor ") == [3]
    assert found("box 100\\%") == [2]
    assert found("f\\loor") == [3]
    assert found("y\\_d") == [2, 3]
    assert found("\\\\a") == []
    assert found("") == [1, 2, 3]


def test_open_ended_dates(spark):
    df = values_df(spark, "d date", [("2024-01-01",), ("2024-01-02",), ("2024-01-03",)])
    count = lambda **k: filters.date_range(df, "d", **k).count()
    assert count(start="2024-01-02") == 2
    assert count(end="2024-01-02") == 2
    assert count(start="2024-01-02", end="2024-01-02") == 1
    assert count() == 3


def test_identities(spark, members):
    requests = values_df(
        spark,
        "n int, id bigint, email string",
        [
            (0, 1, "cy_d@example.com"),
            (1, 99, " CY_D@Example.com\t"),
            (2, None, "Ann@Example.com"),
            (3, None, None),
            (4, 0, "nobody@example.com"),
            (5, -4, "ann@example.com"),
        ],
    )
    got = lambda df, c: column(df.orderBy("n"), c)
    assert got(identity.resolve_user(requests, members), "user_id") == [1, 2, 1, None, None, 1]
    assert got(identity.resolve_user_strict(requests, members), "user_id") == [
        1, None, 1, None, None, 1,
    ]
    loose = identity.resolve_member(requests, members)
    assert got(loose, "team_member_id") == [1, 99, 1, None, None, -4]
    strict = identity.resolve_member(requests, members, positive_only=True)
    assert got(strict, "team_member_id") == [1, 99, 1, None, None, 1]


def test_unknown_email_in_listings(spark, members):
    tasks = values_df(
        spark,
        "id bigint, team_member_id bigint, due_date date, due_sec int, status string",
        [
            (1, 1, "2024-01-02", None, "PENDING"),
            (2, 2, None, 60, "PENDING"),
            (3, 1, "2024-01-02", 60, "COMPLETED"),
            (4, 1, None, None, "PENDING"),
        ],
    )
    t = {"staff_tasks": tasks, "team_members": members}
    ids = lambda **k: column(listings.list_tasks(t, **k).rows, "id")
    assert ids() == [3, 1, 2, 4]
    assert ids(email="ANN@example.com") == [3, 1, 4]
    assert ids(email="who@example.com") == [3, 1, 2, 4]
    assert ids(email="who@example.com", unresolved="none") == []
    assert ids(team_member_id="2", email="ann@example.com") == [2]
    assert listings.list_tasks(t, email="who@example.com").total.first().total == 4
    shifts = values_df(
        spark,
        "id bigint, team_member_id bigint, shift_date date, start_sec int",
        [(1, 1, "2024-01-02", 9), (2, 1, "2024-01-01", 9), (3, 2, "2024-01-01", 9)],
    )
    t["staff_schedules"] = shifts
    ids = lambda **k: column(listings.list_schedules(t, **k), "id")
    assert ids(email="ann@example.com") == [2, 1]
    assert ids(team_member_id=-3, email="ann@example.com") == [2, 1]
    assert ids(email="who@example.com") == []
    assert ids() == []


def test_hours(spark):
    records = values_df(
        spark,
        "team_member_id bigint, clock_in_at timestamp_ntz, clock_out_at timestamp_ntz, "
        "break_minutes int, status string",
        [
            (1, "2026-01-01 09:00:00", None, 0, "COMPLETED"),
            (2, "2026-01-01 09:00:00", "2026-01-01 10:00:00", 90, "COMPLETED"),
            (3, "2026-01-01 09:00:00", "2026-01-01 08:00:00", 0, "COMPLETED"),
            (4, "2026-01-01 09:00:00", "2026-01-01 16:59:59.5", 0, "COMPLETED"),
            (5, "2026-01-01 09:00:00", "2026-01-01 17:00:00", 59, "COMPLETED"),
            (6, "2026-01-01 09:00:00", "2026-01-01 17:00:00", 59, "CLOCKED_IN"),
            (7, "2026-01-01 00:00:00", "2026-01-01 00:00:18", 0, "COMPLETED"),
            (8, "2026-01-01 00:00:00", "2026-01-01 00:00:17.999999", 0, "COMPLETED"),
        ],
    )
    hours = {r[0]: r[1] for r in metrics.net_hours(records).collect()}
    assert hours == {1: 0.0, 2: 0.0, 3: 0.0, 4: 8.0, 5: 7.02, 7: 0.01, 8: 0.0}


def test_revenue_ranges(spark):
    payments = values_df(
        spark,
        "amount decimal(10,2), status string, paid_at timestamp_ntz, created_at timestamp_ntz",
        [
            ("1.00", "PAID", "2026-02-18 00:00:00", "2020-01-01 00:00:00"),
            ("2.00", "PAID", None, "2026-02-16 00:00:00"),
            ("4.00", "PAID", "2026-02-15 23:59:59", "2026-02-18 00:00:00"),
            ("8.00", "PAID", "2030-01-01 00:00:00", "2020-01-01 00:00:00"),
            ("0.00", "PAID", None, "2019-01-01 00:00:00"),
            ("16.00", "FAILED", "2026-02-18 10:00:00", "2026-02-18 10:00:00"),
        ],
    )
    rows = {r.range: tuple(r)[1:] for r in metrics.revenue_all_ranges(payments, NOW).collect()}
    assert rows == {"today": (2, 9.0), "week": (3, 11.0), "month": (4, 15.0), "all": (5, 15.0)}
    for rng, expected in {**rows, " Month ": (4, 15.0), "year": (3, 11.0), None: (3, 11.0)}.items():
        assert tuple(metrics.revenue(payments, rng, NOW).first()) == expected


def test_patches(spark):
    users = values_df(
        spark,
        "id bigint, first_name string, last_name string, email string, phone string, "
        "profile_photo string, updated_at timestamp_ntz",
        [
            (i, "A", "B", f"u{i}@example.com", "1", "p.jpg", "2020-01-01 00:00:00")
            for i in range(1, 6)
        ],
    )
    raw = values_df(
        spark,
        "id bigint, email string, firstName string, lastName string, phone string, "
        "profilePhoto string, profilePhotoProvided boolean",
        [
            (1, None, None, None, None, None, None),
            (2, None, None, None, " ", None, None),
            (None, "U3@example.com", None, None, None, "", True),
            (4, None, "Z ", None, None, None, False),
            (5, None, " ", None, "2", None, None),
            (9, None, "Z", None, None, None, None),
        ],
    )
    good, bad = split(normalize(raw, "profiles", ["id", "email"]))
    assert {r.id: r.error for r in bad.collect()} == {
        1: "No updatable fields provided.",
        5: "firstName and lastName cannot be empty.",
    }
    rows = {r.id: r for r in accounts.patch_profiles(users, good, NOW).collect()}
    assert len(rows) == 5
    assert (rows[2].phone, rows[2].updated_at) == ("1", datetime(2026, 2, 18, 9))
    assert (rows[3].profile_photo, rows[3].phone) == ("", "1")
    assert (rows[4].first_name, rows[4].profile_photo) == ("Z", "p.jpg")
    assert rows[1].updated_at == rows[5].updated_at == datetime(2020, 1, 1)


BOOKING = (
    "doc_id bigint, userId string, showtimeId string, status string, totalAmount string, "
    "seats array<struct<seatLabel:string,price:string>>, paymentMethod string, "
    "paymentStatus string, transactionRef string"
)


def test_booking_documents(spark):
    rows = [
        (1, "1", "2", None, "10", None, None, None, None),
        (2, "1", "2", None, "10", [("A1", "5"), (" ", "5")], None, None, None),
        (3, "1", "2", "pending", "12abc", [(" A1 ", "12abc"), ("A2", "1")], "card", None, " r "),
        (4, "1", "2", None, "10", [("A1", "-1")], "cash", "pending", ""),
        (5, "1", "2", None, "10", [], "CASH", "pending", ""),
        (6, "0", "2", None, "10", [], None, None, None),
        (7, "1", "2", "", "10", [], None, None, None),
        (8, "1", "2", None, "-1", [], None, None, None),
        (9, "1", "2", None, "10", [], "coins", None, None),
        (10, "1", "2", None, "10", [], "card", "lost", None),
        (11, "1", "2", None, "10", [], None, "lost", None),
    ]
    docs = spark.createDataFrame(rows, BOOKING)
    out, bad = take_bookings(docs, "doc_id", NOW, (100, 200, 300))
    seats = "Each seat must include seatLabel and non-negative price."
    assert {r.doc_id: r.error for r in bad.collect()} == {
        2: seats,
        4: seats,
        6: "userId is required.",
        7: "Invalid status.",
        8: "totalAmount must be 0 or greater.",
        9: "Invalid paymentMethod.",
        10: "Invalid paymentStatus.",
    }
    booked = out.bookings.orderBy("id").collect()
    assert [(r.id, r.status) for r in booked] == [
        (101, "CONFIRMED"),
        (102, "PENDING"),
        (103, "CONFIRMED"),
        (104, "CONFIRMED"),
    ]
    seats = [tuple(r)[:4] for r in out.booking_seats.orderBy("id").collect()]
    assert seats == [(201, 102, "A1", Decimal("12.00")), (202, 102, "A2", Decimal("1.00"))]
    paid = {r.booking_id: r for r in out.payments.collect()}
    assert set(paid) == {102, 103}
    assert (paid[102].amount, paid[102].paid_at, paid[102].transaction_ref) == (
        Decimal("12.00"),
        datetime(2026, 2, 18, 9),
        "r",
    )
    assert (paid[103].status, paid[103].paid_at, paid[103].transaction_ref) == (
        "PENDING",
        None,
        None,
    )


def test_time_off_input(spark):
    schema = (
        "n int, teamMemberId string, email string, type string, requestType string, "
        "startDate string, endDate string, partialDay string, startTime string, endTime string, "
        "reason string"
    )
    one, two = "2026-01-02", "2026-01-03"
    rows = [
        (0, "1", None, "sick leave", None, one, two, None, "09:00", "10:00", "r"),
        (1, "1", None, "", "personal", one, one, "false", "09:00", "", "r"),
        (2, "1", None, None, None, one, one, "", None, None, "r"),
        (3, "1", None, None, None, two, one, None, None, None, "r"),
        (4, "1", None, None, None, two, " ", None, None, None, "r"),
        (5, "1", None, None, None, "then", "2026-01-01", None, None, None, "r"),
    ]
    out = normalize(values_df(spark, schema, rows), "staff_time_off_requests", ["n"]).orderBy("n")
    got = out.collect()
    assert [r.request_type for r in got[:3]] == ["SICK", "PERSONAL", "OTHER"]
    assert [r.partial_day for r in got[:3]] == [False, True, False]
    assert [r.partial_start_sec for r in got[:3]] == [None, 32400, None]
    assert [r.error for r in got] == [
        None,
        None,
        None,
        "endDate cannot be before startDate.",
        "startDate, endDate, and reason are required.",
        "Invalid startDate.",
    ]


# kind -> rows of (raw fields, error)
INPUTS = {
    "items": [({"name": " a ", "value": "b"}, None),
              ({"name": "a", "value": "\t"}, "Both 'name' and 'value' are required.")],
    "theaters": [({"name": "a", "city": "c"}, None), ({"name": "a"}, "name and city are required.")],
    "screens": [({"theaterId": "1", "name": "a", "totalSeats": "9x"}, None),
                ({"theaterId": "0", "name": "a", "totalSeats": "9"}, "theaterId is required."),
                ({"theaterId": "1", "totalSeats": "9"}, "name is required."),
                ({"theaterId": "1", "name": "a", "totalSeats": "0"},
                 "totalSeats must be greater than 0.")],
    "movies": [({"title": "a", "durationMin": "90"}, None),
               ({"title": "a", "durationMin": "-1"}, "durationMin must be greater than 0."),
               ({"title": "a", "durationMin": "9", "status": "old"}, "Invalid status."),
               ({"title": "a", "durationMin": "9", "releaseDate": "soon"}, "Invalid releaseDate."),
               ({"durationMin": "9"}, "Title is required.")],
    "showtimes": [({"movieId": "1", "screenId": "1", "startTime": "2026-01-01 10:00",
                    "endTime": "2026-01-01T11:00:00Z", "price": "0"}, None),
                  ({"movieId": "1", "screenId": "1", "startTime": "2026-01-01 10:00",
                    "price": "0"}, "startTime and endTime are required."),
                  ({"movieId": "1", "screenId": "1", "startTime": "a", "endTime": "b",
                    "price": "free"}, "price must be 0 or greater."),
                  ({"movieId": "1", "screenId": "1", "startTime": "a", "endTime": "b",
                    "price": "1"}, "Invalid time."),
                  ({"movieId": "x"}, "movieId is required.")],
    "accounts": [({"firstName": "a", "lastName": "b", "email": "A@b.c "}, None),
                 ({"firstName": "a", "lastName": "b", "email": "a@b"},
                  "Please enter a valid email address."),
                 ({"firstName": "a", "lastName": "b"}, "Please fill in all required fields."),
                 ({"firstName": "a", "lastName": "b", "email": "a@b.c", "role": "boss"},
                  "Invalid role.")],
    "payments": [({"bookingId": "1", "amount": "0"}, None),
                 ({"bookingId": "1"}, "amount must be 0 or greater."),
                 ({"bookingId": "1", "amount": "1", "method": ""}, "Invalid method."),
                 ({"bookingId": "1", "amount": "1", "status": "gone"}, "Invalid status."),
                 ({"amount": "1"}, "bookingId is required.")],
    "booking_updates": [({"status": "refunded", "totalAmount": "1"}, None),
                        ({"totalAmount": "1"}, "Invalid status."),
                        ({"status": "PENDING"}, "totalAmount must be 0 or greater.")],
    "staff_tasks": [({"title": "a", "dueTime": "10:00"}, None),
                    ({"title": "a", "dueTime": "noon"}, "Invalid dueTime."),
                    ({"title": "a", "priority": "top"}, "Invalid priority."),
                    ({}, "title is required.")],
    "staff_time_records": [({"workDate": "2026-01-01", "clockInAt": "2026-01-01 09:00",
                             "breakMinutes": "-5"}, None),
                           ({"workDate": "2026-01-01"}, "workDate and clockInAt are required."),
                           ({"workDate": "2026-01-01", "clockInAt": "9"}, "Invalid clockInAt.")],
}
FIELDS = {
    "items": "name value",
    "theaters": "name location address city",
    "screens": "theaterId name totalSeats",
    "movies": "title description durationMin rating releaseDate posterUrl status",
    "showtimes": "movieId screenId startTime endTime price language format",
    "accounts": "firstName lastName email phone role",
    "payments": "bookingId amount method status transactionRef",
    "booking_updates": "status totalAmount",
    "staff_tasks": "teamMemberId email title description priority dueDate dueTime status",
    "staff_time_records": "teamMemberId email workDate clockInAt clockOutAt breakMinutes notes "
    "status",
}


@pytest.mark.parametrize("kind", sorted(INPUTS))
def test_input_rules(spark, kind):
    names = FIELDS[kind].split()
    rows = [(i, *[raw.get(n) for n in names]) for i, (raw, _) in enumerate(INPUTS[kind])]
    schema = "n int, " + ", ".join(f"{n} string" for n in names)
    out = normalize(values_df(spark, schema, rows), kind, ["n"])
    assert column(out.orderBy("n"), "error") == [error for _, error in INPUTS[kind]]
    good, bad = split(out)
    assert good.count() + bad.count() == len(rows)
    if kind == "staff_time_records":
        assert column(good, "break_minutes") == [0]


def test_an_amount_just_below_zero_is_refused(spark):
    amounts = ["-0.004", "0.004", "-0", "-0.006", None]
    rows = [(str(i), "1", a, None, None, None) for i, a in enumerate(amounts)]
    kinds = "n string, bookingId string, amount string, method string, status string, transactionRef string"
    got = normalize(spark.createDataFrame(rows, kinds), "payments", ["n"]).collect()
    assert {int(r.n) for r in got if r.error} == {0, 3, 4}


def test_payments_with_repeated_refs(spark):
    known = values_df(spark, "id bigint, transaction_ref string", [(7, "a"), (9, None)])
    batch = values_df(
        spark,
        "seq bigint, transaction_ref string, status string",
        [(1, "b", "PAID"), (2, "a", "PAID"), (3, None, "FAILED"), (4, "", "PAID"), (5, "b", "PAID")],
    )
    added, outcome = changes.ingest_payments(known, batch, "seq", NOW)
    assert sorted((r.seq, r.id, r.existed) for r in outcome.collect()) == [
        (1, 10, False),
        (2, 7, True),
        (3, 11, False),
        (4, 12, False),
        (5, 10, True),
    ]
    assert added.count() == 3


def test_constraints_let_nulls_pass(spark):
    df = values_df(
        spark,
        "id bigint, ref string, fk bigint, lo int, hi int",
        [(1, None, None, 1, 1), (2, None, 9, 1, 2), (3, "x", 1, None, 2), (4, "x", 1, 3, 2)],
    )
    assert [tuple(r) for r in quality.duplicates(df, ["ref"]).collect()] == [("x", 2)]
    parents = values_df(spark, "id bigint", [(1,)])
    assert column(quality.orphans(df, parents, "fk"), "id") == [2]
    broken = quality.range_violations(df, ["hi > lo", "id < 4"]).orderBy("id").collect()
    assert [(r.id, r.broken) for r in broken] == [(1, "hi > lo"), (4, "hi > lo,id < 4")]
    assert column(quality.null_violations(df, ["fk", "lo"]), "missing") == ["fk", "lo"]


def test_registration_conflicts(spark):
    users = values_df(spark, "email string", [("a@b.c",), ("A@b.c",)])
    new = values_df(
        spark, "n bigint, email string", [(1, "a@b.c"), (2, "d@e.f"), (3, "d@e.f"), (4, "g@h.i")]
    )
    out = quality.reject_existing(new, users, "n").orderBy("n")
    assert [e is None for e in column(out, "error")] == [False, True, False, True]


def test_half_is_rounded_up(spark):
    df = values_df(spark, "d decimal(10,3)", [("0.005",), ("-0.005",), ("2.675",)])
    out = sorted(float(x) for x in column(df.select(fn.round2(F.col("d")).alias("r")), "r"))
    assert all(math.isclose(a, b) for a, b in zip(out, [-0.01, 0.01, 2.68], strict=True))
