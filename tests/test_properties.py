"""Properties that hold whatever the data."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marquee.functions import elapsed_micros
from marquee.operators import changes, quality
from marquee.operators.payloads import normalize, split
from marquee.operators.ranking import number_rows
from marquee.plans import schedules
from marquee.plans.bookings import backfill_payments
from marquee.session import durable, new_folder
from marquee.sources import append
from suite.domain import Domain
from suite.k_changes import incoming

NOW, LATER = "2026-01-01 00:00:00", "2026-01-02 00:00:00"


@pytest.fixture(scope="module")
def d(spark):
    return Domain(spark, "/root/testdata/sf0.001")


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_insert_missing_twice_is_once(d):
    new = d.events.select("user_id", (F.col("event_id") % 200).alias("movie_id")).distinct()
    once = changes.insert_missing(d.watchlist, new, ["user_id", "movie_id"])
    same(changes.insert_missing(once, new, ["user_id", "movie_id"]), once)


def test_upsert_twice_is_once_but_for_the_time(d):
    columns = ["first_name", "phone", "role"]
    once = durable(changes.upsert(d.users, incoming(d), "email", columns, NOW))
    twice = changes.upsert(once, incoming(d), "email", columns, LATER)
    same(twice.drop("updated_at"), once.drop("updated_at"))
    assert quality.duplicates(once, ["id"]).count() == 0


def test_backfill_twice_is_once(d):
    columns = ["booking_id", "status", "amount"]
    paid = d.payments.select(*columns)
    added = backfill_payments(d.bookings, paid, NOW).select(*columns)
    assert added.count() > 0
    assert backfill_payments(d.bookings, paid.unionByName(added), NOW).count() == 0


def test_shifts_twice_is_once(d):
    span = ("1998-02-01", "1998-02-28")
    columns = ["team_member_id", "shift_date", "start_sec"]
    once = schedules.generate_shifts(d.team_members, *span, d.staff_schedules).select(*columns)
    current = d.staff_schedules.select(*columns).unionByName(once)
    assert schedules.generate_shifts(d.team_members, *span, current).count() == 0


def test_valid_and_rejected_make_the_input(d):
    for kind, raw in (("team_members", d.raw_members), ("bookings", d.raw_bookings)):
        good, bad = split(normalize(raw, kind, ["doc_id"]))
        seen = good.select("doc_id").unionByName(bad.select("doc_id"))
        same(seen, raw.select("doc_id"))
        assert good.count() and bad.count()


def test_cascade_leaves_no_orphans(spark, d):
    tables = d.tables("theaters", "screens", "showtimes", "team_members")
    gone = d.theaters.where(F.col("city") == "ASIA").select("id")
    left = changes.cascade_delete(tables, "theaters", gone)
    for child, parent, fk in (
        ("screens", "theaters", "theater_id"),
        ("showtimes", "screens", "screen_id"),
        ("team_members", "theaters", "theater_id"),
    ):
        assert quality.orphans(left[child], left[parent], fk).count() == 0
    assert left["team_members"].count() == d.team_members.count()
    assert left["showtimes"].count() < d.showtimes.count()


def test_cascade_reaches_all_levels(spark):
    def table(schema, rows):
        return spark.createDataFrame(rows, schema)

    tables = {
        "movies": table("id bigint", [(1,), (2,)]),
        "showtimes": table("id bigint, movie_id bigint", [(10, 1), (20, 2)]),
        "bookings": table(
            "id bigint, showtime_id bigint, user_id bigint", [(100, 10, 1), (200, 20, 1)]
        ),
        "booking_seats": table("id bigint, booking_id bigint", [(1, 100), (2, 200), (3, 100)]),
        "payments": table("id bigint, booking_id bigint", [(1, 100), (2, 200)]),
        "watchlist": table("id bigint, movie_id bigint, user_id bigint", [(1, 1, 1), (2, 2, 1)]),
    }
    left = changes.cascade_delete(tables, "movies", table("id bigint", [(1,), (7,)]))
    assert {n: [r.id for r in t.collect()] for n, t in left.items()} == {
        "movies": [2],
        "showtimes": [20],
        "bookings": [200],
        "booking_seats": [2],
        "payments": [2],
        "watchlist": [2],
    }


def test_last_change_of_a_key_counts(spark):
    batch = spark.createDataFrame(
        [(1, "a", 1), (1, None, 3), (1, "b", 2), (2, "c", 1)], "id bigint, v string, seq int"
    )
    last = changes.one_per_key(batch, "id", "seq", ["v"])
    assert sorted(map(tuple, last.collect())) == [(1, None), (2, "c")]


def test_unknown_ids_of_an_update_are_reported(d):
    batch = d.movies.select((F.col("id") + 5).alias("id"), "title")
    assert changes.not_found(d.movies, batch).count() == 5


def test_row_numbers_are_the_global_order(d):
    numbered = number_rows(d.staff_time_records, ["-work_date", "id"], "n").orderBy("n")
    order = [F.col("work_date").desc(), F.col("id")]
    expected = [r.id for r in d.staff_time_records.orderBy(*order).collect()]
    rows = numbered.select("n", "id").collect()
    assert [r.n for r in rows] == list(range(1, len(expected) + 1))
    assert [r.id for r in rows] == expected


def test_sorted_queries_come_out_sorted(spark):
    from __spark_entry__ import queries

    rows = queries()["sort_single"](spark, "/root/testdata/sf0.001").collect()
    keys = [(r.created_at, r.id) for r in rows]
    assert keys == sorted(keys, reverse=True)


def test_append_adds_and_keeps(spark):
    path = new_folder(spark, "rows")
    append(spark.range(3), path)
    append(spark.range(3, 5), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3, 4]


def test_elapsed_is_exact(spark):
    row = spark.sql(
        "SELECT TIMESTAMP_NTZ'2026-01-01 00:00:00.000001' AS a, TIMESTAMP_NTZ'2027-01-01' AS b"
    ).select(elapsed_micros(F.col("a"), F.col("b")).alias("m"))
    assert row.first().m == 365 * 86_400_000_000 - 1
