"""Rules on write: references and unique keys of batches, settled addresses, committed appends."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marquee.operators import changes, quality
from marquee.operators.intake import Reference, Unique, admit
from marquee.plans.accounts import sync_users
from marquee.plans.bookings import take_bookings
from marquee.schema import TABLES
from marquee.session import new_folder
from marquee.sources import append_once, read_appended, values_df

NOW = "2026-02-18 09:00:00"


def test_first_come_first_served(spark):
    parents = values_df(spark, "id bigint", [(1,), (2,)])
    stored = values_df(spark, "name string, place bigint", [("Hall", 1)])
    batch = values_df(
        spark,
        "n int, name string, place bigint, ok boolean",
        [
            (1, "hall", 1, True),  # taken, but for letter case
            (2, "Attic", 9, True),  # unknown place; takes no key
            (3, "Attic", 2, True),
            (4, "ATTIC", 2, True),  # comes after 3
            (5, None, 2, True),  # a null never collides
            (6, None, 2, True),
            (7, "Cellar", 1, False),  # breaks its own rule first
            (8, "Cellar", 1, True),
            (9, "Roof", None, True),  # no place is no wrong place
        ],
    )
    unique = Unique(("name", "place"), stored, ci=("name",))
    got = admit(batch, "n", [Reference("place", parents, "places")], unique, {"closed": ~F.col("ok")})
    assert {r.n: r.refused for r in got.collect()} == {
        1: "unique name, place", 2: "place in places", 3: None, 4: "unique name, place",
        5: None, 6: None, 7: "closed", 8: None, 9: None,
    }
    safe = admit(batch, "n", unique=Unique(("name", "place"), stored, null_safe=("name",)))
    assert {r.n: r.refused for r in safe.where("n IN (1, 5, 6)").collect()} == {1: None, 5: None, 6: "unique name, place"}
    assert admit(batch.limit(0), "n", unique=unique).count() == 0


def test_inserts_are_one_row_per_key(spark):
    stored = values_df(spark, "user_id bigint, movie_id bigint", [(1, 1)])
    batch = values_df(spark, "seq int, user_id bigint, movie_id bigint", [(1, 1, 1), (2, 1, 2), (3, 1, 2), (4, 2, 7), (5, None, 2), (6, None, 2)])
    after = changes.insert_missing(stored, batch.drop("seq"), ["user_id", "movie_id"])
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(map(tuple, after.collect()), key=key) == [(None, 2), (None, 2), (1, 1), (1, 2), (2, 7)]
    movies = Reference("movie_id", values_df(spark, "id bigint", [(1,), (2,)]), "movies")
    after = changes.insert_missing(stored, batch, ["user_id", "movie_id"], seq="seq", references=[movies])
    assert sorted(map(tuple, after.collect()), key=key) == [(None, 2), (None, 2), (1, 1), (1, 2)]


def test_payments_of_unknown_bookings(spark):
    known = values_df(spark, "id bigint, transaction_ref string", [(7, "a")])
    bookings = values_df(spark, "id bigint", [(1,)])
    batch = values_df(
        spark,
        "seq bigint, booking_id bigint, transaction_ref string, status string",
        [(1, 9, "b", "PAID"), (2, 1, "b", "PAID"), (3, 9, "b", "PAID"), (4, 9, "a", "PAID"), (5, 9, None, "PAID"), (6, 1, "", "PAID")],
    )
    added, outcome = changes.ingest_payments(known, batch, "seq", NOW, bookings)
    rule = "booking_id in bookings"
    assert sorted((r.seq, r.id, r.existed, r.refused) for r in outcome.collect()) == [
        (1, None, False, rule), (2, 8, False, None), (3, 8, True, None), (4, 7, True, None), (5, None, False, rule), (6, 9, False, None),
    ]
    assert added.count() == 2


def test_bookings_are_taken_whole_or_not(spark):
    seat = "array<struct<seatLabel:string,price:string>>"
    kinds = f"doc_id bigint, userId string, showtimeId string, status string, totalAmount string, seats {seat}, paymentMethod string, paymentStatus string, transactionRef string"
    two = [("A1", "5"), ("A2", "5")]
    rows = [
        (1, "9", "1", None, "10", two, "card", None, "x"),
        (2, "1", "9", None, "10", two, "card", None, "x"),
        (3, "1", "1", None, "10", [("A1", "5"), (" A1 ", "5")], "card", None, "x"),
        (4, "1", "1", None, "10", two, "card", None, "x"),
        (5, "1", "1", None, "10", two, "card", None, "x"),
        (6, "1", "1", None, "10", [], None, None, "x"),
        (7, "1", "1", None, "10", two, "cash", None, "old"),
        (8, "1", "1", None, "10", two, "cash", None, None),
    ]
    stored = {
        "users": values_df(spark, "id bigint", [(1,)]),
        "showtimes": values_df(spark, "id bigint", [(1,)]),
        "payments": values_df(spark, "transaction_ref string", [("old",), (None,)]),
    }
    out, refused = take_bookings(spark.createDataFrame(rows, kinds), "doc_id", NOW, (10, 20, 30), stored)
    assert {r.doc_id: r.error for r in refused.collect()} == {
        1: "user_id in users", 2: "showtime_id in showtimes", 3: "unique booking_id, seat_label",
        5: "unique transaction_ref", 7: "unique transaction_ref",
    }
    assert sorted(r.id for r in out.bookings.collect()) == [11, 12, 13]
    assert sorted((r.id, r.booking_id, r.seat_label) for r in out.booking_seats.collect()) == [
        (21, 11, "A1"), (22, 11, "A2"), (23, 13, "A1"), (24, 13, "A2"),
    ]
    assert sorted((r.id, r.booking_id, r.transaction_ref) for r in out.payments.collect()) == [(31, 11, "x"), (32, 13, None)]


def synced(spark, accounts, moves):
    """(mail of each account, refused members) after members change their addresses."""
    users = values_df(
        spark, "id bigint, first_name string, last_name string, email string, phone string, role string, password_hash string",
        [(i, "-", "-", mail, None, "STAFF", "own") for i, mail in accounts],
    )
    old = spark.createDataFrame([(i, a) for i, a, _ in moves], "id bigint, email string")
    new = spark.createDataFrame(
        [(i, f"n{i}", "-", b, None, "ADMIN") for i, _, b in moves],
        "id bigint, first_name string, last_name string, email string, phone string, role string",
    )
    after, refused = sync_users(users, old, new, "start", NOW)
    return {r.id: (r.email, r.first_name) for r in after.collect()}, {(r.id, r.email) for r in refused.collect()}


def test_addresses_may_be_exchanged_but_never_shared(spark):
    # 1 and 2 exchange; 3 and 4 want one address; 5 wants one that is kept; 6 follows 5 and is refused with it.
    accounts = [(i, f"{c}@x.y") for i, c in enumerate("abcdefg", 1)]
    moves = [(1, "a@x.y", "b@x.y"), (2, "b@x.y", "a@x.y"), (3, "c@x.y", "z@x.y"), (4, "d@x.y", "z@x.y"),
             (5, "e@x.y", "g@x.y"), (6, "f@x.y", "e@x.y"), (8, "new@x.y", "h@x.y")]
    after, refused = synced(spark, accounts, moves)
    assert after == {
        1: ("b@x.y", "n1"), 2: ("a@x.y", "n2"), 3: ("z@x.y", "n3"), 4: ("d@x.y", "-"), 5: ("e@x.y", "-"),
        6: ("f@x.y", "-"), 7: ("g@x.y", "-"), 8: ("h@x.y", "n8"),
    }
    assert refused == {(4, "z@x.y"), (5, "g@x.y"), (6, "e@x.y")}


def test_one_change_or_none(spark):
    accounts = [(1, "a@x.y")]
    moves = [(1, "a@x.y", "b@x.y")]
    after, refused = synced(spark, accounts, moves)
    assert after == {1: ("b@x.y", "n1")} and not refused
    after, refused = synced(spark, accounts, [])
    assert after == {1: ("a@x.y", "-")} and not refused


def test_a_batch_is_added_once(spark):
    path = new_folder(spark, "rows")
    assert read_appended(spark, path, "id bigint").count() == 0
    assert append_once(spark.range(3), path, "first") and not append_once(spark.range(3), path, "first")
    assert append_once(spark.range(3, 5), path, "second")
    spark.range(50).write.parquet(f"{path}/data-without-commit")  # what a failed job leaves
    assert sorted(r.id for r in read_appended(spark, path, "id bigint").collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        append_once(spark.range(1), path, "../up")


def test_audit_counts_each_rule(spark):
    def table(name, rows):
        kinds = TABLES[name].columns
        return spark.createDataFrame([tuple(r.get(c) for c in kinds) for r in rows], TABLES[name].ddl)

    tables = {
        "theaters": table("theaters", [{"id": 1, "name": "N", "city": None}, {"id": 2, "name": "S", "city": "c"}]),
        "screens": table("screens", [
            {"id": 1, "theater_id": 1, "name": "a", "total_seats": 5}, {"id": 2, "theater_id": 1, "name": "a", "total_seats": 0},
            {"id": 3, "theater_id": 9, "name": "a", "total_seats": 5}, {"id": 4, "theater_id": 9, "name": None, "total_seats": 5},
        ]),
    }
    got = {(r.table, r.rule): r.violations for r in quality.audit(tables).collect()}
    assert {k: v for k, v in got.items() if v} == {
        ("theaters", "city is required"): 1, ("screens", "name is required"): 1, ("screens", "total_seats > 0"): 1,
        ("screens", "unique theater_id, name"): 1, ("screens", "theater_id in theaters"): 2,
    }
    assert len(got) == 3 + 4 + 1 + 1 + 1


def test_the_rest_imports_without_the_training_data_folders(tmp_path):
    """A copy without them, with and without the pipeline file, registers every other query."""
    root = Path(__file__).resolve().parent.parent
    for pipeline in (False, True):
        copy = tmp_path / str(pipeline)
        for folder, left_out in (("marquee", ("llm", "__pycache__")), ("suite", ("__pycache__",))):
            shutil.copytree(root / folder, copy / folder, ignore=shutil.ignore_patterns(*left_out))
        for name in ("__spark_entry__.py", "corpus_pipeline.py") if pipeline else ("__spark_entry__.py",):
            if (root / name).exists():
                shutil.copy(root / name, copy / name)
        script = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 110 and 'pipeline' not in q"
        done = subprocess.run([sys.executable, "-c", script], cwd=copy, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
