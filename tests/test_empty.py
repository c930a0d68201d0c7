"""Empty tables and batches."""

from __future__ import annotations

from marquee.operators import changes, metrics, paging
from marquee.operators.joins import missing_in, nest_children
from marquee.operators.ranking import assign_ids, highest_id, number_rows
from marquee.schema import TABLES
from marquee.session import durable


def empty(spark, table):
    return spark.createDataFrame([], TABLES[table].ddl)


def test_row_numbers_and_ids(spark):
    none = empty(spark, "movies")
    assert number_rows(none, ["id"]).count() == 0
    assert assign_ids(none, highest_id(none), ["title"]).count() == 0
    some = assign_ids(spark.range(3).toDF("n"), highest_id(none), ["n"])
    assert sorted(r.id for r in some.collect()) == [1, 2, 3]


def test_kept_rows_keep_their_columns(spark):
    none = durable(empty(spark, "payments"))
    assert none.columns == list(TABLES["payments"].columns)
    assert none.count() == 0


def test_summaries(spark):
    t = {n: empty(spark, n) for n in TABLES}
    summary = metrics.work_summary(
        t["team_members"],
        t["staff_time_records"],
        t["staff_schedules"],
        t["staff_tasks"],
        t["staff_time_off_requests"],
        "2026-01-01",
    )
    assert summary.count() == 0
    rows = metrics.revenue_all_ranges(t["payments"], "2026-01-01 00:00:00").collect()
    assert [tuple(r)[1:] for r in rows] == [(0, 0.0)] * 4


def test_changes(spark):
    none = empty(spark, "users")
    assert changes.update_full(none, none, ["phone"], "2026-01-01 00:00:00").count() == 0
    assert changes.upsert(none, none.drop("id"), "email", ["phone"], "2026-01-01").count() == 0
    kept, hit = changes.delete_keys(none, none)
    assert kept.count() == 0 and hit.first().deleted == 0
    assert missing_in(none, none, ["email"], ci=["email"]).count() == 0


def test_pages_and_children(spark):
    movies, seats = empty(spark, "movies"), empty(spark, "booking_seats")
    page = paging.page_of(movies, ["id"], 3, 10)
    assert page.rows.count() == 0 and page.total.first().total == 0
    document = paging.page_to_json(page, ["id"], "movies").first().document
    assert document == '{"movies":[],"total":0,"page":3,"limit":10}'
    nested = nest_children(spark.range(2), seats, "booking_id", ["id"], ["seat_label"], "seats")
    assert [r.seats for r in nested.collect()] == [[], []]
