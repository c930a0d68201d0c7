"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.operators.paging import page_to_json
from marquee.plans.bookings import backfill_payments
from marquee.plans.listings import list_items
from marquee.session import new_folder
from marquee.sources import append_once, conform, days_between, read_appended, values_df
from suite.registry import query

NOW = "2001-08-01 12:00:00"


@query(
    "table_scan",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority "
    "FROM orders",
)
def table_scan(d):
    return d.orders


@query(
    "inline_values",
    "SELECT m.id, v.rank, v.label FROM movies m JOIN (VALUES ('NOW_SHOWING', 1, 'on screen'), "
    "('COMING_SOON', 2, NULL), ('ARCHIVED', 3, 'past')) AS v(status, rank, label) "
    "ON v.status = m.status",
)
def inline_values(d):
    rows = [("NOW_SHOWING", 1, "on screen"), ("COMING_SOON", 2, None), ("ARCHIVED", 3, "past")]
    labels = values_df(d.spark, "status string, rank int, label string", rows)
    return d.movies.join(labels, "status").select("id", "rank", "label")


@query(
    "date_series",
    "SELECT days.day, CAST(COUNT(bookings.id) AS INT) AS bookings FROM days LEFT JOIN bookings "
    "ON CAST(booked_at AS DATE) = days.day GROUP BY days.day",
    let={
        "days": "SELECT CAST(unnest(generate_series(lo, hi, INTERVAL '1' DAY)) AS DATE) AS day "
        "FROM (SELECT MIN(booked_at) AS lo, MAX(booked_at) AS hi FROM bookings) AS span"
    },
)
def date_series(d):
    booked = d.bookings.select(F.col("booked_at").cast("date").alias("day"))
    span = booked.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    days = span.select(F.explode(days_between(F.col("lo"), F.col("hi"))).alias("day"))
    counts = booked.groupBy("day").agg(F.count("*").cast("int").alias("n"))
    return days.join(counts, "day", "left").select(
        "day", F.coalesce("n", F.lit(0)).alias("bookings")
    )


@query(
    "conform_schema",
    "SELECT id, first_name, last_name, email, CAST(NULL AS VARCHAR) AS phone, role, department, "
    "COALESCE(NULLIF(status, 'INACTIVE'), 'ACTIVE') AS status, theater_id, "
    f"CAST(NULL AS DATE) AS hired_at, CAST('{NOW}' AS TIMESTAMP) AS created_at, "
    f"CAST('{NOW}' AS TIMESTAMP) AS updated_at FROM team_members",
)
def conform_schema(d):
    loose = d.team_members.withColumn("status", F.nullif("status", F.lit("INACTIVE")))
    return conform(loose, "team_members", NOW)


@query(
    "page_json",
    "SELECT '{\"items\":[' || string_agg('{\"id\":' || id || ',\"name\":\"' || name || "
    "'\",\"value\":\"' || value || '\"}', ',' ORDER BY id DESC) || '],\"total\":' || "
    "(SELECT COUNT(*) FROM items) || ',\"page\":2,\"limit\":30}' AS document "
    "FROM (SELECT * FROM items ORDER BY id DESC LIMIT 30 OFFSET 30) AS page",
)
def page_json(d):
    return page_to_json(list_items(d.tables("items"), page="2", limit="30"), ["-id"], "items")


@query(
    "append_sink",
    "SELECT booking_id, method, CAST(amount AS DOUBLE) AS amount, status FROM payments UNION ALL "
    "SELECT id, 'ONLINE_BANKING', CAST(total_amount AS DOUBLE), 'PAID' FROM bookings b "
    "WHERE status = 'CONFIRMED' AND NOT EXISTS "
    "(SELECT 1 FROM payments p WHERE p.booking_id = b.id)",
)
def append_sink(d):
    """Backfilled payments are added by a job that runs twice; the second run adds nothing."""
    columns = ("booking_id", "method", F.col("amount").cast("double").alias("amount"), "status")
    path = new_folder(d.spark, "payments-added")
    added = backfill_payments(d.bookings, d.payments, NOW).select(*columns)
    for _ in range(2):
        append_once(added, path, "backfill-2001-08-01")
    return d.payments.select(*columns).unionByName(read_appended(d.spark, path, added.schema))
