"""Scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee import functions as fn
from marquee.operators.metrics import effective_at
from suite.registry import query

SPACE = "' ' || chr(9) || chr(160) || chr(8195)"


@query(
    "str_lower_upper",
    "SELECT c_custkey AS id, LOWER(c_name) AS low, UPPER(c_name) AS up FROM customer",
)
def str_lower_upper(d):
    return d.customer.select(
        F.col("c_custkey").alias("id"), F.lower("c_name").alias("low"), F.upper("c_name").alias("up")
    )


@query(
    "str_trim",
    f"SELECT doc_id, TRIM(first_raw, {SPACE}) AS first_name, TRIM(last_raw, {SPACE}) AS last_name, "
    f"TRIM(email_raw, {SPACE}) AS email FROM raw_members",
)
def str_trim(d):
    return d.raw_members.select(
        "doc_id",
        fn.strip(F.col("firstName")).alias("first_name"),
        fn.strip(F.col("lastName")).alias("last_name"),
        fn.strip(F.col("email")).alias("email"),
    )


@query(
    "str_concat",
    "SELECT id, first_name || ' ' || department AS strict, "
    "CONCAT(first_name, department, CAST(theater_id AS VARCHAR)) AS loose FROM team_members",
)
def str_concat(d):
    return d.team_members.select(
        "id",
        fn.full_name(F.col("first_name"), F.col("department")).alias("strict"),
        fn.join_skipping_nulls(
            F.col("first_name"), F.col("department"), F.col("theater_id")
        ).alias("loose"),
    )


@query(
    "str_like",
    "SELECT doc_id, LOWER(text) LIKE '%the%' AS has_the, text ILIKE '%E_T%' AS wild FROM documents",
)
def str_like(d):
    return d.documents.select(
        "doc_id",
        fn.contains_like(F.col("text"), "THE").alias("has_the"),
        F.col("text").ilike("%E_T%").alias("wild"),
    )


@query(
    "str_email_regex",
    "SELECT doc_id, regexp_matches(text, '\\S+@\\S+\\.\\S+') AS has_email FROM documents",
)
def str_email_regex(d):
    return d.documents.select("doc_id", fn.email_like(F.col("text")).alias("has_email"))


@query(
    "str_empty_to_null",
    "SELECT doc_id, NULLIF(phone_raw, '') AS phone, NULLIF(hired_raw, '') AS hired FROM raw_members",
)
def str_empty_to_null(d):
    return d.raw_members.select(
        "doc_id",
        fn.empty_to_null(F.col("phone")).alias("phone"),
        fn.empty_to_null(F.col("hiredAt")).alias("hired"),
    )


@query(
    "map_request_type",
    "SELECT event_id, CASE event_type WHEN 'view' THEN 'SICK' WHEN 'click' THEN 'VACATION' "
    "WHEN 'purchase' THEN 'PERSONAL' ELSE 'OTHER' END AS request_type FROM events",
)
def map_request_type(d):
    asked = (
        F.when(F.col("event_type") == "view", "\tsick leave ")
        .when(F.col("event_type") == "click", "Vacation")
        .when(F.col("event_type") == "purchase", " personal")
        .when(F.col("event_type") == "error", "sick-leave")
    )
    return d.events.select("event_id", fn.request_type(asked).alias("request_type"))


@query(
    "map_role",
    "SELECT id, CASE WHEN role = 'ADMIN' THEN 'ADMIN' ELSE 'STAFF' END AS account_role "
    "FROM team_members",
)
def map_role(d):
    return d.team_members.select("id", fn.user_role(F.col("role")).alias("account_role"))


@query(
    "num_parse_prefix",
    "SELECT doc_id, TRY_CAST(regexp_extract(theater_raw, '^\\s*([+-]?\\d+)', 1) AS BIGINT) "
    "AS theater_id, TRY_CAST(regexp_extract(hired_raw, '^\\s*([+-]?\\d+)', 1) AS BIGINT) AS year, "
    "TRY_CAST(regexp_extract(amount, '^\\s*([+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?)', 1) "
    "AS DOUBLE) AS amount FROM texts",
    let={
        "texts": "SELECT doc_id, theater_raw, hired_raw, CASE WHEN doc_id % 3 = 0 THEN "
        "CONCAT(' ', CAST(doc_id AS VARCHAR), '.25THB') WHEN doc_id % 3 = 1 THEN '-.5e1x' "
        "ELSE 'THB 3' END AS amount FROM raw_members"
    },
)
def num_parse_prefix(d):
    doc = F.col("doc_id")
    amount = (
        F.when(doc % 3 == 0, F.concat(F.lit(" "), doc.cast("string"), F.lit(".25THB")))
        .when(doc % 3 == 1, F.lit("-.5e1x"))
        .otherwise(F.lit("THB 3"))
    )
    return d.raw_members.select(
        "doc_id",
        fn.parse_int(F.col("theaterId")).alias("theater_id"),
        fn.parse_int(F.col("hiredAt")).alias("year"),
        fn.parse_float(amount).alias("amount"),
    )


@query(
    "num_clamp",
    "SELECT event_id, LEAST(value, 200.0) AS capped, GREATEST(value - 100, 0.0) AS floored "
    "FROM events",
)
def num_clamp(d):
    value = F.col("value")
    return d.events.select(
        "event_id",
        fn.at_most(value, 200.0).alias("capped"),
        fn.at_least(value - 100, 0.0).alias("floored"),
    )


@query(
    "num_round",
    "SELECT order_no, line_no, CAST(ROUND(price * CAST(0.5 AS DECIMAL(2,1)), 2) AS DOUBLE) "
    "AS rounded FROM showtimes",
)
def num_round(d):
    half = F.col("price") * F.lit("0.5").cast("decimal(2,1)")
    return d.showtimes.select("order_no", "line_no", fn.round2(half).cast("double").alias("rounded"))


@query("num_modulo", "SELECT id, id % 2 AS parity FROM team_members")
def num_modulo(d):
    return d.team_members.select("id", F.pmod("id", F.lit(2).cast("bigint")).alias("parity"))


@query(
    "num_casts",
    "SELECT id, CAST(user_id AS INT) AS small, CAST(total_amount AS DOUBLE) AS amount, "
    "CAST(id AS VARCHAR) AS text FROM bookings",
)
def num_casts(d):
    return d.bookings.select(
        "id",
        F.col("user_id").cast("int").alias("small"),
        F.col("total_amount").cast("double").alias("amount"),
        F.col("id").cast("string").alias("text"),
    )


@query("num_falsy_zero", "SELECT request_id, NULLIF(id, 0) AS id FROM requests")
def num_falsy_zero(d):
    return d.requests.select("request_id", fn.falsy_zero(F.col("id")).alias("id"))


@query(
    "dt_trunc",
    "SELECT id, DATE_TRUNC('day', clock_in_at) AS day, CAST(DATE_TRUNC('week', clock_in_at) "
    "AS TIMESTAMP) AS week, CAST(DATE_TRUNC('month', clock_in_at) AS TIMESTAMP) AS month "
    "FROM staff_time_records",
)
def dt_trunc(d):
    at = F.col("clock_in_at")
    return d.staff_time_records.select(
        "id", *[fn.truncated(unit, at).alias(unit) for unit in ("day", "week", "month")]
    )


@query(
    "dt_isodow",
    "SELECT id, CAST(EXTRACT(ISODOW FROM shift_date) AS INT) AS weekday FROM staff_schedules",
)
def dt_isodow(d):
    return d.staff_schedules.select("id", fn.iso_weekday(F.col("shift_date")).alias("weekday"))


@query(
    "dt_epoch_diff",
    "SELECT id, date_diff('microsecond', clock_in_at, clock_out_at) AS micros "
    "FROM staff_time_records",
)
def dt_epoch_diff(d):
    micros = fn.elapsed_micros(F.col("clock_in_at"), F.col("clock_out_at"))
    return d.staff_time_records.select("id", micros.alias("micros"))


@query(
    "dt_add_interval",
    "SELECT id, clock_in_at + CAST(id % 5 AS INT) * INTERVAL '3' HOUR AS later "
    "FROM staff_time_records",
)
def dt_add_interval(d):
    later = fn.add_seconds(F.col("clock_in_at"), F.col("id") % 5 * 3 * 3600)
    return d.staff_time_records.select("id", later.alias("later"))


@query(
    "dt_date_plus_time",
    "SELECT id, CAST(shift_date AS TIMESTAMP) + start_sec * INTERVAL '1' SECOND AS starts_at "
    "FROM staff_schedules",
)
def dt_date_plus_time(d):
    at = fn.at_time(F.col("shift_date"), F.col("start_sec"))
    return d.staff_schedules.select("id", at.alias("starts_at"))


@query(
    "dt_minutes_interval",
    "SELECT id, TIMESTAMP '2026-02-01 10:00:00' + duration_min * INTERVAL '1' MINUTE AS ends_at "
    "FROM movies",
)
def dt_minutes_interval(d):
    ends = fn.literal_stamp("2026-02-01 10:00:00") + fn.minutes(F.col("duration_min"))
    return d.movies.select("id", ends.alias("ends_at"))


@query(
    "dt_now",
    "SELECT id, CAST(DATE '2001-08-01' - shift_date AS INT) AS days_ago FROM staff_schedules",
)
def dt_now(d):
    days = F.date_diff(fn.literal_date("2001-08-01"), F.col("shift_date"))
    return d.staff_schedules.select("id", days.alias("days_ago"))


@query(
    "dt_zone_literal",
    "SELECT id, clock_in_at - INTERVAL '7' HOUR AS utc FROM staff_time_records",
)
def dt_zone_literal(d):
    return d.staff_time_records.select("id", fn.to_utc(F.col("clock_in_at"), "+07:00").alias("utc"))


@query(
    "dt_parse_text",
    "SELECT id, TRY_CAST(day_text AS DATE) AS day, TRY_CAST(stamp_text AS TIMESTAMP) AS stamp, "
    "CASE WHEN id % 3 = 0 THEN NULL ELSE CAST(id % 24 * 3600 + 1800 AS INT) END AS clock FROM texts",
    let={
        "texts": "SELECT id, CASE WHEN id % 4 = 0 THEN '2024-02-30' WHEN id % 4 = 1 THEN 'soon' "
        "ELSE CAST(work_date AS VARCHAR) END AS day_text, CASE WHEN id % 5 = 0 THEN 'noon' "
        "ELSE CAST(work_date AS VARCHAR) || ' 09:30:00' END AS stamp_text FROM staff_time_records"
    },
)
def dt_parse_text(d):
    key, day = F.col("id"), F.col("work_date").cast("string")
    return d.staff_time_records.select(
        "id",
        fn.parse_date(
            F.when(key % 4 == 0, "2024-02-30").when(key % 4 == 1, "soon").otherwise(day)
        ).alias("day"),
        fn.parse_stamp(
            F.when(key % 5 == 0, "noon").otherwise(F.concat(day, F.lit(" 09:30:00")))
        ).alias("stamp"),
        fn.parse_clock(
            F.when(key % 3 == 0, "24:00").otherwise(
                F.concat(F.lpad((key % 24).cast("string"), 2, "0"), F.lit(":30"))
            )
        ).alias("clock"),
    )


@query(
    "cond_case",
    "SELECT id, CASE WHEN duration_min < 10 THEN 'short' WHEN duration_min < 30 THEN 'medium' "
    "WHEN duration_min IS NULL THEN 'unknown' ELSE 'long' END AS length FROM movies",
)
def cond_case(d):
    length = F.col("duration_min")
    return d.movies.select(
        "id",
        F.when(length < 10, "short")
        .when(length < 30, "medium")
        .when(length.isNull(), "unknown")
        .otherwise("long")
        .alias("length"),
    )


@query(
    "cond_coalesce",
    "SELECT booking_id, method, CAST(amount AS DOUBLE) AS amount, "
    "COALESCE(paid_at, created_at) AS effective_at FROM payments",
)
def cond_coalesce(d):
    return d.payments.select(
        "booking_id",
        "method",
        F.col("amount").cast("double").alias("amount"),
        effective_at().alias("effective_at"),
    )
