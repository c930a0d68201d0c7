"""Input batches of further kinds: every normalized field and the first error, row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.operators import changes
from marquee.operators.payloads import normalize
from suite.registry import query

#: Raw input as people type it, made from orders; the text of an expression is the same in both dialects.
RAW = {
    "payments": {
        "bookingId": "CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '-4' WHEN 2 THEN 'x1' "
        "ELSE CONCAT(' ', o_custkey + 1, 'b') END",
        "amount": "CASE o_orderkey % 13 WHEN 0 THEN 'free' WHEN 1 THEN '-0.01' WHEN 2 THEN '12.345 THB' "
        "ELSE CONCAT(o_custkey, '.5') END",
        "method": "CASE o_orderpriority WHEN '1-URGENT' THEN ' card ' WHEN '2-HIGH' THEN 'crypto' "
        "WHEN '3-MEDIUM' THEN NULL WHEN '5-LOW' THEN 'Online_Banking' ELSE 'cash' END",
        "status": "CASE o_orderkey % 7 WHEN 0 THEN 'lost' WHEN 1 THEN NULL WHEN 2 THEN 'failed' ELSE ' pending' END",
        "transactionRef": "CASE o_orderkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE CONCAT(' r', o_orderkey) END",
    },
    "showtimes": {
        "movieId": "CASE o_orderkey % 10 WHEN 0 THEN '0' WHEN 1 THEN 'm' ELSE CONCAT(o_custkey + 1, '') END",
        "screenId": "CASE o_orderkey % 14 WHEN 0 THEN NULL ELSE CONCAT('+', o_custkey % 50 + 1) END",
        "startTime": "CASE o_orderkey % 12 WHEN 0 THEN '' WHEN 1 THEN 'noon' "
        "ELSE CONCAT('2024-05-', 10 + o_orderkey % 20, 'T1', o_orderkey % 9, ':30:00Z') END",
        "endTime": "CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN CONCAT('2024-05-', 10 + o_orderkey % 20, "
        "' 09:00:00') ELSE CONCAT('2024-05-', 10 + o_orderkey % 20, 'T23:30:00+02:00') END",
        "price": "CASE o_orderkey % 8 WHEN 0 THEN '-1' WHEN 1 THEN '' ELSE '.5 THB' END",
        "language": "CASE o_orderkey % 4 WHEN 0 THEN ' ' ELSE ' English ' END",
        "format": "CASE o_orderkey % 5 WHEN 0 THEN NULL ELSE '2D' END",
    },
    "staff_time_records": {
        "teamMemberId": "CASE o_orderkey % 4 WHEN 0 THEN NULL ELSE CONCAT(o_custkey + 1, '') END",
        "email": "CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE ' A@Example.com' END",
        "workDate": "CASE o_orderkey % 15 WHEN 0 THEN '2024-13-01' WHEN 1 THEN ' ' WHEN 2 THEN '2023-02-29' "
        "ELSE ' 2024-02-29 ' END",
        "clockInAt": "CASE o_orderkey % 16 WHEN 0 THEN NULL WHEN 1 THEN '25:00' ELSE '2024-02-29 08:00:00' END",
        "clockOutAt": "CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'later' ELSE '2024-02-29T17:00:00+07:00' END",
        "breakMinutes": "CASE o_orderkey % 5 WHEN 0 THEN '-15' WHEN 1 THEN 'none' WHEN 2 THEN NULL ELSE '45min' END",
        "notes": "CASE o_orderkey % 2 WHEN 0 THEN '' ELSE ' note ' END",
        "status": "CASE o_orderkey % 7 WHEN 0 THEN 'napping' WHEN 1 THEN NULL ELSE ' completed' END",
    },
    "staff_time_off_requests": {
        "teamMemberId": "CONCAT(o_custkey, '')",
        "email": "CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE 'B@Example.com ' END",
        "type": "CASE o_orderkey % 5 WHEN 0 THEN 'sick leave' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE ' vacation ' END",
        "requestType": "CASE o_orderkey % 3 WHEN 0 THEN 'personal' WHEN 1 THEN NULL ELSE 'sabbatical' END",
        "startDate": "CASE o_orderkey % 11 WHEN 0 THEN '' WHEN 1 THEN '2024-02-30' ELSE '2024-03-10' END",
        "endDate": "CASE o_orderkey % 13 WHEN 0 THEN NULL WHEN 1 THEN '2024-03-01' WHEN 2 THEN 'soon' ELSE '2024-03-12' END",
        "partialDay": "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'false' END",
        "startTime": "CASE o_orderkey % 6 WHEN 0 THEN '9:15' WHEN 1 THEN '25:00' ELSE NULL END",
        "endTime": "CASE o_orderkey % 7 WHEN 0 THEN '17:00:30' WHEN 1 THEN '17:60' ELSE '' END",
        "reason": "CASE o_orderkey % 17 WHEN 0 THEN ' ' ELSE 'rest' END",
    },
    "screens": {
        "theaterId": "CASE o_orderkey % 5 WHEN 0 THEN '0' WHEN 1 THEN NULL ELSE CONCAT(o_custkey + 1, '') END",
        "name": "CASE o_orderkey % 7 WHEN 0 THEN ' ' ELSE CONCAT(' Hall ', o_orderkey) END",
        "totalSeats": "CASE o_orderkey % 6 WHEN 0 THEN '0' WHEN 1 THEN '99999999999' ELSE '120 seats' END",
    },
    "movies": {
        "title": "CASE o_orderkey % 9 WHEN 0 THEN NULL ELSE CONCAT(' Film ', o_orderkey) END",
        "description": "CASE o_orderkey % 2 WHEN 0 THEN '' ELSE ' long ' END",
        "durationMin": "CASE o_orderkey % 8 WHEN 0 THEN '-90' WHEN 1 THEN 'long' ELSE '90.7' END",
        "rating": "CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE 'PG ' END",
        "releaseDate": "CASE o_orderkey % 10 WHEN 0 THEN '2024-04-31' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE '2024-04-30' END",
        "posterUrl": "CASE o_orderkey % 4 WHEN 0 THEN ' ' ELSE 'p.png' END",
        "status": "CASE o_orderkey % 7 WHEN 0 THEN 'old' WHEN 1 THEN NULL ELSE ' archived' END",
    },
}


def _whole(c: str, kind: str = "BIGINT") -> str:
    return f"TRY_CAST(regexp_extract({c}, '^\\s*([+-]?\\d+)', 1) AS {kind})"


def _amount(c: str) -> str:
    return f"TRY_CAST(regexp_extract({c}, '^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+))', 1) AS DECIMAL(10,2))"


def _opt(c: str) -> str:
    return f"NULLIF(TRIM({c}), '')"


def _day(c: str) -> str:
    return f"TRY_CAST(TRIM({c}) AS DATE)"


def _zoned(c: str) -> str:
    """Clock text whose offset is taken off."""
    east = "".join(f"WHEN {c} LIKE '%+0{h}:00' THEN TRY_CAST(left({c}, 19) AS TIMESTAMP) - INTERVAL '{h}' HOUR " for h in (2, 7))
    return f"CASE {east}WHEN {c} LIKE '____-__-__%' THEN TRY_CAST(replace({c}, 'Z', '') AS TIMESTAMP) END"


def _clock(c: str) -> str:
    hms = f"CASE WHEN {c} = '' THEN NULL WHEN LENGTH({c}) < 6 THEN lpad({c}, 5, '0') || ':00' ELSE {c} END"
    return f"CAST(date_diff('second', TIME '00:00:00', TRY_CAST({hms} AS TIME)) AS INT)"


#: Kind -> (field -> statement over the raw columns, cases of the first error over the fields).
ASKED = {
    "payments": (
        {
            "booking_id": _whole("bookingId"), "amount": _amount("amount"), "method": "COALESCE(UPPER(TRIM(method)), 'WALLET')",
            "status": "COALESCE(UPPER(TRIM(status)), 'PAID')", "transaction_ref": _opt("transactionRef"),
        },
        "WHEN booking_id IS NULL OR booking_id < 1 THEN 'bookingId is required.' "
        "WHEN amount IS NULL OR amount < 0 THEN 'amount must be 0 or greater.' "
        "WHEN method NOT IN ('CARD', 'CASH', 'WALLET', 'ONLINE_BANKING') THEN 'Invalid method.' "
        "WHEN status NOT IN ('PENDING', 'PAID', 'FAILED', 'REFUNDED') THEN 'Invalid status.'",
    ),
    "showtimes": (
        {
            "movie_id": _whole("movieId"), "screen_id": _whole("screenId"), "start_time": _zoned("startTime"),
            "end_time": _zoned("endTime"), "price": _amount("price"), "language": _opt("language"), "format": _opt("format"),
            "absent": "COALESCE(startTime, '') = '' OR COALESCE(endTime, '') = ''",
        },
        "WHEN movie_id IS NULL OR movie_id < 1 THEN 'movieId is required.' "
        "WHEN screen_id IS NULL OR screen_id < 1 THEN 'screenId is required.' "
        "WHEN absent THEN 'startTime and endTime are required.' "
        "WHEN price IS NULL OR price < 0 THEN 'price must be 0 or greater.' "
        "WHEN start_time IS NULL OR end_time IS NULL THEN 'Invalid time.' "
        "WHEN end_time <= start_time THEN 'endTime must be after startTime.'",
    ),
    "staff_time_records": (
        {
            "team_member_id": _whole("teamMemberId"), "email": "COALESCE(LOWER(TRIM(email)), '')", "work_date": _day("workDate"),
            "clock_in_at": _zoned("clockInAt"), "clock_out_at": _zoned("clockOutAt"),
            "break_minutes": f"GREATEST(0, COALESCE({_whole('breakMinutes', 'INT')}, 0))", "notes": _opt("notes"),
            "status": "COALESCE(UPPER(TRIM(status)), 'CLOCKED_IN')",
            "absent": "COALESCE(TRIM(workDate), '') = '' OR COALESCE(TRIM(clockInAt), '') = ''", "leaves": _opt("clockOutAt"),
        },
        "WHEN absent THEN 'workDate and clockInAt are required.' "
        "WHEN status NOT IN ('CLOCKED_IN', 'COMPLETED', 'MISSED', 'ABSENT') THEN 'Invalid status.' "
        "WHEN work_date IS NULL THEN 'Invalid workDate.' WHEN clock_in_at IS NULL THEN 'Invalid clockInAt.' "
        "WHEN clock_out_at IS NULL AND leaves IS NOT NULL THEN 'Invalid clockOutAt.'",
    ),
    "staff_time_off_requests": (
        {
            "team_member_id": _whole("teamMemberId"), "email": "COALESCE(LOWER(TRIM(email)), '')",
            "request_type": "CASE UPPER(TRIM(COALESCE(NULLIF(type, ''), requestType, ''))) WHEN 'VACATION' THEN 'VACATION' "
            "WHEN 'PERSONAL' THEN 'PERSONAL' WHEN 'SICK LEAVE' THEN 'SICK' ELSE 'OTHER' END",
            "start_date": _day("startDate"), "end_date": _day("endDate"), "partial_day": "COALESCE(partialDay <> '', FALSE)",
            "partial_start_sec": f"CASE WHEN partialDay <> '' THEN {_clock('startTime')} END",
            "partial_end_sec": f"CASE WHEN partialDay <> '' THEN {_clock('endTime')} END",
            "reason": "COALESCE(TRIM(reason), '')", "status": "'PENDING'",
            "absent": "TRIM(reason) = '' OR COALESCE(startDate, '') = '' OR COALESCE(endDate, '') = ''",
            "begins": _opt("startTime"), "ends": _opt("endTime"),
        },
        "WHEN absent THEN 'startDate, endDate, and reason are required.' "
        "WHEN end_date < start_date THEN 'endDate cannot be before startDate.' "
        "WHEN start_date IS NULL THEN 'Invalid startDate.' WHEN end_date IS NULL THEN 'Invalid endDate.' "
        "WHEN partial_day AND partial_start_sec IS NULL AND begins IS NOT NULL THEN 'Invalid startTime.' "
        "WHEN partial_day AND partial_end_sec IS NULL AND ends IS NOT NULL THEN 'Invalid endTime.'",
    ),
    "screens": (
        {"theater_id": _whole("theaterId"), "name": "COALESCE(TRIM(name), '')", "total_seats": _whole("totalSeats", "INT")},
        "WHEN theater_id IS NULL OR theater_id < 1 THEN 'theaterId is required.' WHEN name = '' THEN 'name is required.' "
        "WHEN total_seats IS NULL OR total_seats < 1 THEN 'totalSeats must be greater than 0.'",
    ),
    "movies": (
        {
            "title": "COALESCE(TRIM(title), '')", "description": _opt("description"), "duration_min": _whole("durationMin", "INT"),
            "rating": _opt("rating"), "release_date": _day("releaseDate"), "poster_url": _opt("posterUrl"),
            "status": "COALESCE(UPPER(TRIM(status)), 'COMING_SOON')", "given": _opt("releaseDate"),
        },
        "WHEN title = '' THEN 'Title is required.' "
        "WHEN duration_min IS NULL OR duration_min < 1 THEN 'durationMin must be greater than 0.' "
        "WHEN status NOT IN ('NOW_SHOWING', 'COMING_SOON', 'ARCHIVED') THEN 'Invalid status.' "
        "WHEN release_date IS NULL AND given IS NOT NULL THEN 'Invalid releaseDate.'",
    ),
}
_SERVES_RULES = {"absent", "leaves", "begins", "ends", "given"}
_MONEY = {"amount", "price"}


def _register(kind: str) -> None:
    fields, errors = ASKED[kind]
    typed = ", ".join(f"{e} AS {c}" for c, e in RAW[kind].items())
    read = ", ".join(f"{e} AS {c}" for c, e in fields.items())
    shown = [c for c in fields if c not in _SERVES_RULES]
    listed = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c in _MONEY else c for c in shown)

    @query(
        f"input_{kind}",
        f"SELECT doc_id, {listed}, CASE {errors} END AS error FROM fields",
        let={
            "typed": f"SELECT o_orderkey AS doc_id, {typed} FROM orders",
            "fields": f"SELECT doc_id, {read} FROM typed",
        },
    )
    def build(d):
        raw = d.orders.select(F.col("o_orderkey").alias("doc_id"), *[F.expr(e).alias(c) for c, e in RAW[kind].items()])
        judged = normalize(raw, kind, ["doc_id"])
        return judged.withColumns({c: F.col(c).cast("double") for c in _MONEY if c in judged.columns})


for _kind in ASKED:
    _register(_kind)


@query(
    "input_bookings",
    "SELECT doc_id, CASE WHEN COALESCE(TRY_CAST(regexp_extract(user_raw, '^\\d+', 0) AS BIGINT), 0) < 1 "
    "THEN 'userId is required.' WHEN COALESCE(TRY_CAST(showtime_raw AS BIGINT), 0) < 1 "
    "THEN 'showtimeId is required.' WHEN CAST(total_raw AS DECIMAL(10,2)) < 0 "
    "THEN 'totalAmount must be 0 or greater.' WHEN method_raw = 'crypto' THEN 'Invalid paymentMethod.' "
    "WHEN EXISTS (SELECT 1 FROM raw_seats s WHERE s.doc_id = b.doc_id AND (TRIM(s.label_raw) = '' "
    "OR s.price_raw = 'free')) THEN 'Each seat must include seatLabel and non-negative price.' END AS error "
    "FROM raw_bookings b",
)
def input_bookings(d):
    return normalize(d.raw_bookings, "bookings", ["doc_id"]).select("doc_id", "error")


_ROOTS = {
    "movies": (("id % 3 = 0", "id"), {"showtimes": ("movie_id", "order_no"), "watchlist": ("movie_id", "user_id")}),
    "users": (("id % 7 = 0", "id"), {"bookings": ("user_id", "id"), "watchlist": ("user_id", "movie_id")}),
    "bookings": (("status = 'CANCELLED'", "id"), {"booking_seats": ("booking_id", "booking_id"), "payments": ("booking_id", "booking_id")}),
    "team_members": (
        ("status = 'INACTIVE'", "id"),
        {t: ("team_member_id", "id") for t in ("staff_schedules", "staff_time_off_requests", "staff_tasks", "staff_time_records")},
    ),
}


def _cascade_sql() -> str:
    parts = []
    for root, ((doomed, key), children) in _ROOTS.items():
        gone = f"SELECT id FROM {root} WHERE {doomed}"
        parts.append(f"SELECT '{root}' AS root, '{root}' AS kind, {key} AS key FROM {root} WHERE NOT ({doomed})")
        for child, (fk, shown) in children.items():
            parts.append(f"SELECT '{root}', '{child}', {shown} FROM {child} c WHERE c.{fk} NOT IN ({gone})")
    # The bookings that go with their users take their seats and payments along.
    for child in ("booking_seats", "payments"):
        gone = "SELECT b.id FROM bookings b JOIN users u ON u.id = b.user_id WHERE u.id % 7 = 0"
        parts.append(f"SELECT 'users', '{child}', c.booking_id FROM {child} c WHERE c.booking_id NOT IN ({gone})")
    return " UNION ALL ".join(parts)


@query("cascade_roots", _cascade_sql())
def cascade_roots(d):
    """What is left after a deletion from each of four tables, through all levels below it."""
    out = None
    for root, ((doomed, key), children) in _ROOTS.items():
        shown = {root: key, **{child: c for child, (_, c) in children.items()}}
        if root == "users":
            shown |= {"booking_seats": "booking_id", "payments": "booking_id"}
        tables = d.tables(*shown)
        left = changes.cascade_delete(tables, root, tables[root].where(doomed).select("id"))
        for kind, column in shown.items():
            rows = left[kind].select(F.lit(root).alias("root"), F.lit(kind).alias("kind"), F.col(column).alias("key"))
            out = rows if out is None else out.unionByName(rows)
    return out
