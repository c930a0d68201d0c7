"""Bulk changes and generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.operators import changes
from marquee.operators.intake import Reference
from marquee.operators.ranking import assign_ids as new_ids
from marquee.operators.ranking import highest_id
from marquee.plans import accounts, schedules
from marquee.plans.bookings import backfill_payments as backfill
from marquee.plans.bookings import take_bookings
from marquee.plans.listings import showtime_listing
from suite.domain import mail, some_movie
from suite.registry import query

NOW = "2001-08-01 12:00:00"


_WISHES = (
    "SELECT event_id AS seq, user_id, CASE WHEN event_id % 9 = 0 THEN event_id + 1000000000 "
    "ELSE event_id % (SELECT COUNT(*) FROM part) END AS movie_id FROM events WHERE event_type = 'click' "
    "UNION ALL SELECT event_id + 1000000000, user_id, event_id % (SELECT COUNT(*) FROM part) "
    "FROM events WHERE event_type = 'click' AND event_id % 4 = 0 "
    "UNION ALL SELECT event_id + 2000000000, user_id, event_id % (SELECT COUNT(*) FROM part) "
    "FROM events WHERE event_type = 'view' AND event_id % 3 = 0"
)


def wishes(d):
    """A batch for the watchlist: unknown movies, pairs that come again, pairs that are stored."""
    kind, event = F.col("event_type"), F.col("event_id")
    movie = some_movie(d)

    def rows(which, shift, value):
        return d.events.where(which).select((event + shift).alias("seq"), "user_id", value.alias("movie_id"))

    return (
        rows(kind == "click", 0, F.when(event % 9 == 0, event + 1000000000).otherwise(movie))
        .unionByName(rows((kind == "click") & (event % 4 == 0), 1000000000, movie))
        .unionByName(rows((kind == "view") & (event % 3 == 0), 2000000000, movie))
    )


@query(
    "insert_missing",
    "SELECT CAST(NULL AS BIGINT) AS seq, user_id, movie_id, 'row' AS outcome FROM watchlist UNION ALL "
    "SELECT CASE WHEN outcome <> 'row' THEN seq END, user_id, movie_id, outcome FROM (SELECT seq, "
    "user_id, movie_id, CASE WHEN NOT EXISTS (SELECT 1 FROM movies m WHERE m.id = w.movie_id) "
    "THEN 'movie_id in movies' WHEN EXISTS (SELECT 1 FROM watchlist l WHERE l.user_id = w.user_id "
    "AND l.movie_id = w.movie_id) OR seq <> MIN(seq) OVER (PARTITION BY user_id, movie_id) "
    "THEN 'unique user_id, movie_id' ELSE 'row' END AS outcome FROM wishes w) AS judged",
    let={"wishes": _WISHES},
)
def insert_missing(d):
    """The watchlist with what a batch adds to it, and the rows it refuses with the rule."""
    parents = d.tables("users", "movies")
    references = [Reference("user_id", parents["users"], "users"), Reference("movie_id", parents["movies"], "movies")]
    keys = ["user_id", "movie_id"]
    after = changes.insert_missing(d.watchlist, wishes(d), keys, seq="seq", references=references)
    judged = changes.check_insert(d.watchlist, wishes(d), "watchlist", "seq", parents)
    refused = judged.where(F.col("refused").isNotNull())
    no_seq = F.lit(None).cast("bigint").alias("seq")
    return after.select(no_seq, *keys, F.lit("row").alias("outcome")).unionByName(
        refused.select("seq", *keys, F.col("refused").alias("outcome"))
    )


_INCOMING = (
    "SELECT LOWER(CONCAT(REPLACE(s_name, '#', '.'), '@example.com')) AS email, "
    "s_name AS first_name, '111' AS phone, 'STAFF' AS role, 'new.jpg' AS profile_photo "
    "FROM supplier UNION ALL SELECT email, UPPER(first_name), CAST(NULL AS VARCHAR), 'ADMIN', "
    "'new.jpg' FROM users WHERE role = 'STAFF'"
)


def incoming(d):
    hired = d.supplier.select(
        mail("s_name").alias("email"),
        F.col("s_name").alias("first_name"),
        F.lit("111").alias("phone"),
        F.lit("STAFF").alias("role"),
        F.lit("new.jpg").alias("profile_photo"),
    )
    known = d.users.where(F.col("role") == "STAFF").select(
        "email",
        F.upper("first_name").alias("first_name"),
        F.lit(None).cast("string").alias("phone"),
        F.lit("ADMIN").alias("role"),
        F.lit("new.jpg").alias("profile_photo"),
    )
    return hired.unionByName(known)


@query(
    "upsert",
    "SELECT u.id, CASE WHEN i.email IS NULL THEN u.first_name ELSE i.first_name END AS first_name, "
    "u.email, CASE WHEN i.email IS NULL THEN u.phone ELSE i.phone END AS phone, u.profile_photo, "
    "CASE WHEN i.email IS NULL THEN u.role ELSE i.role END AS role, "
    f"CASE WHEN i.email IS NULL THEN u.updated_at ELSE CAST('{NOW}' AS TIMESTAMP) END AS updated_at "
    "FROM users u LEFT JOIN incoming i ON i.email = u.email UNION ALL "
    "SELECT (SELECT MAX(id) FROM users) + ROW_NUMBER() OVER (ORDER BY i.email), i.first_name, "
    f"i.email, i.phone, i.profile_photo, i.role, CAST('{NOW}' AS TIMESTAMP) FROM incoming i "
    "WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.email = i.email)",
    let={"incoming": _INCOMING},
)
def upsert(d):
    return changes.upsert(d.users, incoming(d), "email", ["first_name", "phone", "role"], NOW)


@query(
    "update_full",
    "SELECT m.id, COALESCE(c.title, m.title) AS title, COALESCE(c.duration_min, m.duration_min) "
    "AS duration_min, CASE WHEN c.id IS NULL THEN m.rating END AS rating, "
    "COALESCE(c.status, m.status) AS status FROM movies m LEFT JOIN changes c ON c.id = m.id",
    let={
        "changes": "SELECT CASE WHEN status = 'ARCHIVED' THEN id + 1000000000 ELSE id END AS id, "
        "UPPER(title) AS title, duration_min + 1 AS duration_min, CAST(NULL AS VARCHAR) AS rating, "
        "'NOW_SHOWING' AS status FROM movies WHERE status <> 'NOW_SHOWING'"
    },
)
def update_full(d):
    changed = d.movies.where(F.col("status") != "NOW_SHOWING").select(
        F.when(F.col("status") == "ARCHIVED", F.col("id") + 1000000000)
        .otherwise(F.col("id"))
        .alias("id"),
        F.upper("title").alias("title"),
        (F.col("duration_min") + 1).alias("duration_min"),
        F.lit(None).cast("string").alias("rating"),
        F.lit("NOW_SHOWING").alias("status"),
    )
    return changes.update_full(d.movies, changed, ["title", "duration_min", "rating", "status"], NOW)


@query(
    "update_sparse",
    "SELECT u.id, COALESCE(p.first_name, u.first_name) AS first_name, u.email, "
    "COALESCE(p.phone, u.phone) AS phone, CASE WHEN p.provided THEN p.photo "
    "ELSE u.profile_photo END AS profile_photo, u.role, CASE WHEN p.id IS NULL "
    f"THEN u.updated_at ELSE CAST('{NOW}' AS TIMESTAMP) END AS updated_at FROM users u "
    "LEFT JOIN patch p ON p.id = u.id",
    let={
        "patch": "SELECT c_custkey AS id, CASE WHEN c_acctbal < 2000 THEN UPPER(c_name) END "
        "AS first_name, CASE WHEN c_acctbal > 6000 THEN '999' END AS phone, c_acctbal > 4000 "
        "AS provided, CASE WHEN c_acctbal > 8000 THEN '' WHEN c_acctbal > 4000 THEN 'p.jpg' END "
        "AS photo FROM customer WHERE c_mktsegment <> 'FURNITURE'"
    },
)
def update_sparse(d):
    balance = F.col("c_acctbal")
    patch = d.customer.where(F.col("c_mktsegment") != "FURNITURE").select(
        F.col("c_custkey").alias("id"),
        F.when(balance < 2000, F.upper("c_name")).alias("first_name"),
        F.when(balance > 6000, "999").alias("phone"),
        (balance > 4000).alias("photo_given"),
        F.when(balance > 8000, "").when(balance > 4000, "p.jpg").alias("profile_photo"),
    )
    flags = {"profile_photo": "photo_given"}
    return changes.update_sparse(d.users, patch, ["first_name", "phone"], flags, NOW)


@query(
    "update_derived",
    "SELECT 'task' AS kind, id AS key, status, CASE WHEN status = 'COMPLETED' "
    f"THEN CAST('{NOW}' AS TIMESTAMP) END AS at FROM staff_tasks UNION ALL "
    "SELECT 'payment', booking_id, status, CASE WHEN status = 'PAID' "
    f"THEN CAST('{NOW}' AS TIMESTAMP) END FROM payments",
)
def update_derived(d):
    tasks = changes.with_completed_at(d.staff_tasks, NOW).select(
        F.lit("task").alias("kind"),
        F.col("id").alias("key"),
        "status",
        F.col("completed_at").alias("at"),
    )
    paid = changes.with_paid_at(d.payments, NOW).select(
        F.lit("payment").alias("kind"),
        F.col("booking_id").alias("key"),
        "status",
        F.col("paid_at").alias("at"),
    )
    return tasks.unionByName(paid)


@query(
    "delete_keys",
    "SELECT r.id, r.team_member_id, (SELECT CAST(COUNT(*) AS BIGINT) FROM staff_time_off_requests x "
    "JOIN asked a ON a.id = x.id AND a.team_member_id = x.team_member_id) AS deleted "
    "FROM staff_time_off_requests r WHERE NOT EXISTS (SELECT 1 FROM asked a WHERE a.id = r.id "
    "AND a.team_member_id = r.team_member_id)",
    let={
        "asked": "SELECT event_id AS id, CASE WHEN value < 50 THEN user_id ELSE user_id + 1 END "
        "AS team_member_id FROM events"
    },
)
def delete_keys(d):
    owner = F.when(F.col("value") < 50, F.col("user_id")).otherwise(F.col("user_id") + 1)
    asked = d.events.select(F.col("event_id").alias("id"), owner.alias("team_member_id"))
    kept, hit = changes.delete_keys(d.staff_time_off_requests, asked, ("id", "team_member_id"))
    return kept.select("id", "team_member_id").withColumn("deleted", hit.scalar())



_DOCS = (
    "SELECT doc_id, CAST(regexp_extract(user_raw, '^\\d+', 0) AS BIGINT) AS user_id, "
    "TRY_CAST(showtime_raw AS BIGINT) AS showtime_id, CAST(total_raw AS DECIMAL(10,2)) AS total, "
    "COALESCE(UPPER(TRIM(status_raw)), 'CONFIRMED') AS status, NULLIF(UPPER(TRIM(method_raw)), '') "
    "AS method, NULLIF(TRIM(ref_raw), '') AS ref, "
    "CAST(regexp_extract(user_raw, '^\\d+', 0) AS BIGINT) >= 1 "
    "AND COALESCE(TRY_CAST(showtime_raw AS BIGINT), 0) >= 1 "
    "AND CAST(total_raw AS DECIMAL(10,2)) >= 0 AND COALESCE(method_raw, '') <> 'crypto' "
    "AND NOT EXISTS (SELECT 1 FROM raw_seats s WHERE s.doc_id = b.doc_id "
    "AND (TRIM(s.label_raw) = '' OR s.price_raw = 'free')) AS valid, "
    "(SELECT COUNT(*) - COUNT(DISTINCT TRIM(s.label_raw)) FROM raw_seats s WHERE s.doc_id = b.doc_id) "
    "AS again FROM raw_bookings b"
)


@query(
    "booking_fanout",
    "SELECT 'booking' AS kind, id, user_id AS parent, status AS label, CAST(total AS DOUBLE) "
    "AS amount FROM numbered UNION ALL SELECT 'seat', 200 + ROW_NUMBER() OVER (ORDER BY n.id, "
    "s.seat_no), n.id, TRIM(s.label_raw), CAST(s.seat_no AS DOUBLE) * 10 + 0.5 FROM numbered n "
    "JOIN raw_seats s ON s.doc_id = n.doc_id UNION ALL SELECT 'payment', "
    "300 + ROW_NUMBER() OVER (ORDER BY id), id, COALESCE(method || ' ' || ref, method), "
    "CAST(total AS DOUBLE) FROM numbered WHERE method IS NOT NULL UNION ALL "
    "SELECT 'refused', doc_id, NULL, rule, NULL FROM judged WHERE rule IS NOT NULL",
    let={
        "docs": _DOCS,
        "checked": "SELECT docs.*, CASE WHEN NOT valid THEN 'input' WHEN again > 0 "
        "THEN 'unique booking_id, seat_label' WHEN user_id NOT IN (SELECT id FROM users) "
        "THEN 'user_id in users' WHEN showtime_id NOT IN (SELECT order_no FROM showtimes) "
        "THEN 'showtime_id in showtimes' END AS broken FROM docs",
        "judged": "SELECT c.*, CASE WHEN broken IS NOT NULL THEN broken WHEN method IS NOT NULL "
        "AND ref IS NOT NULL AND (ref IN (SELECT transaction_ref FROM payments "
        "WHERE transaction_ref IS NOT NULL) OR doc_id <> MIN(CASE WHEN broken IS NULL "
        "AND method IS NOT NULL THEN doc_id END) OVER (PARTITION BY ref)) "
        "THEN 'unique transaction_ref' END AS rule FROM checked c",
        "numbered": "SELECT 100 + ROW_NUMBER() OVER (ORDER BY doc_id) AS id, judged.* FROM judged "
        "WHERE rule IS NULL",
    },
)
def booking_fanout(d):
    """Documents as bookings, seats and payments, and the refused ones with the rule they break."""
    stored = {
        "users": d.users,
        "showtimes": d.showtimes.select(F.col("order_no").alias("id")).distinct(),
        "payments": d.payments,
    }
    out, refused = take_bookings(d.raw_bookings, "doc_id", NOW, (100, 200, 300), stored)

    def flat(kind, df, key, parent, label, amount):
        return df.select(
            F.lit(kind).alias("kind"),
            F.col(key).alias("id"),
            parent.cast("bigint").alias("parent"),
            label.alias("label"),
            amount.cast("double").alias("amount"),
        )

    rules = ["unique booking_id, seat_label", "user_id in users", "showtime_id in showtimes", "unique transaction_ref"]
    rule = F.when(F.col("error").isin(rules), F.col("error")).otherwise("input")
    none = F.lit(None)
    col = F.col
    paid = F.concat_ws(" ", "method", "transaction_ref")
    return (
        flat("booking", out.bookings, "id", col("user_id"), col("status"), col("total_amount"))
        .unionByName(flat("seat", out.booking_seats, "id", col("booking_id"), col("seat_label"), col("price")))
        .unionByName(flat("payment", out.payments, "id", col("booking_id"), paid, col("amount")))
        .unionByName(flat("refused", refused, "doc_id", none, rule, none))
    )


@query(
    "insert_idempotent_ref",
    "SELECT o.seq, COALESCE(o.known, f.id) AS id, o.state = 'existed' AS existed, "
    "CASE WHEN o.state = 'refused' THEN 'booking_id in bookings' END AS refused FROM decided o "
    "LEFT JOIN fresh f ON f.seq = CASE WHEN o.state = 'added' THEN o.seq "
    "WHEN o.state = 'existed' AND o.known IS NULL THEN o.first_seq END",
    let={
        "known": "SELECT MIN(booking_id) AS id, transaction_ref AS ref FROM payments "
        "WHERE transaction_ref IS NOT NULL GROUP BY transaction_ref",
        "batch": "SELECT seq, ref, ok, CASE WHEN ref IS NOT NULL THEN MIN(CASE WHEN ok THEN seq END) "
        "OVER (PARTITION BY ref) END AS first_seq FROM (SELECT o_orderkey AS seq, "
        "o_orderkey % 7 <> 0 AS ok, CASE o_orderpriority "
        "WHEN '5-LOW' THEN NULL WHEN '4-NOT SPECIFIED' THEN NULL "
        "ELSE CONCAT('REF-', CAST(o_custkey * 13 AS VARCHAR)) END AS ref FROM orders) AS o",
        "decided": "SELECT b.seq, b.first_seq, k.id AS known, CASE WHEN k.id IS NOT NULL "
        "OR COALESCE(b.first_seq < b.seq, FALSE) THEN 'existed' WHEN NOT b.ok THEN 'refused' "
        "ELSE 'added' END AS state FROM batch b LEFT JOIN known k ON k.ref = b.ref",
        "fresh": "SELECT seq, (SELECT MAX(id) FROM known) + ROW_NUMBER() OVER (ORDER BY seq) AS id "
        "FROM decided WHERE state = 'added'",
    },
)
def insert_idempotent_ref(d):
    """Payments by reference: new, known by then, or refused because their booking is not there."""
    # A ref is unique in the stored table; the test table repeats it for each line.
    stored = d.payments.where(F.col("transaction_ref").isNotNull())
    known = stored.groupBy("transaction_ref").agg(F.min("booking_id").alias("id"))
    priority, order = F.col("o_orderpriority"), F.col("o_orderkey")
    batch = d.orders.select(
        order.alias("seq"),
        F.when(order % 7 == 0, order + 1000000000).otherwise(order).alias("booking_id"),
        F.when(priority == "4-NOT SPECIFIED", "")
        .when(
            priority != "5-LOW", F.concat(F.lit("REF-"), (F.col("o_custkey") * 13).cast("string"))
        )
        .alias("transaction_ref"),
        F.lit("PAID").alias("status"),
    )
    return changes.ingest_payments(known, batch, "seq", NOW, d.bookings)[1]


@query(
    "cascade_delete",
    "SELECT 'theaters' AS kind, id AS key, CAST(NULL AS BIGINT) AS link FROM theaters "
    "WHERE city <> 'ASIA' UNION ALL "
    "SELECT 'screens', id, theater_id FROM screens WHERE theater_id NOT IN (SELECT id FROM asian) "
    "UNION ALL SELECT 'showtimes', s.order_no, s.screen_id FROM showtimes s JOIN screens sc "
    "ON sc.id = s.screen_id WHERE sc.theater_id NOT IN (SELECT id FROM asian) UNION ALL "
    "SELECT 'team_members', id, CASE WHEN theater_id NOT IN (SELECT id FROM asian) "
    "THEN theater_id END FROM team_members",
    let={"asian": "SELECT id FROM theaters WHERE city = 'ASIA'"},
)
def cascade_delete(d):
    tables = d.tables("theaters", "screens", "showtimes", "team_members")
    asian = d.theaters.where(F.col("city") == "ASIA").select("id")
    left = changes.cascade_delete(tables, "theaters", asian)

    def flat(kind, key, link):
        link = F.col(link) if link else F.lit(None)
        return left[kind].select(
            F.lit(kind).alias("kind"), F.col(key).alias("key"), link.cast("bigint").alias("link")
        )

    return (
        flat("theaters", "id", None)
        .unionByName(flat("screens", "id", "theater_id"))
        .unionByName(flat("showtimes", "order_no", "screen_id"))
        .unionByName(flat("team_members", "id", "theater_id"))
    )


@query(
    "assign_ids",
    "SELECT (SELECT MAX(id) FROM bookings) + ROW_NUMBER() OVER (ORDER BY user_id, movie_id) AS id, "
    "user_id, movie_id FROM watchlist",
)
def assign_ids(d):
    fresh = d.watchlist.select(F.lit(None).cast("bigint").alias("id"), "user_id", "movie_id")
    return new_ids(fresh, highest_id(d.bookings), ["user_id", "movie_id"])


_CHANGED = (
    "SELECT id, UPPER(first_name) AS first_name, CASE WHEN status = 'INACTIVE' "
    "THEN CONCAT('former.', old_email) ELSE old_email END AS email, '555' AS phone, "
    "CASE WHEN role = 'ADMIN' THEN 'ADMIN' ELSE 'STAFF' END AS role, old_email "
    "FROM (SELECT *, CASE WHEN id % 7 = 0 THEN CONCAT('moved.', email) ELSE email END "
    "AS old_email FROM team_members) AS members"
)


@query(
    "sync_accounts",
    "SELECT a.id, COALESCE(c.first_name, a.first_name) AS first_name, COALESCE(c.email, a.email) "
    "AS email, COALESCE(c.phone, a.phone) AS phone, COALESCE(c.role, a.role) AS role, "
    "CAST(NULL AS VARCHAR) AS password_hash FROM accounts a LEFT JOIN changed c "
    "ON c.old_email = a.email UNION ALL SELECT (SELECT MAX(id) FROM accounts) + "
    "ROW_NUMBER() OVER (ORDER BY c.email), c.first_name, c.email, c.phone, c.role, 'hash' "
    "FROM changed c WHERE c.old_email NOT IN (SELECT email FROM accounts)",
    let={
        "accounts": "SELECT * FROM users",
        "changed": _CHANGED,
    },
)
def sync_accounts(d):
    users = d.users.select(
        "id",
        "first_name",
        F.lit("").alias("last_name"),
        "email",
        "phone",
        "role",
        F.lit(None).cast("string").alias("password_hash"),
    )
    # Some members have an address that no account has.
    moved = F.when(F.col("id") % 7 == 0, F.concat(F.lit("moved."), "email"))
    members = d.team_members.withColumn("email", F.coalesce(moved, "email"))
    gone = F.col("status") == "INACTIVE"
    edited = members.select(
        "id",
        F.upper("first_name").alias("first_name"),
        "last_name",
        F.when(gone, F.concat(F.lit("former."), "email")).otherwise(F.col("email")).alias("email"),
        F.lit("555").alias("phone"),
        "role",
    )
    synced, _ = accounts.sync_users(users, members, edited, "hash", NOW)
    return synced.drop("last_name")


@query(
    "backfill_payments",
    "SELECT b.id AS booking_id, 'ONLINE_BANKING' AS method, CAST(b.total_amount AS DOUBLE) "
    "AS amount, 'PAID' AS status, b.booked_at AS paid_at, "
    "CONCAT('AUTO-PAY-', CAST(b.id AS VARCHAR)) AS transaction_ref FROM bookings b "
    "WHERE b.status = 'CONFIRMED' AND b.id NOT IN (SELECT booking_id FROM payments)",
)
def backfill_payments(d):
    rows = backfill(d.bookings, d.payments, NOW)
    return rows.withColumn("amount", F.col("amount").cast("double"))


@query(
    "generate_showtimes",
    "SELECT x.movie_id, x.screen_id, x.start_time, "
    "x.start_time + x.duration_min * INTERVAL '1' MINUTE AS end_time FROM (SELECT m.id AS movie_id, "
    "sc.id AS screen_id, t.duration_min, CAST(d.day AS TIMESTAMP) + INTERVAL '24' HOUR "
    "AS start_time FROM templates t CROSS JOIN days d JOIN movies m ON m.title = t.movie_title "
    "JOIN theaters th ON th.name = t.theater_name JOIN screens sc ON sc.theater_id = th.id "
    "AND sc.name = t.screen_name) AS x WHERE NOT EXISTS (SELECT 1 FROM showtimes st "
    "WHERE st.movie_id = x.movie_id AND st.screen_id = x.screen_id "
    "AND st.start_time = x.start_time)",
    let={
        "days": "SELECT CAST(unnest(generate_series(DATE '1998-01-01', DATE '1998-12-31', "
        "INTERVAL '1' DAY)) AS DATE) AS day",
        "templates": "SELECT m.title AS movie_title, th.name AS theater_name, "
        "sc.name AS screen_name, m.duration_min FROM (SELECT screen_id, MIN(movie_id) AS movie_id "
        "FROM showtimes GROUP BY screen_id) AS st JOIN movies m ON m.id = st.movie_id "
        "JOIN screens sc ON sc.id = st.screen_id JOIN theaters th ON th.id = sc.theater_id",
    },
)
def generate_showtimes(d):
    # Templates: one film on every screen, 17:00 local, seven hours added.
    shown = d.showtimes.groupBy("screen_id").agg(F.min("movie_id").alias("movie_id"))
    named = showtime_listing(shown, d.movies, d.screens, d.theaters).join(
        d.movies.select(F.col("id").alias("movie_id"), "duration_min"), "movie_id"
    )
    templates = named.select(
        "movie_title",
        "theater_name",
        "screen_name",
        F.lit(17 * 3600).alias("start_sec"),
        "duration_min",
    )
    return schedules.generate_showtimes(
        templates,
        "1998-01-01",
        "1998-12-31",
        d.movies,
        d.screens,
        d.theaters,
        d.showtimes,
        shift_hours=7,
    )


@query(
    "generate_shifts",
    "SELECT g.team_member_id, g.shift_date, g.start_sec, g.start_sec + 28800 AS end_sec, "
    "g.role_on_shift, CASE g.start_sec WHEN 32400 THEN 'Morning shift' ELSE 'Evening shift' END "
    "AS notes, 'SCHEDULED' AS status FROM shifts g LEFT JOIN staff_schedules s "
    "ON s.team_member_id = g.team_member_id AND s.shift_date = g.shift_date "
    "AND s.start_sec = g.start_sec WHERE s.id IS NULL",
    let={
        "days": "SELECT CAST(unnest(generate_series(DATE '1998-02-01', DATE '1998-02-28', "
        "INTERVAL '1' DAY)) AS DATE) AS day",
        "shifts": "SELECT m.id AS team_member_id, d.day AS shift_date, "
        "50400 - (m.id + isodow(d.day)) % 2 * 18000 AS start_sec, CASE m.department "
        "WHEN 'Box Office' THEN 'Box Office' WHEN 'Floor' THEN 'Floor Staff' "
        "ELSE 'Guest Support' END AS role_on_shift FROM days d, team_members m "
        "WHERE isodow(d.day) <> 7 AND m.role = 'STAFF' AND m.status = 'ACTIVE'",
    },
)
def generate_shifts(d):
    return schedules.generate_shifts(
        d.team_members, "1998-02-01", "1998-02-28", d.staff_schedules
    )


@query(
    "fallback_slots",
    "SELECT m.id AS movie_id, (SELECT MIN(id) FROM screens) AS screen_id, m.start_time, "
    "m.start_time + INTERVAL '2' HOUR AS end_time, CAST(180 AS DOUBLE) AS price, "
    "'English' AS language, '2D' AS format FROM (SELECT id, TIMESTAMP '2026-12-01 05:00:00' + CAST(ROW_NUMBER() OVER "
    "(ORDER BY id) - 1 AS INT) * INTERVAL '3' HOUR AS start_time FROM films WHERE id NOT IN "
    "(SELECT movie_id FROM showtimes)) AS m",
    let={
        "films": "SELECT id FROM movies UNION ALL SELECT id + 1000000000 FROM movies "
        "WHERE status = 'COMING_SOON'"
    },
)
def fallback_slots(d):
    # New films beside the stored ones, which are all on the programme.
    new = d.movies.where(F.col("status") == "COMING_SOON").select(F.col("id") + 1000000000)
    films = d.movies.select("id").union(new)
    slots = schedules.fallback_slots(films, d.screens, d.showtimes, "2026-12-01 05:00:00")
    return slots.withColumn("price", F.col("price").cast("double"))


@query(
    "seed_watchlist",
    "SELECT u.id AS user_id, m.id AS movie_id FROM users u, (SELECT id FROM movies "
    "WHERE status <> 'ARCHIVED' ORDER BY id LIMIT 3) AS m WHERE u.role = 'CUSTOMER' "
    "EXCEPT SELECT user_id, movie_id FROM watchlist",
)
def seed_watchlist(d):
    return schedules.seed_watchlist(d.users, d.movies, d.watchlist)


@query(
    "assign_members",
    "SELECT m.id AS team_member_id, s.priority, s.due_date, s.due_sec FROM team_members m, "
    "(VALUES ('LOW', DATE '2024-01-05', 32400), ('HIGH', DATE '2024-01-05', CAST(NULL AS INT)), "
    "('MEDIUM', CAST(NULL AS DATE), 36000), ('LOW', CAST(NULL AS DATE), CAST(NULL AS INT))) "
    "AS s(priority, due_date, due_sec) WHERE m.role = 'STAFF' AND m.status = 'ACTIVE' "
    "EXCEPT SELECT team_member_id, priority, due_date, due_sec FROM staff_tasks",
)
def assign_members(d):
    day, no_day = F.lit("2024-01-05").cast("date"), F.lit(None).cast("date")
    no_time = F.lit(None).cast("int")
    rows = [
        [F.lit("LOW"), day, F.lit(32400)],
        [F.lit("HIGH"), day, no_time],
        [F.lit("MEDIUM"), no_day, F.lit(36000)],
        [F.lit("LOW"), no_day, no_time],
    ]
    names = ["priority", "due_date", "due_sec"]
    return schedules.assign_members(
        d.team_members, rows, names, d.staff_tasks, names, null_safe=["due_date", "due_sec"]
    )
