"""Input checks and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.operators import quality
from marquee.operators.payloads import bad_seats, clean_seats, normalize
from marquee.schema import TABLES, TASK_STATUS
from suite.domain import mail
from suite.registry import query

SPACE = "' ' || chr(9) || chr(160) || chr(8195)"

_CLEAN = (
    f"SELECT doc_id, COALESCE(TRIM(first_raw, {SPACE}), '') AS first_name, "
    f"TRIM(last_raw, {SPACE}) AS last_name, LOWER(TRIM(email_raw, {SPACE})) AS email, "
    "NULLIF(TRIM(phone_raw), '') AS phone, UPPER(TRIM(role_raw)) AS role, "
    "CAST(NULL AS VARCHAR) AS department, COALESCE(UPPER(status_raw), 'ACTIVE') AS status, "
    "TRY_CAST(regexp_extract(theater_raw, '^\\s*([+-]?\\d+)', 1) AS BIGINT) AS theater_id, "
    "TRY_CAST(TRIM(hired_raw) AS DATE) AS hired_at, TRIM(hired_raw) AS hired_text FROM raw_members"
)


@query(
    "normalize_input",
    "SELECT doc_id, first_name, last_name, email, phone, role, department, status, theater_id, "
    "hired_at FROM clean",
    let={"clean": _CLEAN},
)
def normalize_input(d):
    return normalize(d.raw_members, "team_members", ["doc_id"]).drop("error")


@query(
    "validate_first_error",
    "SELECT doc_id, CASE WHEN first_name = '' OR last_name = '' OR email = '' OR role = '' "
    "THEN 'firstName, lastName, email, and role are required.' "
    "WHEN NOT regexp_matches(email, '\\S+@\\S+\\.\\S+') THEN 'Invalid email.' "
    "WHEN role NOT IN ('ADMIN', 'MANAGER', 'STAFF') THEN 'Invalid role.' "
    "WHEN status NOT IN ('ACTIVE', 'INACTIVE', 'ON_LEAVE') THEN 'Invalid status.' "
    "WHEN hired_at IS NULL AND hired_text <> '' THEN 'Invalid hiredAt.' END AS error FROM clean",
    let={"clean": _CLEAN},
)
def validate_first_error(d):
    return normalize(d.raw_members, "team_members", ["doc_id"]).select("doc_id", "error")


@query(
    "validate_children",
    "SELECT b.doc_id, EXISTS (SELECT 1 FROM raw_seats s WHERE s.doc_id = b.doc_id "
    "AND (TRIM(s.label_raw) = '' OR s.price_raw = 'free')) AS rejected FROM raw_bookings b",
)
def validate_children(d):
    return d.raw_bookings.select("doc_id", bad_seats(clean_seats(F.col("seats"))).alias("rejected"))


@query(
    "check_enums",
    "SELECT event_id, UPPER(event_type) AS status FROM events WHERE UPPER(event_type) NOT IN "
    "('VIEW', 'CLICK', 'PURCHASE') UNION ALL SELECT id, status FROM staff_tasks "
    "WHERE status NOT IN ('PENDING', 'IN_PROGRESS', 'COMPLETED')",
)
def check_enums(d):
    typed = d.events.select("event_id", F.upper("event_type").alias("status"))
    strange = quality.enum_violations(typed, "status", ["VIEW", "CLICK", "PURCHASE"])
    open_list = [s for s in TASK_STATUS if s != "CANCELLED"]
    tasks = quality.enum_violations(d.staff_tasks, "status", open_list)
    return strange.union(tasks.select("id", "status"))


@query(
    "check_ranges",
    "SELECT id, CONCAT_WS(',', CASE WHEN NOT (break_minutes < 45) THEN 'break_minutes < 45' END, "
    "CASE WHEN NOT (clock_out_at > clock_in_at) THEN 'clock_out_at > clock_in_at' END) AS broken "
    "FROM staff_time_records WHERE NOT (break_minutes < 45) OR NOT (clock_out_at > clock_in_at)",
)
def check_ranges(d):
    rules = ["break_minutes < 45", "clock_out_at > clock_in_at"]
    return quality.range_violations(d.staff_time_records, rules).select("id", "broken")


@query(
    "check_unique",
    "SELECT transaction_ref, COUNT(*) AS occurrences FROM payments "
    "WHERE transaction_ref IS NOT NULL GROUP BY transaction_ref HAVING COUNT(*) > 1",
)
def check_unique(d):
    return quality.duplicates(d.payments, ["transaction_ref"])


@query(
    "check_foreign_keys",
    "SELECT m.id, m.theater_id FROM (SELECT id, CASE WHEN id % 9 = 0 THEN theater_id + 1000000000 "
    "ELSE theater_id END AS theater_id FROM team_members) AS m WHERE m.theater_id IS NOT NULL "
    "AND NOT EXISTS (SELECT 1 FROM theaters t WHERE t.id = m.theater_id)",
)
def check_foreign_keys(d):
    theater = F.col("theater_id")
    asked = F.when(F.col("id") % 9 == 0, theater + 1000000000).otherwise(theater)
    members = d.team_members.select("id", asked.alias("theater_id"))
    return quality.orphans(members, d.theaters, "theater_id")


@query(
    "check_not_null",
    "SELECT id, CONCAT_WS(',', CASE WHEN due_date IS NULL THEN 'due_date' END, "
    "CASE WHEN due_sec IS NULL THEN 'due_sec' END) AS missing FROM staff_tasks "
    "WHERE due_date IS NULL OR due_sec IS NULL",
)
def check_not_null(d):
    rows = quality.null_violations(d.staff_tasks, ["due_date", "due_sec", "team_member_id"])
    return rows.select("id", "missing")


@query(
    "reject_existing",
    "SELECT n.seq, n.email, CASE WHEN n.seq <> MIN(n.seq) OVER (PARTITION BY n.email) OR EXISTS "
    "(SELECT 1 FROM users u WHERE u.email = n.email) "
    "THEN 'An account with this email already exists.' END AS error FROM (SELECT o_orderkey AS seq, "
    "CASE WHEN o_orderkey % 3 = 0 THEN 'new.' ELSE '' END || "
    "LOWER(REPLACE(c_name, '#', '.')) || '@example.com' AS email FROM orders JOIN customer "
    "ON c_custkey = o_custkey) AS n",
)
def reject_existing(d):
    new = d.orders.join(d.customer, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("o_orderkey").alias("seq"),
        F.concat(
            F.when(F.col("o_orderkey") % 3 == 0, "new.").otherwise(""), mail("c_name")
        ).alias("email"),
    )
    return quality.reject_existing(new, d.users, "seq")


#: The columns that the test tables have of each declared table.
AUDITED = {
    "items": "id name value",
    "users": "id first_name email phone profile_photo role updated_at",
    "movies": "id title duration_min rating status",
    "theaters": "id name city",
    "screens": "id theater_id name total_seats",
    "showtimes": "movie_id screen_id start_time end_time price",
    "bookings": "id user_id status total_amount booked_at",
    "booking_seats": "booking_id seat_label price",
    "payments": "booking_id method amount status paid_at transaction_ref created_at",
    "watchlist": "user_id movie_id",
    "team_members": "id first_name last_name email role department status theater_id",
    "staff_schedules": "id team_member_id shift_date start_sec end_sec status",
    "staff_time_off_requests": "id team_member_id start_date end_date status created_at",
    "staff_tasks": "id team_member_id priority due_date due_sec status",
    "staff_time_records": "id team_member_id work_date clock_in_at clock_out_at break_minutes status",
}
# Faults that the test tables do not have of themselves: column, condition and value in SQL and Spark.
FAULTY = {
    "showtimes": ("screen_id", "line_no = 4", "screen_id + 1000000000"),
    "staff_tasks": ("priority", "id % 10 = 0", "'URGENT'"),
    "team_members": ("theater_id", "id % 9 = 0", "theater_id + 1000000000"),
    "booking_seats": ("price", "seat_label LIKE '3-%'", "-price"),
    "users": ("email", "id % 50 = 0", "'same@example.com'"),
}


def _audit_sql() -> str:
    """Each rule as a statement of its own over the tables, as a reader of the schema would ask it."""

    def table(name):
        if name not in FAULTY:
            return name
        column, when, value = FAULTY[name]
        return f"(SELECT * REPLACE (CASE WHEN {when} THEN {value} ELSE {column} END AS {column}) FROM {name})"

    asked = []
    for name, listed in AUDITED.items():
        spec, columns, rows = TABLES[name], listed.split(), table(name)
        broken = {f"{c} is required": f"{c} IS NULL" for c in spec.required if c in columns}
        for c, allowed in spec.enums.items():
            values = ", ".join(f"'{v}'" for v in allowed)
            broken |= {f"{c} in list": f"{c} NOT IN ({values})"} if c in columns else {}
        for check in spec.checks:
            if all(w not in spec.columns or w in columns for w in check.split()):
                broken[check] = f"NOT ({check})"
        asked += [(name, rule, f"SELECT COUNT(*) FROM {rows} t WHERE {where}") for rule, where in broken.items()]
        for keys in spec.unique:
            if all(k in columns for k in keys):
                key = ", ".join(keys)
                whole = " AND ".join(f"{k} IS NOT NULL" for k in keys)
                groups = f"SELECT 1 FROM {rows} t WHERE {whole} GROUP BY {key} HAVING COUNT(*) > 1"
                asked.append((name, f"unique {key}", f"SELECT COUNT(*) FROM ({groups}) AS g"))
        for fk, (parent, _) in spec.references.items():
            if fk in columns and "id" in AUDITED[parent].split():
                missing = f"t.{fk} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {table(parent)} p WHERE p.id = t.{fk})"
                asked.append((name, f"{fk} in {parent}", f"SELECT COUNT(*) FROM {rows} t WHERE {missing}"))
    parts = [f"SELECT '{n}' AS \"table\", '{rule}' AS rule, ({sql}) AS violations" for n, rule, sql in asked]
    return " UNION ALL ".join(parts)


@query("audit", _audit_sql())
def audit(d):
    """All declared rules over all fifteen tables."""
    tables = d.tables(*AUDITED)
    for name, (column, when, value) in FAULTY.items():
        faulty = F.when(F.expr(when), F.expr(value)).otherwise(F.col(column))
        tables[name] = tables[name].withColumn(column, faulty)
    return quality.audit(tables)
