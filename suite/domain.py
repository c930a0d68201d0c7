"""The test tables reshaped to the domain, for Spark and, as SQL text, for the check.

Nullable and faulty columns are derived from the raw columns, because the raw tables hold
no nulls and no bad text.  No relation drops rows of its table unless a column value says so.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import literal_stamp
from marquee.sources import read_table

RAW = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}

STARTED = "2000-01-01 00:00:00"
MONEY = "decimal(10,2)"


def pick(c, cases: dict, otherwise=None):
    """CASE c WHEN ... THEN ... ELSE ..."""
    out = None
    for value, result in cases.items():
        result = result if hasattr(result, "alias") else F.lit(result)
        out = F.when(c == value, result) if out is None else out.when(c == value, result)
    return out if otherwise is None else out.otherwise(otherwise)


def mail(name):
    return F.lower(F.concat(F.replace(name, F.lit("#"), F.lit(".")), F.lit("@example.com")))


def text(value):
    return value.cast("string")


RELATIONS: dict[str, tuple[Callable[["Domain"], DataFrame], str]] = {}


def relation(sql: str):
    def register(build):
        RELATIONS[build.__name__] = (build, sql)
        return build

    return register


class Domain:
    """Raw and reshaped tables of one data folder, as attributes."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def __getattr__(self, name: str) -> DataFrame:
        if name in RAW:
            return read_table(self.spark, self.directory, name, RAW[name])
        if name in RELATIONS:
            return RELATIONS[name][0](self)
        raise AttributeError(name)

    def tables(self, *names: str) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in names}


def with_relations(sql: str, let: dict[str, str] | None = None) -> str:
    """Prefix the relations a statement names, and further named ones, as CTEs."""
    let = let or {}
    needed: list[str] = []

    def visit(statement: str) -> None:
        for name in re.findall(r"[a-z_]+", statement):
            if name in RELATIONS and name not in needed:
                visit(RELATIONS[name][1])
                if name not in needed:
                    needed.append(name)

    visit(" ".join([*let.values(), sql]))
    ctes = [f"{n} AS ({RELATIONS[n][1]})" for n in needed]
    ctes += [f"{n} AS ({body})" for n, body in let.items()]
    return f"WITH {', '.join(ctes)} {sql}" if ctes else sql


@relation(
    "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, r_name AS city "
    "FROM nation JOIN region ON n_regionkey = r_regionkey"
)
def theaters(d):
    return d.nation.join(d.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("bigint").alias("id"),
        F.col("n_name").alias("name"),
        F.col("r_name").alias("city"),
    )


@relation(
    "SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS theater_id, s_name AS name, "
    "CAST(s_suppkey % 200 + 50 AS INT) AS total_seats FROM supplier"
)
def screens(d):
    return d.supplier.select(
        F.col("s_suppkey").alias("id"),
        F.col("s_nationkey").cast("bigint").alias("theater_id"),
        F.col("s_name").alias("name"),
        (F.col("s_suppkey") % 200 + 50).cast("int").alias("total_seats"),
    )


@relation(
    "SELECT p_partkey AS id, p_name || ' #' || CAST(p_partkey AS VARCHAR) AS title, "
    "p_size AS duration_min, p_brand AS rating, CASE WHEN p_type IN ('ECONOMY', 'STANDARD') "
    "THEN 'NOW_SHOWING' WHEN p_type IN ('PROMO', 'SMALL') THEN 'COMING_SOON' "
    "ELSE 'ARCHIVED' END AS status FROM part"
)
def movies(d):
    kind = F.col("p_type")
    return d.part.select(
        F.col("p_partkey").alias("id"),
        F.concat("p_name", F.lit(" #"), text(F.col("p_partkey"))).alias("title"),
        F.col("p_size").alias("duration_min"),
        F.col("p_brand").alias("rating"),
        F.when(kind.isin("ECONOMY", "STANDARD"), "NOW_SHOWING")
        .when(kind.isin("PROMO", "SMALL"), "COMING_SOON")
        .otherwise("ARCHIVED")
        .alias("status"),
    )


@relation(
    "SELECT l_orderkey AS order_no, l_linenumber AS line_no, l_partkey AS movie_id, "
    "l_suppkey AS screen_id, l_shipdate AS start_time, "
    "l_shipdate + INTERVAL '2' HOUR AS end_time, "
    "CAST(l_extendedprice AS DECIMAL(10,2)) AS price FROM lineitem"
)
def showtimes(d):
    return d.lineitem.select(
        F.col("l_orderkey").alias("order_no"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("movie_id"),
        F.col("l_suppkey").alias("screen_id"),
        F.col("l_shipdate").alias("start_time"),
        (F.col("l_shipdate") + F.expr("INTERVAL '2' HOUR")).alias("end_time"),
        F.col("l_extendedprice").cast(MONEY).alias("price"),
    )


@relation(
    "SELECT c_custkey AS id, c_name AS first_name, "
    "LOWER(CONCAT(REPLACE(c_name, '#', '.'), '@example.com')) AS email, "
    "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CONCAT('000-', CAST(c_custkey AS VARCHAR)) END "
    "AS phone, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'photo.jpg' END AS profile_photo, "
    "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'ADMIN' WHEN c_mktsegment = 'BUILDING' "
    f"THEN 'STAFF' ELSE 'CUSTOMER' END AS role, CAST('{STARTED}' AS TIMESTAMP) AS updated_at "
    "FROM customer"
)
def users(d):
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    return d.customer.select(
        key.alias("id"),
        F.col("c_name").alias("first_name"),
        mail("c_name").alias("email"),
        F.when(key % 4 != 0, F.concat(F.lit("000-"), text(key))).alias("phone"),
        F.when(key % 6 != 0, F.lit("photo.jpg")).alias("profile_photo"),
        pick(segment, {"MACHINERY": "ADMIN", "BUILDING": "STAFF"}, "CUSTOMER").alias("role"),
        literal_stamp(STARTED).alias("updated_at"),
    )


@relation(
    "SELECT o_orderkey AS id, o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'CONFIRMED' "
    "WHEN 'O' THEN 'PENDING' ELSE 'CANCELLED' END AS status, "
    "CAST(o_totalprice AS DECIMAL(10,2)) AS total_amount, o_orderdate AS booked_at FROM orders"
)
def bookings(d):
    status = pick(F.col("o_orderstatus"), {"F": "CONFIRMED", "O": "PENDING"}, "CANCELLED")
    return d.orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        status.alias("status"),
        F.col("o_totalprice").cast(MONEY).alias("total_amount"),
        F.col("o_orderdate").alias("booked_at"),
    )


@relation(
    "SELECT l_orderkey AS booking_id, CONCAT(CAST(l_linenumber AS VARCHAR), '-', "
    "CAST(l_partkey AS VARCHAR)) AS seat_label, CAST(l_extendedprice AS DECIMAL(10,2)) AS price "
    "FROM lineitem"
)
def booking_seats(d):
    label = F.concat(text(F.col("l_linenumber")), F.lit("-"), text(F.col("l_partkey")))
    return d.lineitem.select(
        F.col("l_orderkey").alias("booking_id"),
        label.alias("seat_label"),
        F.col("l_extendedprice").cast(MONEY).alias("price"),
    )


@relation(
    "SELECT l_orderkey AS booking_id, CASE l_linenumber % 4 WHEN 0 THEN 'CARD' WHEN 1 THEN 'CASH' "
    "WHEN 2 THEN 'WALLET' ELSE 'ONLINE_BANKING' END AS method, "
    "CAST(l_extendedprice AS DECIMAL(10,2)) AS amount, CASE l_returnflag WHEN 'A' THEN 'PAID' "
    "WHEN 'N' THEN 'PENDING' ELSE 'REFUNDED' END AS status, "
    "CASE WHEN l_returnflag = 'A' AND l_linenumber < 5 THEN l_shipdate END AS paid_at, "
    "CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CONCAT('REF-', CAST(l_orderkey AS VARCHAR)) END "
    "AS transaction_ref, l_shipdate AS created_at FROM lineitem"
)
def payments(d):
    line, flag, ship = F.col("l_linenumber"), F.col("l_returnflag"), F.col("l_shipdate")
    method = pick(line % 4, {0: "CARD", 1: "CASH", 2: "WALLET"}, "ONLINE_BANKING")
    return d.lineitem.select(
        F.col("l_orderkey").alias("booking_id"),
        method.alias("method"),
        F.col("l_extendedprice").cast(MONEY).alias("amount"),
        pick(flag, {"A": "PAID", "N": "PENDING"}, "REFUNDED").alias("status"),
        F.when((flag == "A") & (line < 5), ship).alias("paid_at"),
        F.when(
            F.col("l_partkey") % 3 != 0, F.concat(F.lit("REF-"), text(F.col("l_orderkey")))
        ).alias("transaction_ref"),
        ship.alias("created_at"),
    )


@relation(
    "SELECT DISTINCT user_id, event_id % (SELECT COUNT(*) FROM part) AS movie_id FROM events "
    "WHERE event_type = 'view'"
)
def watchlist(d):
    viewed = d.events.where(F.col("event_type") == "view")
    return viewed.select("user_id", some_movie(d).alias("movie_id")).distinct()


def some_movie(d):
    """A movie for each event; movie ids count from 0."""
    return F.col("event_id") % d.part.agg(F.count("*")).scalar()


@relation(
    "SELECT c_custkey AS id, c_name AS first_name, c_mktsegment AS last_name, "
    "LOWER(CONCAT(REPLACE(c_name, '#', '.'), '@example.com')) AS email, "
    "CASE c_custkey % 3 WHEN 0 THEN 'ADMIN' WHEN 1 THEN 'MANAGER' ELSE 'STAFF' END AS role, "
    "CASE c_custkey % 4 WHEN 0 THEN 'Box Office' WHEN 1 THEN 'Floor' WHEN 2 THEN 'Operations' "
    "ELSE NULL END AS department, CASE WHEN c_acctbal < 0 THEN 'INACTIVE' ELSE 'ACTIVE' END "
    "AS status, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END "
    "AS theater_id FROM customer"
)
def team_members(d):
    key = F.col("c_custkey")
    return d.customer.select(
        key.alias("id"),
        F.col("c_name").alias("first_name"),
        F.col("c_mktsegment").alias("last_name"),
        mail("c_name").alias("email"),
        pick(key % 3, {0: "ADMIN", 1: "MANAGER"}, "STAFF").alias("role"),
        pick(key % 4, {0: "Box Office", 1: "Floor", 2: "Operations"}).alias("department"),
        F.when(F.col("c_acctbal") < 0, "INACTIVE").otherwise("ACTIVE").alias("status"),
        F.when(key % 5 != 0, F.col("c_nationkey").cast("bigint")).alias("theater_id"),
    )


@relation(
    "SELECT event_id AS id, user_id AS team_member_id, CAST(ts AS DATE) AS work_date, "
    "ts AS clock_in_at, CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts + CAST(FLOOR(value) AS INT) "
    "* INTERVAL '1' MINUTE END AS clock_out_at, CAST(event_id % 60 AS INT) AS break_minutes, "
    "CASE event_type WHEN 'view' THEN 'CLOCKED_IN' WHEN 'error' THEN 'MISSED' "
    "WHEN 'signup' THEN 'ABSENT' ELSE 'COMPLETED' END AS status FROM events"
)
def staff_time_records(d):
    key, ts = F.col("event_id"), F.col("ts")
    worked = F.make_dt_interval(mins=F.floor("value").cast("int"))
    status = {"view": "CLOCKED_IN", "error": "MISSED", "signup": "ABSENT"}
    return d.events.select(
        key.alias("id"),
        F.col("user_id").alias("team_member_id"),
        ts.cast("date").alias("work_date"),
        ts.alias("clock_in_at"),
        F.when(key % 7 != 0, ts + worked).alias("clock_out_at"),
        (key % 60).cast("int").alias("break_minutes"),
        pick(F.col("event_type"), status, "COMPLETED").alias("status"),
    )


@relation(
    "SELECT o_orderkey AS id, o_custkey AS team_member_id, CAST(o_orderdate AS DATE) AS shift_date, "
    "CASE WHEN o_orderkey % 2 = 0 THEN 32400 ELSE 50400 END AS start_sec, "
    "CASE WHEN o_orderkey % 2 = 0 THEN 61200 ELSE 79200 END AS end_sec, "
    "CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'SCHEDULED' ELSE 'CANCELLED' END "
    "AS status FROM orders"
)
def staff_schedules(d):
    even = F.col("o_orderkey") % 2 == 0
    status = pick(F.col("o_orderstatus"), {"F": "COMPLETED", "O": "SCHEDULED"}, "CANCELLED")
    return d.orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("team_member_id"),
        F.col("o_orderdate").cast("date").alias("shift_date"),
        F.when(even, 32400).otherwise(50400).alias("start_sec"),
        F.when(even, 61200).otherwise(79200).alias("end_sec"),
        status.alias("status"),
    )


@relation(
    "SELECT event_id AS id, user_id AS team_member_id, CASE event_id % 3 WHEN 0 THEN 'LOW' "
    "WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS priority, CASE WHEN event_id % 5 = 0 THEN NULL "
    "ELSE CAST(ts AS DATE) END AS due_date, CASE WHEN event_id % 4 = 0 THEN NULL "
    "ELSE CAST(event_id % 24 * 3600 AS INT) END AS due_sec, CASE event_type WHEN 'view' "
    "THEN 'PENDING' WHEN 'click' THEN 'IN_PROGRESS' WHEN 'purchase' THEN 'COMPLETED' "
    "ELSE 'CANCELLED' END AS status FROM events"
)
def staff_tasks(d):
    key = F.col("event_id")
    status = {"view": "PENDING", "click": "IN_PROGRESS", "purchase": "COMPLETED"}
    return d.events.select(
        key.alias("id"),
        F.col("user_id").alias("team_member_id"),
        pick(key % 3, {0: "LOW", 1: "MEDIUM"}, "HIGH").alias("priority"),
        F.when(key % 5 != 0, F.col("ts").cast("date")).alias("due_date"),
        F.when(key % 4 != 0, (key % 24 * 3600).cast("int")).alias("due_sec"),
        pick(F.col("event_type"), status, "CANCELLED").alias("status"),
    )


@relation(
    "SELECT event_id AS id, user_id AS team_member_id, CAST(ts AS DATE) AS start_date, "
    "CAST(ts + CAST(event_id % 4 AS INT) * INTERVAL '1' DAY AS DATE) AS end_date, "
    "CASE event_id % 3 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'APPROVED' ELSE 'REJECTED' END AS status, "
    "ts AS created_at FROM events WHERE event_type = 'signup'"
)
def staff_time_off_requests(d):
    key, ts = F.col("event_id"), F.col("ts")
    return d.events.where(F.col("event_type") == "signup").select(
        key.alias("id"),
        F.col("user_id").alias("team_member_id"),
        ts.cast("date").alias("start_date"),
        F.date_add(ts.cast("date"), (key % 4).cast("int")).alias("end_date"),
        pick(key % 3, {0: "PENDING", 1: "APPROVED"}, "REJECTED").alias("status"),
        ts.alias("created_at"),
    )


@relation("SELECT doc_id AS id, source AS name, lang AS value FROM documents")
def items(d):
    return d.documents.select(
        F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("lang").alias("value")
    )


@relation(
    "SELECT event_id AS request_id, CASE event_type WHEN 'view' THEN NULL "
    "WHEN 'error' THEN user_id + 1000000000 WHEN 'signup' THEN 0 "
    "WHEN 'purchase' THEN -1 - user_id ELSE user_id END AS id, "
    "CASE WHEN value < 5 THEN NULL WHEN value < 10 THEN ' ' WHEN value < 15 THEN "
    "'nobody@example.com' ELSE CONCAT('  CUSTOMER.', LPAD(CAST(user_id AS VARCHAR), 9, '0'), "
    "'@Example.com', chr(9)) END AS email FROM events"
)
def requests(d):
    """Requests naming a person by id, email or both."""
    user, value = F.col("user_id"), F.col("value")
    address = F.concat(
        F.lit("  CUSTOMER."), F.lpad(text(user), 9, "0"), F.lit("@Example.com\t")
    )
    return d.events.select(
        F.col("event_id").alias("request_id"),
        pick(
            F.col("event_type"),
            {
                "view": F.lit(None).cast("bigint"),
                "error": user + 1000000000,
                "signup": F.lit(0).cast("bigint"),
                "purchase": -1 - user,
            },
            user,
        ).alias("id"),
        F.when(value < 5, F.lit(None))
        .when(value < 10, " ")
        .when(value < 15, "nobody@example.com")
        .otherwise(address)
        .alias("email"),
    )


@relation(
    "SELECT c_custkey AS doc_id, CASE c_custkey % 11 WHEN 0 THEN '' WHEN 1 THEN NULL "
    "ELSE CONCAT(chr(9), c_name, ' ') END AS first_raw, CONCAT(c_mktsegment, chr(160)) AS last_raw, "
    "CASE c_custkey % 13 WHEN 0 THEN 'not-an-email' WHEN 1 THEN ' ' "
    "ELSE CONCAT(chr(8195), UPPER(REPLACE(c_name, '#', '.')), '@Example.COM') END AS email_raw, "
    "CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE ' 000-1 ' END AS phone_raw, "
    "CASE c_custkey % 7 WHEN 0 THEN 'owner' WHEN 1 THEN ' manager ' ELSE 'Staff' END AS role_raw, "
    "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'gone' ELSE 'active' END AS status_raw, "
    "CASE c_custkey % 3 WHEN 0 THEN CONCAT(CAST(c_nationkey AS VARCHAR), 'abc') WHEN 1 THEN 'x' "
    "ELSE CONCAT(' -', CAST(c_nationkey AS VARCHAR)) END AS theater_raw, "
    "CASE c_custkey % 6 WHEN 0 THEN '2024-02-30' WHEN 1 THEN '' ELSE ' 2024-02-29' END AS hired_raw "
    "FROM customer"
)
def raw_members(d):
    """Team-member input as people type it."""
    key, nation = F.col("c_custkey"), text(F.col("c_nationkey"))
    address = F.concat(
        F.lit("\u2003"), F.upper(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@Example.COM")
    )
    return d.customer.select(
        key.alias("doc_id"),
        pick(
            key % 11,
            {0: "", 1: F.lit(None).cast("string")},
            F.concat(F.lit("\t"), "c_name", F.lit(" ")),
        ).alias("firstName"),
        F.concat("c_mktsegment", F.lit("\u00a0")).alias("lastName"),
        pick(key % 13, {0: "not-an-email", 1: " "}, address).alias("email"),
        pick(key % 4, {0: "", 1: F.lit(None).cast("string")}, F.lit(" 000-1 ")).alias("phone"),
        pick(key % 7, {0: "owner", 1: " manager "}, "Staff").alias("role"),
        F.lit(None).cast("string").alias("department"),
        pick(key % 5, {0: F.lit(None).cast("string"), 1: "gone"}, "active").alias("status"),
        pick(
            key % 3, {0: F.concat(nation, F.lit("abc")), 1: "x"}, F.concat(F.lit(" -"), nation)
        ).alias("theaterId"),
        pick(key % 6, {0: "2024-02-30", 1: ""}, " 2024-02-29").alias("hiredAt"),
    )


@relation(
    "SELECT o_orderkey AS doc_id, CAST(o_custkey + CASE WHEN o_orderkey % 43 = 0 THEN 1000000000 "
    "ELSE 0 END AS VARCHAR) || CASE WHEN o_orderkey % 9 = 0 THEN 'x' ELSE '' END AS user_raw, "
    "CASE WHEN o_orderkey % 23 = 0 THEN 'none' ELSE CAST(o_orderkey AS VARCHAR) END "
    "AS showtime_raw, CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN NULL "
    "ELSE ' Pending ' END AS status_raw, CASE WHEN o_orderkey % 19 = 0 THEN '-5' "
    "ELSE CAST(CAST(o_totalprice AS DECIMAL(10,2)) AS VARCHAR) END AS total_raw, "
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'card' WHEN '2-HIGH' THEN ' Wallet ' "
    "WHEN '3-MEDIUM' THEN 'crypto' WHEN '4-NOT SPECIFIED' THEN '' ELSE NULL END AS method_raw, "
    "CASE o_orderstatus WHEN 'P' THEN 'pending' ELSE NULL END AS payment_status_raw, "
    "CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 4 = 1 "
    "THEN CONCAT(' REF-', CAST(o_orderkey AS VARCHAR)) "
    "ELSE CONCAT(' NEW-', CAST(o_orderkey // 8 AS VARCHAR)) END AS ref_raw FROM orders"
)
def raw_bookings(d):
    """Booking documents with 0 to 3 seats each.

    Some name users that do not exist, a seat twice, or a reference that is stored or comes again.
    """
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    none = F.lit(None).cast("string")
    amount = text(F.col("o_totalprice").cast(MONEY))

    def seat(i: int):
        number = F.when(key % 41 == 0, F.lit(" 1-")) if i == 2 else F.lit(None)
        label = F.concat(F.coalesce(number, F.lit(f" {i}-")), text(F.col("o_custkey")))
        price = F.lit(f"{i}0.50 each")
        if i == 1:
            label = F.when(key % 29 == 0, F.lit(" ")).otherwise(label)
        if i == 2:
            price = F.when(key % 31 == 0, F.lit("free")).otherwise(price)
        return F.struct(label.alias("seatLabel"), price.alias("price"))

    return d.orders.select(
        key.alias("doc_id"),
        F.concat(
            text(F.col("o_custkey") + F.when(key % 43 == 0, 1000000000).otherwise(0)),
            F.when(key % 9 == 0, F.lit("x")).otherwise(F.lit("")),
        ).alias("userId"),
        F.when(key % 23 == 0, F.lit("none")).otherwise(text(key)).alias("showtimeId"),
        pick(status, {"F": "confirmed", "O": none}, " Pending ").alias("status"),
        F.when(key % 19 == 0, F.lit("-5")).otherwise(amount).alias("totalAmount"),
        pick(
            F.col("o_orderpriority"),
            {"1-URGENT": "card", "2-HIGH": " Wallet ", "3-MEDIUM": "crypto", "4-NOT SPECIFIED": ""},
        ).alias("paymentMethod"),
        F.when(status == "P", F.lit("pending")).alias("paymentStatus"),
        F.when(key % 3 == 0, F.lit(""))
        .when(key % 4 == 1, F.concat(F.lit(" REF-"), text(key)))
        .otherwise(F.concat(F.lit(" NEW-"), text(F.expr("o_orderkey div 8"))))
        .alias("transactionRef"),
        F.slice(F.array(seat(1), seat(2), seat(3)), F.lit(1), (key % 4).cast("int")).alias("seats"),
    )


@relation(
    "SELECT o_orderkey AS doc_id, i AS seat_no, CASE WHEN i = 1 AND o_orderkey % 29 = 0 THEN ' ' "
    "ELSE CONCAT(' ', CAST(CASE WHEN i = 2 AND o_orderkey % 41 = 0 THEN 1 ELSE i END AS VARCHAR), "
    "'-', CAST(o_custkey AS VARCHAR)) END AS label_raw, "
    "CASE WHEN i = 2 AND o_orderkey % 31 = 0 THEN 'free' "
    "ELSE CONCAT(CAST(i AS VARCHAR), '0.50 each') END AS price_raw "
    "FROM orders, (VALUES (1), (2), (3)) AS n(i) WHERE i <= o_orderkey % 4"
)
def raw_seats(d):
    """The seats of the booking documents, one per row (the check's form of the arrays)."""
    return d.raw_bookings.select("doc_id", F.posexplode("seats").alias("seat_no", "seat"))
