"""The fifteen tables: columns, defaults, allowed values, keys and references.

``NOW`` as a default means "the time of the write", which callers pass in.
"""

from __future__ import annotations

from dataclasses import dataclass, field

NOW = object()
STAMP = "timestamp_ntz"
MONEY = "decimal(10,2)"


@dataclass(frozen=True)
class Table:
    columns: dict[str, str]
    required: tuple[str, ...]
    defaults: dict[str, object] = field(default_factory=dict)
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    checks: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    # foreign key column -> (parent table, "cascade" or "null")
    references: dict[str, tuple[str, str]] = field(default_factory=dict)

    @property
    def ddl(self) -> str:
        return ", ".join(f"{name} {kind}" for name, kind in self.columns.items())


_AUDIT = {"created_at": STAMP, "updated_at": STAMP}
_AUDIT_NOW = {"created_at": NOW, "updated_at": NOW}

# The status, role, method and priority lists.
MOVIE_STATUS = ("NOW_SHOWING", "COMING_SOON", "ARCHIVED")
USER_ROLE = ("CUSTOMER", "STAFF", "ADMIN")
BOOKING_STATUS = ("PENDING", "CONFIRMED", "CANCELLED", "REFUNDED")
PAYMENT_METHOD = ("CARD", "CASH", "WALLET", "ONLINE_BANKING")
PAYMENT_STATUS = ("PENDING", "PAID", "FAILED", "REFUNDED")
MEMBER_ROLE = ("ADMIN", "MANAGER", "STAFF")
MEMBER_STATUS = ("ACTIVE", "INACTIVE", "ON_LEAVE")
SHIFT_STATUS = ("SCHEDULED", "COMPLETED", "CANCELLED")
TIME_OFF_TYPE = ("VACATION", "SICK", "PERSONAL", "OTHER")
TIME_OFF_STATUS = ("PENDING", "APPROVED", "REJECTED", "CANCELLED")
TASK_PRIORITY = ("LOW", "MEDIUM", "HIGH")
TASK_STATUS = ("PENDING", "IN_PROGRESS", "COMPLETED", "CANCELLED")
RECORD_STATUS = ("CLOCKED_IN", "COMPLETED", "MISSED", "ABSENT")

TABLES: dict[str, Table] = {
    "items": Table(
        {"id": "bigint", "name": "string", "value": "string", **_AUDIT},
        required=("id", "name", "value"),
        defaults=_AUDIT_NOW,
    ),
    "users": Table(
        {
            "id": "bigint",
            "first_name": "string",
            "last_name": "string",
            "email": "string",
            "phone": "string",
            "profile_photo": "string",
            "password_hash": "string",
            "role": "string",
            **_AUDIT,
        },
        required=("id", "first_name", "last_name", "email", "password_hash", "role"),
        defaults={"role": "CUSTOMER", **_AUDIT_NOW},
        enums={"role": USER_ROLE},
        unique=(("email",),),
    ),
    "movies": Table(
        {
            "id": "bigint",
            "title": "string",
            "description": "string",
            "duration_min": "int",
            "rating": "string",
            "release_date": "date",
            "poster_url": "string",
            "status": "string",
            **_AUDIT,
        },
        required=("id", "title", "duration_min", "status"),
        defaults={"status": "COMING_SOON", **_AUDIT_NOW},
        enums={"status": MOVIE_STATUS},
        checks=("duration_min > 0",),
    ),
    "theaters": Table(
        {
            "id": "bigint",
            "name": "string",
            "location": "string",
            "address": "string",
            "city": "string",
            **_AUDIT,
        },
        required=("id", "name", "city"),
        defaults=_AUDIT_NOW,
    ),
    "screens": Table(
        {"id": "bigint", "theater_id": "bigint", "name": "string", "total_seats": "int", **_AUDIT},
        required=("id", "theater_id", "name", "total_seats"),
        defaults=_AUDIT_NOW,
        checks=("total_seats > 0",),
        unique=(("theater_id", "name"),),
        references={"theater_id": ("theaters", "cascade")},
    ),
    "showtimes": Table(
        {
            "id": "bigint",
            "movie_id": "bigint",
            "screen_id": "bigint",
            "start_time": STAMP,
            "end_time": STAMP,
            "price": MONEY,
            "language": "string",
            "format": "string",
            **_AUDIT,
        },
        required=("id", "movie_id", "screen_id", "start_time", "end_time", "price"),
        defaults=_AUDIT_NOW,
        checks=("price >= 0", "end_time > start_time"),
        references={"movie_id": ("movies", "cascade"), "screen_id": ("screens", "cascade")},
    ),
    "bookings": Table(
        {
            "id": "bigint",
            "user_id": "bigint",
            "showtime_id": "bigint",
            "status": "string",
            "total_amount": MONEY,
            "booked_at": STAMP,
        },
        required=("id", "user_id", "showtime_id", "status", "total_amount", "booked_at"),
        defaults={"status": "PENDING", "booked_at": NOW},
        enums={"status": BOOKING_STATUS},
        checks=("total_amount >= 0",),
        references={"user_id": ("users", "cascade"), "showtime_id": ("showtimes", "cascade")},
    ),
    "booking_seats": Table(
        {
            "id": "bigint",
            "booking_id": "bigint",
            "seat_label": "string",
            "price": MONEY,
            "created_at": STAMP,
        },
        required=("id", "booking_id", "seat_label", "price"),
        defaults={"created_at": NOW},
        checks=("price >= 0",),
        unique=(("booking_id", "seat_label"),),
        references={"booking_id": ("bookings", "cascade")},
    ),
    "payments": Table(
        {
            "id": "bigint",
            "booking_id": "bigint",
            "method": "string",
            "amount": MONEY,
            "status": "string",
            "paid_at": STAMP,
            "transaction_ref": "string",
            "created_at": STAMP,
        },
        required=("id", "booking_id", "method", "amount", "status"),
        defaults={"status": "PENDING", "created_at": NOW},
        enums={"method": PAYMENT_METHOD, "status": PAYMENT_STATUS},
        checks=("amount >= 0",),
        unique=(("transaction_ref",),),
        references={"booking_id": ("bookings", "cascade")},
    ),
    "watchlist": Table(
        {"id": "bigint", "user_id": "bigint", "movie_id": "bigint", "created_at": STAMP},
        required=("id", "user_id", "movie_id"),
        defaults={"created_at": NOW},
        unique=(("user_id", "movie_id"),),
        references={"user_id": ("users", "cascade"), "movie_id": ("movies", "cascade")},
    ),
    "team_members": Table(
        {
            "id": "bigint",
            "first_name": "string",
            "last_name": "string",
            "email": "string",
            "phone": "string",
            "role": "string",
            "department": "string",
            "status": "string",
            "theater_id": "bigint",
            "hired_at": "date",
            **_AUDIT,
        },
        required=("id", "first_name", "last_name", "email", "role", "status"),
        defaults={"status": "ACTIVE", **_AUDIT_NOW},
        enums={"role": MEMBER_ROLE, "status": MEMBER_STATUS},
        unique=(("email",),),
        references={"theater_id": ("theaters", "null")},
    ),
    "staff_schedules": Table(
        {
            "id": "bigint",
            "team_member_id": "bigint",
            "shift_date": "date",
            "start_sec": "int",
            "end_sec": "int",
            "role_on_shift": "string",
            "notes": "string",
            "status": "string",
            **_AUDIT,
        },
        required=("id", "team_member_id", "shift_date", "start_sec", "end_sec", "status"),
        defaults={"status": "SCHEDULED", **_AUDIT_NOW},
        enums={"status": SHIFT_STATUS},
        checks=("end_sec > start_sec",),
        unique=(("team_member_id", "shift_date", "start_sec"),),
        references={"team_member_id": ("team_members", "cascade")},
    ),
    "staff_time_off_requests": Table(
        {
            "id": "bigint",
            "team_member_id": "bigint",
            "request_type": "string",
            "start_date": "date",
            "end_date": "date",
            "partial_day": "boolean",
            "partial_start_sec": "int",
            "partial_end_sec": "int",
            "reason": "string",
            "status": "string",
            **_AUDIT,
        },
        required=(
            "id",
            "team_member_id",
            "request_type",
            "start_date",
            "end_date",
            "partial_day",
            "reason",
            "status",
        ),
        defaults={
            "request_type": "VACATION",
            "partial_day": False,
            "status": "PENDING",
            **_AUDIT_NOW,
        },
        enums={"request_type": TIME_OFF_TYPE, "status": TIME_OFF_STATUS},
        checks=("end_date >= start_date",),
        references={"team_member_id": ("team_members", "cascade")},
    ),
    "staff_tasks": Table(
        {
            "id": "bigint",
            "team_member_id": "bigint",
            "title": "string",
            "description": "string",
            "priority": "string",
            "due_date": "date",
            "due_sec": "int",
            "status": "string",
            **_AUDIT,
            "completed_at": STAMP,
        },
        required=("id", "team_member_id", "title", "priority", "status"),
        defaults={"priority": "MEDIUM", "status": "PENDING", **_AUDIT_NOW},
        enums={"priority": TASK_PRIORITY, "status": TASK_STATUS},
        references={"team_member_id": ("team_members", "cascade")},
    ),
    "staff_time_records": Table(
        {
            "id": "bigint",
            "team_member_id": "bigint",
            "work_date": "date",
            "clock_in_at": STAMP,
            "clock_out_at": STAMP,
            "break_minutes": "int",
            "notes": "string",
            "status": "string",
            **_AUDIT,
        },
        required=("id", "team_member_id", "work_date", "clock_in_at", "break_minutes", "status"),
        defaults={"break_minutes": 0, "status": "CLOCKED_IN", **_AUDIT_NOW},
        enums={"status": RECORD_STATUS},
        checks=("break_minutes >= 0",),
        unique=(("team_member_id", "work_date"),),
        references={"team_member_id": ("team_members", "cascade")},
    ),
}


def children_of(table: str) -> list[tuple[str, str, str]]:
    """(child table, foreign key column, action on delete) for every reference to a table."""
    return [
        (name, column, action)
        for name, spec in TABLES.items()
        for column, (parent, action) in spec.references.items()
        if parent == table
    ]
