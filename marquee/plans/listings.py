"""The listings: a table with the names of its parents, filters, an order, a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import lower_trim
from marquee.operators.filters import (
    enum_equal,
    equal,
    member_search,
    optional_filter,
    since,
    until,
)
from marquee.operators.joins import with_parent
from marquee.operators.paging import (
    ITEMS_DEFAULT_LIMIT,
    ITEMS_MAX_LIMIT,
    Page,
    leading_int,
    page_of,
)

Tables = dict[str, DataFrame]

MEMBER_NAME = {"first_name": "first_name", "last_name": "last_name", "email": "email"}


NEWEST_FIRST = ["-id"]
#: Due date, then due time, tasks without one last, newest first among equals.
TASK_ORDER = ["due_date", "due_sec", "-id"]
RECORD_ORDER = ["-work_date", "-clock_in_at", "-id"]


def showtime_listing(
    showtimes: DataFrame, movies: DataFrame, screens: DataFrame, theaters: DataFrame
) -> DataFrame:
    """Showtimes with movie title, screen name and size, and theater name."""
    halls = with_parent(screens, theaters, "theater_id", {"name": "theater_name"})
    titled = with_parent(showtimes, movies, "movie_id", {"title": "movie_title"})
    return with_parent(
        titled,
        halls,
        "screen_id",
        {
            "name": "screen_name",
            "total_seats": "screen_total_seats",
            "theater_name": "theater_name",
        },
    )


def booking_listing(
    bookings: DataFrame, users: DataFrame, showtimes: DataFrame, movies: DataFrame
) -> DataFrame:
    """Bookings with user email, movie title and start time."""
    timed = with_parent(showtimes, movies, "movie_id", {"title": "movie_title"})
    mailed = with_parent(bookings, users, "user_id", {"email": "user_email"})
    return with_parent(
        mailed, timed, "showtime_id", {"movie_title": "movie_title", "start_time": "start_time"}
    )


def with_theater(df: DataFrame, theaters: DataFrame) -> DataFrame:
    return with_parent(df, theaters, "theater_id", {"name": "theater_name"})


def with_optional_theater(df: DataFrame, theaters: DataFrame) -> DataFrame:
    return with_parent(df, theaters, "theater_id", {"name": "theater_name"}, how="left")


def with_member(df: DataFrame, members: DataFrame) -> DataFrame:
    return with_parent(df, members, "team_member_id", MEMBER_NAME)


def _member_clause(
    members: DataFrame, team_member_id, email: str | None, unresolved: str
) -> Column | None:
    """Clause for "records of this member", named by id or else by email.

    An email nobody has selects every row (``unresolved="all"``) or none (``"none"``).
    """
    number = leading_int(team_member_id)
    if number:
        return F.col("team_member_id") == number
    if not (email or "").strip():
        return None if unresolved == "all" else F.lit(False)
    found = (
        members.where(F.lower("email") == lower_trim(F.lit(email)))
        .agg(F.min("id").alias("id"))
        .scalar()
    )
    if unresolved == "all":
        return F.col("team_member_id") == F.coalesce(found, F.col("team_member_id"))
    return F.col("team_member_id") == found


def list_items(t: Tables, page=None, limit=None) -> Page:
    items = t["items"]
    bounds = (ITEMS_DEFAULT_LIMIT, ITEMS_MAX_LIMIT)
    return page_of(items, NEWEST_FIRST, page, limit, *bounds)


def list_theaters(t: Tables, page=None, limit=None) -> Page:
    return page_of(t["theaters"], NEWEST_FIRST, page, limit)


def list_movies(t: Tables, page=None, limit=None, status: str | None = None) -> Page:
    kept = optional_filter(t["movies"], enum_equal("status", status, trim=False))
    return page_of(kept, NEWEST_FIRST, page, limit)


def list_screens(t: Tables, page=None, limit=None, theater_id=None) -> Page:
    kept = optional_filter(t["screens"], equal("theater_id", leading_int(theater_id)))
    named = lambda rows: with_theater(rows, t["theaters"])
    return page_of(kept, NEWEST_FIRST, page, limit, named=named)


def list_showtimes(t: Tables, page=None, limit=None, movie_id=None, screen_id=None) -> Page:
    kept = optional_filter(
        t["showtimes"],
        equal("movie_id", leading_int(movie_id)),
        equal("screen_id", leading_int(screen_id)),
    )
    named = lambda rows: showtime_listing(rows, t["movies"], t["screens"], t["theaters"])
    return page_of(kept, ["start_time", "id"], page, limit, named=named)


def list_bookings(t: Tables, page=None, limit=None, user_id=None) -> Page:
    kept = optional_filter(t["bookings"], equal("user_id", leading_int(user_id)))
    named = lambda rows: booking_listing(rows, t["users"], t["showtimes"], t["movies"])
    return page_of(kept, NEWEST_FIRST, page, limit, named=named)


def list_members(t: Tables, page=None, limit=None, role=None, status=None, q=None) -> Page:
    kept = optional_filter(
        t["team_members"],
        enum_equal("role", role),
        enum_equal("status", status),
        member_search(q),
    )
    named = lambda rows: with_optional_theater(rows, t["theaters"])
    return page_of(kept, NEWEST_FIRST, page, limit, named=named)


def list_tasks(
    t: Tables,
    page=None,
    limit=None,
    team_member_id=None,
    email=None,
    status=None,
    unresolved: str = "all",
) -> Page:
    """Tasks of a member; an unknown email lists everybody's unless ``unresolved="none"``."""
    kept = optional_filter(
        t["staff_tasks"],
        _member_clause(t["team_members"], team_member_id, email, unresolved),
        enum_equal("status", status),
    )
    named = lambda rows: with_member(rows, t["team_members"])
    return page_of(kept, TASK_ORDER, page, limit, named=named)


def list_records(
    t: Tables,
    page=None,
    limit=None,
    team_member_id=None,
    email=None,
    start=None,
    end=None,
    status=None,
    unresolved: str = "all",
) -> Page:
    """Time records of a member; unknown emails as for tasks."""
    kept = optional_filter(
        t["staff_time_records"],
        _member_clause(t["team_members"], team_member_id, email, unresolved),
        since("work_date", (start or "").strip()),
        until("work_date", (end or "").strip()),
        enum_equal("status", status),
    )
    named = lambda rows: with_member(rows, t["team_members"])
    return page_of(kept, RECORD_ORDER, page, limit, named=named)


def _positive(value) -> int | None:
    number = leading_int(value)
    return number if number and number >= 1 else None


def list_schedules(t: Tables, team_member_id=None, email=None) -> DataFrame:
    """All shifts of one member in order; none when nobody is named or the email is unknown."""
    clause = _member_clause(t["team_members"], _positive(team_member_id), email, "none")
    listing = with_member(t["staff_schedules"].where(clause), t["team_members"])
    return listing.orderBy("shift_date", "start_sec", "id")


def list_time_off(t: Tables, team_member_id=None, email=None) -> DataFrame:
    """Time-off requests of one member, newest first; none when nobody is named."""
    clause = _member_clause(t["team_members"], _positive(team_member_id), email, "none")
    kept = t["staff_time_off_requests"].where(clause)
    return kept.orderBy(F.col("created_at").desc(), F.col("id").desc())
