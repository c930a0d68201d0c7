"""Generators: showtimes, shifts, fallback slots, watchlists and rows per staff member."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import at_time, iso_weekday, literal_date, literal_stamp
from marquee.operators.filters import morning_shift
from marquee.operators.joins import first_by, missing_in, top_values, with_each
from marquee.operators.ranking import stagger

_HOUR, _DAY = 3600, 86400


def resolve_slots(
    slots: DataFrame, movies: DataFrame, screens: DataFrame, theaters: DataFrame
) -> DataFrame:
    """Replace movie title, theater name and screen name by ids; unknown names drop out."""
    movie = movies.select(F.col("id").alias("movie_id"), F.col("title").alias("movie_title"))
    hall = screens.select(
        F.col("id").alias("screen_id"), "theater_id", F.col("name").alias("screen_name")
    ).join(
        theaters.select(F.col("id").alias("theater_id"), F.col("name").alias("theater_name")),
        "theater_id",
    )
    resolved = slots.join(movie, "movie_title").join(hall, ["theater_name", "screen_name"])
    rest = [c for c in slots.columns if c not in ("movie_title", "theater_name", "screen_name")]
    return resolved.select("movie_id", "screen_id", *rest)


def span_days(first: str, last: str) -> int:
    """Number of days from first to last, both included."""
    return (date.fromisoformat(last) - date.fromisoformat(first)).days + 1


def day_words(days: int, among: str = "TRUE") -> Column:
    """Aggregate: the days ``_i`` (from 0) of the rows that fulfil ``among``, a bit each in 64-bit words."""
    words = range(-(-days // 64))
    bits = [f"bit_or(IF(_i div 64 = {w} AND {among}, shiftleft(1L, _i % 64), 0L))" for w in words]
    return F.array(*[F.expr(b) for b in bits])


def has_day(words: Column, i: Column) -> Column:
    """Whether day ``i`` is set; false where there are no words."""
    word = F.get(words, F.floor(i / 64).cast("int"))
    bit = F.call_function("shiftright", word, i % 64).bitwiseAND(F.lit(1).cast("bigint"))
    return F.coalesce(bit == 1, F.lit(False))


def on_days(df: DataFrame, first: str, days: int, wanted: Callable[[Column], Column], name: str) -> DataFrame:
    """Every row once per day of a span for which ``wanted`` (of the day's number) holds."""
    numbers = F.filter(F.sequence(F.lit(0), F.lit(days - 1)), wanted)
    numbered = df.withColumn("_i", F.explode(numbers))
    return numbered.withColumn(name, F.date_add(literal_date(first), F.col("_i"))).drop("_i")


def generate_showtimes(
    templates: DataFrame,
    first: str,
    last: str,
    movies: DataFrame,
    screens: DataFrame,
    theaters: DataFrame,
    showtimes: DataFrame,
    shift_hours: int = 0,
) -> DataFrame:
    """Templates on every day of a span as showtimes; those already there are left out.

    ``templates`` has names, ``start_sec`` (a time of day), ``duration_min`` and any columns to keep.
    ``shift_hours`` is added to both ends.

    The days on which a slot is taken are a bit each, one small row per movie, screen and time of
    day; only days that are free become rows.
    """
    days = span_days(first, last)
    if days < 1:
        days, templates = 1, templates.limit(0)
    shifted = shift_hours * _HOUR // _DAY  # whole days; a late start may add one more
    start = F.col("start_sec") + F.lit(shift_hours * _HOUR)
    slots = resolve_slots(templates, movies, screens, theaters).withColumns(
        {"_clock": F.pmod(start, F.lit(_DAY)).cast("int"), "_late": (F.floor(start / _DAY) - shifted).cast("int")}
    )
    at = F.col("start_time")
    clock = F.hour(at) * _HOUR + F.minute(at) * 60 + F.second(at)
    taken = (
        showtimes.where(F.date_trunc("second", at) == at)
        .select(
            F.col("movie_id").alias("_movie"),
            F.col("screen_id").alias("_screen"),
            clock.alias("_time"),
            (F.datediff(at.cast("date"), literal_date(first)) - shifted).alias("_i"),
        )
        .where(F.col("_i").between(0, days))
        .groupBy("_movie", "_screen", "_time")
        .agg(day_words(days + 1).alias("_taken"))
    )
    same = (
        (F.col("movie_id") == F.col("_movie")) & (F.col("screen_id") == F.col("_screen")) & (F.col("_clock") == F.col("_time"))
    )
    free = lambda i: ~has_day(F.col("_taken"), i + F.col("_late"))
    daily = on_days(slots.join(taken, same, "left"), first, days, free, "_day")
    rest = [c for c in slots.columns if c not in ("start_sec", "duration_min", "_clock", "_late")]
    return daily.select(
        *rest,
        at_time(F.col("_day"), start).alias("start_time"),
        at_time(F.col("_day"), start + F.col("duration_min") * 60).alias("end_time"),
    )


def active_staff(members: DataFrame) -> DataFrame:
    return members.where((F.col("role") == "STAFF") & (F.col("status") == "ACTIVE"))


def shift_role(department: Column) -> Column:
    name = F.coalesce(department, F.lit(""))
    return (
        F.when(name.ilike("%box%"), F.lit("Box Office"))
        .when(name.ilike("%floor%"), F.lit("Floor Staff"))
        .otherwise(F.lit("Guest Support"))
    )


def shift_start(morning: Column) -> Column:
    return F.when(morning, F.lit(9 * _HOUR)).otherwise(F.lit(14 * _HOUR))


def generate_shifts(members: DataFrame, first: str, last: str, schedules: DataFrame) -> DataFrame:
    """A morning or evening shift for each active staff member, Monday to Saturday.

    The days a member has a shift from each start are a bit each; only free days become rows.
    """
    days = span_days(first, last)
    if days < 1:
        days, members = 1, members.limit(0)
    staff = active_staff(members).select(F.col("id").alias("team_member_id"), "department")
    begins = {"_am": 9 * _HOUR, "_pm": 14 * _HOUR}
    taken = (
        schedules.withColumn("_i", F.datediff("shift_date", literal_date(first)))
        .where(F.col("_i").between(0, days - 1) & F.col("start_sec").isin(list(begins.values())))
        .groupBy(F.col("team_member_id").alias("_member"))
        .agg(*[day_words(days, f"start_sec = {sec}").alias(name) for name, sec in begins.items()])
    )

    def free(i: Column) -> Column:
        day = F.date_add(literal_date(first), i)
        morning = morning_shift(F.col("team_member_id"), day)
        busy = F.when(morning, has_day(F.col("_am"), i)).otherwise(has_day(F.col("_pm"), i))
        return iso_weekday(day).between(1, 6) & ~busy

    known = staff.join(taken, F.col("team_member_id") == F.col("_member"), "left")
    shifts = on_days(known, first, days, free, "shift_date")
    morning = morning_shift(F.col("team_member_id"), F.col("shift_date"))
    return shifts.select(
        "team_member_id",
        "shift_date",
        shift_start(morning).alias("start_sec"),
        F.when(morning, F.lit(17 * _HOUR)).otherwise(F.lit(22 * _HOUR)).alias("end_sec"),
        shift_role(F.col("department")).alias("role_on_shift"),
        F.when(morning, F.lit("Morning shift")).otherwise(F.lit("Evening shift")).alias("notes"),
        F.lit("SCHEDULED").alias("status"),
    )


def fallback_slots(
    movies: DataFrame,
    screens: DataFrame,
    showtimes: DataFrame,
    start: str,
    step_hours: int = 3,
    length_hours: int = 2,
) -> DataFrame:
    """One slot on the first screen for each movie without a showtime, a step apart."""
    idle = missing_in(
        movies.select(F.col("id").alias("movie_id")), showtimes, ["movie_id"]
    )
    timed = stagger(idle, ["movie_id"], literal_stamp(start), step_hours * _HOUR, "start_time")
    return timed.select(
        "movie_id",
        first_by(screens, "id", "id").alias("screen_id"),
        "start_time",
        (F.col("start_time") + F.make_dt_interval(hours=F.lit(length_hours))).alias("end_time"),
        F.lit("180.00").cast("decimal(10,2)").alias("price"),
        F.lit("English").alias("language"),
        F.lit("2D").alias("format"),
    )


def bookable(movies: DataFrame) -> DataFrame:
    return movies.where(F.col("status").isin("NOW_SHOWING", "COMING_SOON"))


def seed_watchlist(
    users: DataFrame, movies: DataFrame, watchlist: DataFrame, k: int = 3
) -> DataFrame:
    """Every customer with the first k bookable movies; pairs already there are left out."""
    customers = users.where(F.col("role") == "CUSTOMER").select(F.col("id").alias("user_id"))
    pairs = customers.withColumn("movie_id", F.explode(top_values(bookable(movies), "id", k)))
    return missing_in(pairs, watchlist, ["user_id", "movie_id"])


def assign_members(
    members: DataFrame,
    rows: Sequence[Sequence[Column]],
    names: Sequence[str],
    current: DataFrame,
    keys: Sequence[str],
    null_safe: Sequence[str] = (),
) -> DataFrame:
    """A few fixed rows for each active staff member; those already there are left out."""
    staff = active_staff(members).select(F.col("id").alias("team_member_id"))
    given = with_each(staff, rows, names)
    return missing_in(given, current, ["team_member_id", *keys], null_safe=null_safe)
