"""Taking in tasks, time records and time-off requests for staff members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators.changes import with_completed_at
from marquee.operators.identity import resolve_member
from marquee.operators.payloads import normalize, split
from marquee.operators.ranking import assign_ids, highest_id
from marquee.sources import conform

MEMBER_UNKNOWN = "Team member not found."

# Kinds whose requests ignore ids below 1.
_POSITIVE_ONLY = {"staff_time_off_requests"}


def admit(
    raw: DataFrame, kind: str, current: DataFrame, members: DataFrame, seq: str, now: str
) -> tuple[DataFrame, DataFrame]:
    """A raw batch for a staff table: (new rows with ids, rejected rows with the error).

    Each row names its member by id or email; one that names nobody is rejected.
    """
    good, bad = split(normalize(raw, kind, [seq]))
    asked = good.withColumnRenamed("team_member_id", "id")
    named = resolve_member(asked, members, kind in _POSITIVE_ONLY).drop("id", "email")
    known = named.where(F.col("team_member_id").isNotNull())
    nobody = named.where(F.col("team_member_id").isNull())
    if kind == "staff_tasks":
        known = with_completed_at(known, now)
    rows = assign_ids(known.withColumn("id", F.lit(None)), highest_id(current), [seq])
    rejected = bad.select(seq, "error").unionByName(
        nobody.select(seq, F.lit(MEMBER_UNKNOWN).alias("error"))
    )
    return conform(rows, kind, now), rejected
