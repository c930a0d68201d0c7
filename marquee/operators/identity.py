"""Resolving requests that name a person by id, by email, or both.

A request has ``id`` and ``email``, either may be null.  An id of 0 counts as absent.
Emails compare trimmed and without letter case; when several rows share a folded email,
the lowest id wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions import empty_to_null, falsy_zero, lower_trim
from marquee.operators.skew import join_unique


def _by_email(people: DataFrame, alias: str) -> DataFrame:
    return (
        people.where(F.col("email").isNotNull())
        .groupBy(F.lower("email").alias("_email"))
        .agg(F.min("id").alias(alias))
    )


def _by_id(people: DataFrame, alias: str) -> DataFrame:
    return people.select(F.col("id").alias(alias))


def _prepared(requests: DataFrame) -> DataFrame:
    return requests.withColumns(
        {"_id": falsy_zero(F.col("id")), "_mail": empty_to_null(lower_trim(F.col("email")))}
    )


def resolve_user(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Add ``user_id``: the id if a user has it, else the user with the email, else null."""
    left = _prepared(requests)
    hit = left.join(_by_id(users, "_hit"), F.col("_id") == F.col("_hit"), "left")
    # The email is tried only where the id found nobody.
    tried = hit.withColumn("_try", F.when(F.col("_hit").isNull(), F.col("_mail")))
    both = join_unique(tried, _by_email(users, "_found"), "_try", "_email")
    return both.select(*requests.columns, F.coalesce("_hit", "_found").alias("user_id"))


def _by_either(people: DataFrame, alias: str) -> DataFrame:
    """Both names of each person in one column ``_tag``: '#' and the id, '@' and the folded email."""
    names = F.array(
        F.concat(F.lit("#"), F.col("id").cast("string")), F.concat(F.lit("@"), F.lower("email"))
    )
    tagged = people.select("id", F.explode(names).alias("_tag")).where(F.col("_tag").isNotNull())
    return tagged.groupBy("_tag").agg(F.min("id").alias(alias))


def resolve_user_strict(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Add ``user_id``: a given id (1 or above) is the only thing tried, else the email.

    A request tries one name, so ids and emails are looked up together in one join.
    """
    by_id = F.when(F.col("_id") >= 1, F.concat(F.lit("#"), F.col("_id").cast("string")))
    tried = _prepared(requests).withColumn("_try", F.coalesce(by_id, F.concat(F.lit("@"), F.col("_mail"))))
    both = join_unique(tried, _by_either(users, "_found"), "_try", "_tag")
    return both.select(*requests.columns, F.col("_found").alias("user_id"))


def resolve_member(
    requests: DataFrame, members: DataFrame, positive_only: bool = False
) -> DataFrame:
    """Add ``team_member_id``: a given id is trusted unchecked, else the email is looked up.

    ``positive_only`` ignores ids below 1, as the schedule and time-off requests do; the
    task and time-record requests take any id but 0.
    """
    left = _prepared(requests)
    if positive_only:
        left = left.withColumn("_id", F.when(F.col("_id") >= 1, F.col("_id")))
    tried = left.withColumn("_try", F.when(F.col("_id").isNull(), F.col("_mail")))
    both = join_unique(tried, _by_email(members, "_found"), "_try", "_email")
    return both.select(*requests.columns, F.coalesce("_id", "_found").alias("team_member_id"))


def one_per_email(people: DataFrame) -> DataFrame:
    """The lowest id for each email, letter case aside."""
    return people.groupBy(F.lower("email").alias("email")).agg(F.min("id").alias("id"))


def lookup(requests: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """Each requested id with the row it names.

    ``outcome`` is FOUND, NOT_FOUND, or INVALID for an id that is null or below 1.
    """
    valid = F.coalesce(F.col(key) >= 1, F.lit(False))
    asked = requests.withColumn("_key", F.when(valid, F.col(key)))
    rows = table.withColumnRenamed(key, "_row_key")
    joined = asked.join(rows, F.col("_key") == F.col("_row_key"), "left")
    outcome = (
        F.when(F.col("_key").isNull(), F.lit("INVALID"))
        .when(F.col("_row_key").isNull(), F.lit("NOT_FOUND"))
        .otherwise(F.lit("FOUND"))
    )
    return joined.withColumn("outcome", outcome).drop("_key", "_row_key")


def scoped(requests: DataFrame, table: DataFrame, key: str, owner: str) -> DataFrame:
    """Rows of ``table`` named by both id and owner in a request."""
    wanted = requests.select(F.col(key).alias("_k"), F.col(owner).alias("_o")).distinct()
    return table.join(
        wanted, (F.col(key) == F.col("_k")) & (F.col(owner) == F.col("_o")), "left_semi"
    )
