"""Accounts: payload shape, profile patches and the link to team members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions import user_role
from marquee.operators.changes import one_per_key, stamped, update_sparse, upsert
from marquee.operators.identity import resolve_user_strict
from marquee.operators.payloads import normalize, split
from marquee.operators.quality import reject_existing
from marquee.operators.ranking import assign_ids, highest_id
from marquee.session import durable
from marquee.sources import conform

# Payload name of each column that is handed out; the password hash never is.
USER_PAYLOAD = {
    "id": "id",
    "first_name": "firstName",
    "last_name": "lastName",
    "email": "email",
    "phone": "phone",
    "profile_photo": "profilePhoto",
    "role": "role",
    "created_at": "createdAt",
    "updated_at": "updatedAt",
}


def to_user_payload(users: DataFrame) -> DataFrame:
    """Camel-case names, '' for a missing photo, no password hash."""
    shaped = users.withColumn("profile_photo", F.coalesce("profile_photo", F.lit("")))
    return shaped.select(
        *[F.col(c).alias(name) for c, name in USER_PAYLOAD.items() if c in users.columns]
    )


def register(
    users: DataFrame, raw: DataFrame, seq: str, now: str, kept: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Registrations in the order of ``seq``: (new account rows, rejected ones with the error).

    ``kept`` names further raw columns to carry into the accounts, such as password_hash.
    """
    checked = normalize(raw, "accounts", [seq, *(kept or [])])
    good, bad = split(checked)
    fresh, taken = split(reject_existing(good, users, seq))
    rows = assign_ids(fresh.withColumn("id", F.lit(None)), highest_id(users), [seq])
    rejected = bad.select(seq, "error").unionByName(taken.select(seq, "error"))
    return conform(rows, "users", now), rejected


ACCOUNT_UPDATES = ["first_name", "last_name", "phone", "role"]


def add_members(
    members: DataFrame, users: DataFrame, new: DataFrame, password_hash: str, now: str
) -> tuple[DataFrame, DataFrame]:
    """Normalized new team members: (all members, all accounts).

    Every new member gets an account; one with the same email is updated but keeps its
    password.  Emails are unique within ``new`` and not yet among the members.
    """
    added = assign_ids(new.withColumn("id", F.lit(None)), highest_id(members), ["email"])
    linked = new.select(
        "email",
        "first_name",
        "last_name",
        "phone",
        user_role(F.col("role")).alias("role"),
        F.lit(password_hash).alias("password_hash"),
    )
    return (
        members.unionByName(conform(added, "team_members", now), allowMissingColumns=True),
        upsert(users, linked, "email", ACCOUNT_UPDATES, now),
    )


def patch_profiles(
    users: DataFrame, requests: DataFrame, now: str, seq: str | None = None
) -> DataFrame:
    """Apply validated profile patches, each addressed by id or else by email.

    ``requests`` has ``id, email`` and the normalized profile fields.  Several of one person,
    named by id or by email, take effect in the order of ``seq``.
    """
    named = resolve_user_strict(requests, users).where(F.col("user_id").isNotNull())
    patch = named.drop("id").withColumnRenamed("user_id", "id")
    return update_sparse(
        users,
        patch,
        ["first_name", "last_name", "phone"],
        {"profile_photo": "profile_photo_provided"},
        now,
        seq=seq,
    )


MAIL_TAKEN = "unique email"


def settle_moves(moves: DataFrame, mails: DataFrame) -> DataFrame:
    """Which accounts may change their address: the moves (``_old, _new, _seq``) with ``_stays``.

    An address is free when no account has it or the account that has it moves away.  Of several
    moves to one address the first counts.  A refused move keeps its address, which may refuse
    another; so the rule is applied again to those that remain, until all of them hold.  Each round
    refuses at least one move, reads the moves alone and looks addresses up in one aggregate.
    """
    moves = durable(moves)
    # Addresses that somebody moves to and some account holds.
    held = mails.select(F.col("email").alias("_held")).join(
        moves.select(F.col("_new").alias("_held")).distinct(), "_held", "left_semi"
    )
    held, refused = durable(held), None
    while True:
        open_moves = moves if refused is None else moves.join(refused, "_old", "left_anti")
        left = open_moves.select(F.col("_old").alias("_mail"), F.lit(True).alias("_leaves"))
        there = held.select(F.col("_held").alias("_mail"), F.lit(True).alias("_holds"))
        wanted = open_moves.select(F.col("_new").alias("_mail"), F.col("_seq").alias("_first"))
        met = (
            wanted.unionByName(left, allowMissingColumns=True)
            .unionByName(there, allowMissingColumns=True)
            .groupBy("_mail")
            .agg(F.min("_first").alias("_first"), F.max("_leaves").alias("_leaves"), F.max("_holds").alias("_holds"))
        )
        free = met.where(F.col("_holds").isNull() | F.col("_leaves").isNotNull())
        winners = free.select(F.col("_mail").alias("_new"), F.col("_first").alias("_seq"))
        lost = durable(open_moves.join(winners, ["_new", "_seq"], "left_anti").select("_old"))
        if lost.isEmpty():
            break
        refused = lost if refused is None else durable(refused.unionByName(lost))
    stays = F.lit(False) if refused is None else F.col("_refused").isNotNull()
    if refused is not None:
        moves = moves.join(refused.withColumn("_refused", F.lit(True)), "_old", "left")
    return moves.select("_old", "_new", "_seq", stays.alias("_stays"))


def sync_users(
    users: DataFrame,
    members_old: DataFrame,
    members_new: DataFrame,
    password_hash: str,
    now: str,
    seq: str = "id",
) -> tuple[DataFrame, DataFrame]:
    """Carry changed team members over to the accounts: (all accounts, refused changes).

    The account with the member's old email is updated, new email included; where there is
    none, the account is inserted or updated by the new email.  ``members_new`` has
    ``id, first_name, last_name, email, phone, role``; rows of unknown members are ignored, and of
    several rows of one member the last by ``seq`` counts.  All changes apply to the same starting
    state, so addresses may be exchanged.  An account never takes an address that another one keeps
    or takes first by ``seq``: such a change is refused whole (``id, email, rule``).

    One full outer join of accounts and changes is written and serves everything after it.
    """
    fields = ["first_name", "last_name", "email", "phone", "role"]
    old = members_old.select("id", F.col("email").alias("_old"))
    accounts = members_new.withColumn("role", user_role(F.col("role")))
    last = one_per_key(accounts, "id", seq if seq != "id" else None, [*fields, *([seq] if seq != "id" else [])])
    changed = last.join(old, "id").select(
        "_old", F.col("id").alias("_member"), F.col(seq).alias("_seq"), *[F.col(c).alias(f"_new_{c}") for c in fields]
    )
    here = users.withColumn("_here", F.lit(True))
    merged = durable(here.join(changed, F.col("email") == F.col("_old"), "full_outer"))
    stored = merged.where(F.col("_here").isNotNull())

    hit = F.col("_here").isNotNull() & F.col("_old").isNotNull()
    moving = merged.where(hit & (F.col("_new_email") != F.col("_old")))
    settled = settle_moves(moving.select("_old", F.col("_new_email").alias("_new"), "_seq"), stored.select("email"))
    denied = settled.where("_stays").select(F.col("_old").alias("_denied"))
    both = stored.join(denied, F.col("_old") == F.col("_denied"), "left")
    allowed = F.col("_old").isNotNull() & F.col("_denied").isNull()
    new = {c: F.col(f"_new_{c}") for c in fields}
    updated = both.select(*stamped(users, allowed, now, new))
    refused = moving.join(denied, F.col("_old") == F.col("_denied")).select(
        F.col("_member").alias("id"), F.col("_new_email").alias("email"), F.lit(MAIL_TAKEN).alias("rule")
    )

    rest = merged.where(F.col("_here").isNull()).select("_seq", *[F.col(f"_new_{c}").alias(c) for c in fields])
    rest = rest.withColumn("password_hash", F.lit(password_hash))
    return upsert(updated, rest, "email", ACCOUNT_UPDATES, now, seq="_seq"), refused
