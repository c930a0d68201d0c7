"""Bulk changes: current table and a batch in, new table out.

Nothing is overwritten in place; write the result to a new path.  Where a batch names a key
more than once, its rows take effect in the order of the sequence column ``seq``; without one
the row that is greatest by its values counts.  Either way a key gives one row.  Where a batch may
name parents that do not exist or keys that are taken, ``marquee.operators.intake`` says which rows
are admitted and names the rule that refuses the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import empty_to_null, literal_stamp
from marquee.operators.intake import Reference, Unique, admit, admitted
from marquee.operators.joins import missing_in
from marquee.operators.ranking import assign_ids, highest_id
from marquee.operators.skew import join_unique
from marquee.schema import TABLES, children_of
from marquee.session import durable


def one_per_key(
    batch: DataFrame, key: str, seq: str | None, last: Sequence[str], first: Sequence[str] = ()
) -> DataFrame:
    """One row per key: ``last`` columns of its last row, ``first`` columns of its first.

    Without ``seq`` all columns come from the row that is greatest by its values.
    """
    if not seq:
        columns = [*last, *first]
        greatest = batch.groupBy(key).agg(F.max(F.struct(*columns)).alias("_row"))
        return greatest.select(key, *[F.col("_row")[c].alias(c) for c in columns])
    return batch.groupBy(key).agg(
        *[F.max_by(c, seq).alias(c) for c in last], *[F.min_by(c, seq).alias(c) for c in first]
    )


def greatest_per_key(new: DataFrame, unique: Unique) -> DataFrame:
    """One row per key, the greatest by its values; rows whose key is null are kept each."""
    names = [f"_k{i}" for i in range(len(unique.keys))]
    keys = [k.alias(n) for k, n in zip(unique.folded(), names, strict=True)]
    named = new.where(unique.competes()).select(*keys, F.struct(*new.columns).alias("_row"))
    one = named.groupBy(*names).agg(F.max("_row").alias("_row")).select("_row.*")
    return one.unionByName(new.where(~unique.competes()))


def insert_missing(
    current: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    ci: Sequence[str] = (),
    null_safe: Sequence[str] = (),
    order: Sequence[str] | None = None,
    seq: str | None = None,
    references: Sequence[Reference] = (),
) -> DataFrame:
    """Current rows plus those new ones whose key is not there, one of each key.

    With ``seq`` that is the first one whose ``references`` are all there; what is not taken, and
    by which rule, is what :func:`check_insert` says.  With ``order`` the added rows get ids above
    the highest present one.
    """
    unique = Unique(tuple(keys), current, tuple(ci), tuple(null_safe))
    if seq:
        added = admitted(admit(new, seq, references, unique))
        added = added if seq in current.columns else added.drop(seq)
    else:
        added = missing_in(greatest_per_key(new, unique), current, keys, ci, null_safe)
    if order:
        ready = added.withColumn("id", F.lit(None).cast("bigint"))
        added = assign_ids(ready, highest_id(current), order, costly=True)
    return current.unionByName(added, allowMissingColumns=True)


def check_insert(
    current: DataFrame,
    batch: DataFrame,
    table: str,
    seq: str,
    parents: dict[str, DataFrame],
) -> DataFrame:
    """The batch with ``refused``, by the declared unique key and references of a table.

    References to tables that are not among ``parents`` are not checked.
    """
    spec = TABLES[table]
    references = [Reference(fk, parents[p], p) for fk, (p, _) in spec.references.items() if p in parents]
    unique = Unique(spec.unique[0], current) if spec.unique else None
    return admit(batch, seq, references, unique)


def stamped(current: DataFrame, hit: Column, now: str, values: dict[str, Column]) -> list[Column]:
    """Select list replacing columns where ``hit`` holds; ``updated_at``, if any, becomes now."""
    if "updated_at" in current.columns:
        values = {**values, "updated_at": literal_stamp(now)}
    return [
        F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
        for c in current.columns
    ]


def beside(current: DataFrame, batch: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Current rows with the batch row of the same key beside them, columns as ``_new_*``."""
    incoming = batch.select(
        F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in columns]
    )
    return current.join(incoming, F.col(key) == F.col("_key"), "left")


def update_full(
    current: DataFrame,
    changes: DataFrame,
    columns: Sequence[str],
    now: str,
    key: str = "id",
    seq: str | None = None,
) -> DataFrame:
    """Replace all given columns of the rows named by the changes, omitted values by null."""
    joined = beside(current, one_per_key(changes, key, seq, columns), key, columns)
    new = {c: F.col(f"_new_{c}") for c in columns}
    return joined.select(*stamped(current, F.col("_key").isNotNull(), now, new))


def not_found(current: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Changes that name no row."""
    return changes.join(current.select(key), key, "left_anti")


def update_sparse(
    current: DataFrame,
    patch: DataFrame,
    columns: Sequence[str],
    flagged: dict[str, str],
    now: str,
    key: str = "id",
    seq: str | None = None,
) -> DataFrame:
    """Patch rows: null keeps the old value, except where a column's flag says it was given.

    ``flagged`` maps a column to its boolean "provided" column; it may be set to null or ''.
    """
    if seq:
        # A null order is passed over, so each column takes its last value that was given.
        given = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in columns]
        for c, flag in flagged.items():
            given.append(F.max_by(c, F.when(F.col(flag), F.col(seq))).alias(c))
            given.append(F.bool_or(flag).alias(flag))
        patch = patch.groupBy(key).agg(*given)
    else:
        patch = one_per_key(patch, key, None, [*columns, *flagged, *flagged.values()])
    joined = beside(current, patch, key, [*columns, *flagged, *flagged.values()])
    new = {c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in columns}
    for c, flag in flagged.items():
        new[c] = F.when(F.col(f"_new_{flag}"), F.col(f"_new_{c}")).otherwise(F.col(c))
    return joined.select(*stamped(current, F.col("_key").isNotNull(), now, new))


def status_time(status: Column, reached: str, now: str) -> Column:
    """Now where the status has been reached, else null."""
    return F.when(status == reached, literal_stamp(now))


def with_completed_at(tasks: DataFrame, now: str) -> DataFrame:
    return tasks.withColumn("completed_at", status_time(F.col("status"), "COMPLETED", now))


def with_paid_at(payments: DataFrame, now: str) -> DataFrame:
    return payments.withColumn("paid_at", status_time(F.col("status"), "PAID", now))


def upsert(
    current: DataFrame,
    new: DataFrame,
    key: str,
    update_columns: Sequence[str],
    now: str,
    seq: str | None = None,
) -> DataFrame:
    """Update the rows whose key is there, insert the others with new ids, in the order of the key.

    ``update_columns`` are overwritten on a match; the other columns of ``new`` are used for
    inserted rows only.  One full outer join brings both sides together; it is written once, so
    the current table is read once for matches, new rows and the highest id.
    """
    others = [c for c in new.columns if c not in (key, seq, *update_columns)]
    fields = [*update_columns, *others]
    incoming = one_per_key(new, key, seq, update_columns, others).select(
        F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in fields], F.lit(True).alias("_named")
    )
    here = current.withColumn("_here", F.lit(True))
    merged = durable(here.join(incoming, F.col(key) == F.col("_key"), "full_outer"))
    stored = merged.where(F.col("_here").isNotNull())
    values = {c: F.col(f"_new_{c}") for c in update_columns}
    updated = stored.select(*stamped(current, F.col("_named").isNotNull(), now, values))

    added = {key: F.col("_key"), **{c: F.col(f"_new_{c}") for c in fields}}
    for stamp in ("created_at", "updated_at"):
        if stamp in current.columns and stamp not in added:
            added[stamp] = literal_stamp(now)
    fresh = merged.where(F.col("_here").isNull()).select(
        F.lit(None).cast("bigint").alias("id"), *[value.alias(c) for c, value in added.items() if c != "id"]
    )
    inserted = assign_ids(fresh, highest_id(stored), [key])
    return updated.unionByName(inserted, allowMissingColumns=True)


def delete_keys(
    current: DataFrame, doomed: DataFrame, keys: Sequence[str] = ("id",)
) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, number of rows hit).  Use (id, owner) keys for owned rows."""
    wanted = doomed.select(*keys).distinct()
    hit = current.join(wanted, list(keys), "left_semi")
    return (
        current.join(wanted, list(keys), "left_anti").select(*current.columns),
        hit.agg(F.count("*").alias("deleted")),
    )


def cascade_delete(tables: dict[str, DataFrame], table: str, ids: DataFrame) -> dict[str, DataFrame]:
    """Delete rows of one table and everything that refers to them, through all levels.

    References declared as "null" are cleared instead.  Tables not passed in are skipped.
    The ids deleted at each level are written once, so no level is worked out again below.
    """
    out = dict(tables)
    pending = [(table, "id", durable(ids.select(F.col("id").alias("_dead")).distinct()))]
    while pending:
        name, column, dead = pending.pop(0)
        match = F.col(column) == F.col("_dead")
        before = out[name]
        out[name] = before.join(dead, match, "left_anti")
        below = [c for c in children_of(name) if c[0] in out]
        if not below:
            continue
        gone = durable(before.join(dead, match, "left_semi").select(F.col("id").alias("_dead")))
        for child, fk, action in below:
            if action == "cascade":
                pending.append((child, fk, gone))
            else:
                cleared = out[child].join(gone, F.col(fk) == F.col("_dead"), "left")
                kept = F.when(F.col("_dead").isNull(), F.col(fk))
                out[child] = cleared.withColumn(fk, kept).drop("_dead")
    return out


def ingest_payments(
    current: DataFrame, batch: DataFrame, seq: str, now: str, bookings: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Add payments whose transaction_ref is new; (rows added, outcome per batch row).

    A ref seen before, in the table or on a row taken earlier in the batch, adds nothing and
    answers with the id of that payment (``existed``).  Rows without a ref ('' counts as none) are
    added each.  With ``bookings`` a row whose booking is not there is refused, unless its ref is
    known by then; ``refused`` names the rule.  Current and new refs meet in one aggregate, and the
    decided batch is written once.
    """
    ready = with_paid_at(batch.withColumn("transaction_ref", empty_to_null("transaction_ref")), now)
    ready = ready.withColumn("created_at", literal_stamp(now))
    reference = [Reference("booking_id", bookings, "bookings")] if bookings is not None else []
    checked = admit(ready, seq, reference)

    has_ref = F.col("transaction_ref").isNotNull()
    kind = batch.schema[seq].dataType
    offered = checked.where(has_ref & F.col("refused").isNull()).select(
        F.col("transaction_ref").alias("_ref"), F.col(seq).alias("_first"), F.lit(None).cast("bigint").alias("_known")
    )
    held = current.where(has_ref).select(
        F.col("transaction_ref").alias("_ref"), F.lit(None).cast(kind).alias("_first"), F.col("id").alias("_known")
    )
    refs = held.unionByName(offered).groupBy("_ref").agg(F.min("_first").alias("_first"), F.min("_known").alias("_known"))
    joined = join_unique(checked, refs, "transaction_ref", "_ref")
    known, earlier = F.col("_known").isNotNull(), F.coalesce(F.col("_first") < F.col(seq), F.lit(False))
    state = (
        F.when(known | earlier, F.lit("existed"))
        .when(F.col("refused").isNotNull(), F.lit("refused"))
        .otherwise(F.lit("added"))
    )
    decided = durable(joined.withColumn("_state", state))

    fresh = decided.where(F.col("_state") == "added").select(F.lit(None).cast("bigint").alias("id"), *ready.columns)
    added = assign_ids(fresh, highest_id(current), [seq])
    firsts = added.select(F.col(seq).alias("_seq"), F.col("id").alias("_id"))
    # The row whose payment answers: itself, or the first of its ref; known ones need no lookup.
    answer = F.when(~known & (F.col("_state") != "refused"), F.when(has_ref, F.col("_first")).otherwise(F.col(seq)))
    looked = decided.select(seq, "_known", "_state", "refused", answer.alias("_answer"))
    outcome = looked.join(firsts, F.col("_answer") == F.col("_seq"), "left").select(
        seq,
        F.coalesce("_known", "_id").alias("id"),
        (F.col("_state") == "existed").alias("existed"),
        F.when(F.col("_state") == "refused", F.col("refused")).alias("refused"),
    )
    rows = added.select(*[c for c in current.columns if c in added.columns])
    return rows, outcome
