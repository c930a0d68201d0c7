"""Data-quality checks over whole tables.  As in SQL, a null passes every check but NOT NULL."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.schema import TABLES

EMAIL_TAKEN = "An account with this email already exists."


def enum_violations(df: DataFrame, column: str, allowed: Iterable[str]) -> DataFrame:
    return df.where(~F.col(column).isin(list(allowed)))


def _named_failures(df: DataFrame, failures: dict[str, Column], name: str) -> DataFrame:
    """Rows with at least one failure, its names joined by commas."""
    tags = [F.when(condition, F.lit(tag)) for tag, condition in failures.items()]
    return df.withColumn(name, F.concat_ws(",", *tags)).where(F.col(name) != "")


def range_violations(df: DataFrame, checks: Sequence[str]) -> DataFrame:
    """Rows that break a check such as ``price >= 0``; ``broken`` names which."""
    return _named_failures(df, {c: ~F.expr(c) for c in checks}, "broken")


def null_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with null in a required column; ``missing`` names which."""
    return _named_failures(df, {c: F.col(c).isNull() for c in columns}, "missing")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; a key with a null part never collides."""
    return (
        df.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(F.count("*").alias("occurrences"))
        .where(F.col("occurrences") > 1)
    )


def orphans(child: DataFrame, parent: DataFrame, fk: str, key: str = "id") -> DataFrame:
    """Child rows whose parent is missing; a null reference is no orphan."""
    parents = parent.select(F.col(key).alias("_parent"))
    return child.where(F.col(fk).isNotNull()).join(
        parents, F.col(fk) == F.col("_parent"), "left_anti"
    )


def reject_existing(new: DataFrame, users: DataFrame, seq: str) -> DataFrame:
    """Add ``error``: set where the email has an account or came earlier in the batch.

    One row of each email can be accepted, its first by ``seq``, which is unique; those rows are
    named by it, so no email brings many rows together.  A row without an email is refused.
    """
    named = new.where(F.col("email").isNotNull())
    first = named.groupBy(F.col("email").alias("_mail")).agg(F.min(seq).alias("_first"))
    taken = users.select(F.col("email").alias("_mail"))
    accepted = first.join(taken, "_mail", "left_anti").select("_first")
    refused = F.col("_first").isNull()
    return new.join(accepted, F.col(seq) == F.col("_first"), "left").select(
        *new.columns, F.when(refused, F.lit(EMAIL_TAKEN)).alias("error")
    )


#: References of one parent that are counted side by side.
_SLOTS = max(Counter(parent for t in TABLES.values() for parent, _ in t.references.values()).values())


def row_rules(name: str, columns: Sequence[str]) -> dict[str, str]:
    """SQL for a row of a table breaking a declared rule on single rows, by the rule's name."""
    spec = TABLES[name]
    rules = {f"{c} is required": f"`{c}` IS NULL" for c in spec.required if c in columns}
    for c, allowed in spec.enums.items():
        if c in columns:
            values = ", ".join(f"'{v}'" for v in allowed)
            rules[f"{c} in list"] = f"`{c}` NOT IN ({values})"
    for check in spec.checks:
        if all(w not in spec.columns or w in columns for w in check.split()):
            rules[check] = f"NOT ({check})"
    return rules


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """Number of violations of every declared rule of the tables given: one row per rule.

    Every table is read once.  A row gives an entry for each rule on single rows that it breaks, one
    for its unique key (128 bits of hash), one for each reference, and one for its own id where
    others refer to it.  All entries of all tables meet by key in one aggregate, reduced before the
    shuffle: a key with more than one row breaks a unique rule, references without a row of the
    parent are orphans.  For a unique rule the keys are counted that occur more than once.
    """
    named: list[tuple[str, int, str, str]] = []  # space, place in it, table, rule
    held: dict[str, int] = {}
    entries = []
    parents = {parent for name in tables for parent, _ in TABLES[name].references.values()}

    def entry(when: str, space: str, one: str, two: str = "0L", slot: int = 0, present: str = "FALSE") -> str:
        fields = f"'space', '{space}', 'one', {one}, 'two', {two}, 'slot', {slot}, 'present', {present}"
        return f"IF({when}, named_struct({fields}), NULL)"

    for name, df in tables.items():
        spec, made = TABLES[name], []
        for i, (rule, broken) in enumerate(row_rules(name, df.columns).items()):
            named.append((f"row {name}", i, name, rule))
            made.append(entry(broken, f"row {name}", f"{i}L"))
        for i, keys in enumerate(spec.unique):
            if all(k in df.columns for k in keys):
                space = f"unique {name} {i}"
                named.append((space, 0, name, f"unique {', '.join(keys)}"))
                whole = " AND ".join(f"`{k}` IS NOT NULL" for k in keys)
                listed, turned = ", ".join(keys), ", ".join(reversed(keys))
                made.append(entry(whole, space, f"xxhash64({listed})", f"xxhash64('{name}', {turned})"))
        for fk, (parent, _) in spec.references.items():
            if fk in df.columns and parent in tables and "id" in tables[parent].columns:
                slot = held[parent] = held.get(parent, -1) + 1
                named.append((f"id {parent}", slot, name, f"{fk} in {parent}"))
                made.append(entry(f"`{fk}` IS NOT NULL", f"id {parent}", f"CAST(`{fk}` AS BIGINT)", slot=slot))
        if name in parents and "id" in df.columns:
            made.append(entry("id IS NOT NULL", f"id {name}", "CAST(id AS BIGINT)", present="TRUE"))
        entries.append(df.selectExpr(f"inline(filter(array({', '.join(made)}), e -> e IS NOT NULL))"))

    counts = [F.count(F.when(~F.col("present") & (F.col("slot") == s), 1)).alias(f"_{s}") for s in range(_SLOTS)]
    met = reduce(DataFrame.unionByName, entries).groupBy("space", "one", "two").agg(F.bool_or("present").alias("known"), *counts)
    is_row, is_unique = F.col("space").startswith("row "), F.col("space").startswith("unique ")
    found = F.when(is_row, F.array(F.struct(F.col("one").cast("int").alias("at"), F.col("_0").alias("n"))))
    found = found.when(is_unique, F.array(F.struct(F.lit(0).alias("at"), (F.col("_0") > 1).cast("bigint").alias("n"))))
    orphaned = F.array(*[F.struct(F.lit(s).alias("at"), F.col(f"_{s}").alias("n")) for s in range(_SLOTS)])
    found = found.when(~F.col("known"), orphaned)
    summed = met.select("space", F.inline(found)).groupBy("space", "at").agg(F.sum("n").alias("n"))

    # One row per declared rule: a fixed list, as long as the schema.
    listed = ", ".join(f"struct('{space}', {at}, '{table}', '{rule}')" for space, at, table, rule in named)
    rules = entries[0].sparkSession.range(1).selectExpr(f"inline(array({listed})) AS (_space, _at, `table`, rule)")
    same = (F.col("space") == F.col("_space")) & (F.col("at") == F.col("_at"))
    violations = F.coalesce("n", F.lit(0).cast("bigint")).alias("violations")
    return rules.join(summed, same, "left").select("table", "rule", violations)
