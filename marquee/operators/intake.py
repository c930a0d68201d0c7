"""Rules on write: which rows of a batch a table takes, first come first served."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reference:
    """``column`` names a row of ``parent``, whose ``key`` is unique; a null names none."""

    column: str
    parent: DataFrame
    table: str
    key: str = "id"

    @property
    def rule(self) -> str:
        return f"{self.column} in {self.table}"


@dataclass(frozen=True)
class Unique:
    """No two rows share ``keys``, those of ``taken`` included; a null part never collides.

    ``ci`` keys compare without letter case, ``null_safe`` ones treat null as a value.  Only rows
    that fulfil ``among`` compete (None: all).
    """

    keys: tuple[str, ...]
    taken: DataFrame | None = None
    ci: tuple[str, ...] = ()
    null_safe: tuple[str, ...] = ()
    among: Column | None = None

    @property
    def rule(self) -> str:
        return f"unique {', '.join(self.keys)}"

    def folded(self) -> list[Column]:
        return [F.lower(k) if k in self.ci else F.col(k) for k in self.keys]

    def competes(self) -> Column:
        named = F.lit(True) if self.among is None else F.coalesce(self.among, F.lit(False))
        for k in self.keys:
            named = named if k in self.null_safe else named & F.col(k).isNotNull()
        return named


def admit(
    batch: DataFrame,
    seq: str,
    references: Sequence[Reference] = (),
    unique: Unique | None = None,
    rules: dict[str, Column] | None = None,
) -> DataFrame:
    """The batch with ``refused``: the name of the first rule a row breaks, null where it breaks none.

    ``rules`` name conditions that a row itself must not fulfil; they come first, references next, the
    unique key last.  A row that breaks an earlier rule takes no key.  Of the rows that compete for a
    key that is not taken the first by ``seq``, which is unique in the batch, is admitted.

    Keys in the table and keys of the batch meet in one aggregate, reduced before they are
    shuffled, so a key that fills a large part of the batch is one row per task.
    """
    refused: list[Column] = [F.when(broken, F.lit(name)) for name, broken in (rules or {}).items()]
    checked = batch
    for i, reference in enumerate(references):
        known = reference.parent.select(F.col(reference.key).alias(f"_known{i}"))
        checked = checked.join(known, F.col(reference.column) == F.col(f"_known{i}"), "left")
        unknown = F.col(reference.column).isNotNull() & F.col(f"_known{i}").isNull()
        refused.append(F.when(unknown, F.lit(reference.rule)))
    none = F.lit(None).cast("string")
    checked = checked.select(*batch.columns, F.coalesce(*refused, none).alias("refused"))
    if unique is None:
        return checked
    named = [f"_k{i}" for i in range(len(unique.keys))]
    keys = [k.alias(n) for k, n in zip(unique.folded(), named, strict=True)]
    competing = F.col("refused").isNull() & unique.competes()
    offered = checked.where(competing).select(*keys, F.col(seq).alias("_first"), F.lit(False).alias("_taken"))
    if unique.taken is not None:
        held = unique.taken.select(*keys, F.lit(None).cast(batch.schema[seq].dataType).alias("_first"), F.lit(True).alias("_taken"))
        offered = held.unionByName(offered)
    # Grouping treats a null as a value; only null-safe parts of a key are null here, or held ones.
    first = offered.groupBy(*named).agg(F.min("_first").alias("_first"), F.bool_or("_taken").alias("_taken"))
    winners = first.where(~F.col("_taken")).select("_first")
    lost = competing & F.col("_first").isNull()
    return checked.join(winners, F.col(seq) == F.col("_first"), "left").select(
        *batch.columns, F.when(lost, F.lit(unique.rule)).otherwise(F.col("refused")).alias("refused")
    )


def admitted(checked: DataFrame) -> DataFrame:
    """The rows that break no rule."""
    return checked.where(F.col("refused").isNull()).drop("refused")
