"""Joins that name what they find: parents, gaps and children.

No side is forced into a broadcast.  Catalyst broadcasts one only when its estimated
size is under ``spark.sql.autoBroadcastJoinThreshold``; otherwise both sides are shuffled
and adaptive execution splits partitions that one hot key has filled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prefixed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Select and rename: ``{"name": "theater_name"}``."""
    return df.select(*[F.col(old).alias(new) for old, new in columns.items()])


def with_parent(
    df: DataFrame, parent: DataFrame, fk: str, columns: dict[str, str], how: str = "inner"
) -> DataFrame:
    """Add parent columns to each child row; ``left`` keeps children without a parent."""
    side = prefixed(parent, {"id": "_parent", **columns})
    return df.join(side, F.col(fk) == F.col("_parent"), how).drop("_parent")


def missing_in(
    a: DataFrame,
    b: DataFrame,
    on: Sequence[str],
    ci: Sequence[str] = (),
    null_safe: Sequence[str] = (),
    computed: dict[str, Column] | None = None,
) -> DataFrame:
    """Rows of ``a`` whose key is not in ``b``.

    ``ci`` keys compare without letter case, ``null_safe`` keys treat null as a value, and
    ``computed`` replaces a key of ``a`` by an expression.  The keys of ``b`` are reduced
    to distinct ones first, so a key that fills a third of ``b`` costs one row.

    They are grouped by a hash as well, so the join shuffles them by key on its own, which lets
    adaptive execution split the partition of a key that fills a large part of ``a``.
    """
    computed = computed or {}

    def folded(name: str, c: Column) -> Column:
        return F.lower(c) if name in ci else c

    keys = [f"_b_{k}" for k in on]
    wanted = b.select(*[folded(k, F.col(k)).alias(f"_b_{k}") for k in on])
    wanted = wanted.withColumn("_hash", F.xxhash64(*keys)).distinct()
    marked = a.withColumns({f"_a_{k}": folded(k, computed.get(k, F.col(k))) for k in on})
    condition = [
        F.col(f"_a_{k}").eqNullSafe(F.col(f"_b_{k}"))
        if k in null_safe
        else F.col(f"_a_{k}") == F.col(f"_b_{k}")
        for k in on
    ]
    return marked.join(wanted, condition, "left_anti").select(*a.columns)


def first_by(df: DataFrame, order: str, column: str) -> Column:
    """One value: ``column`` of the row lowest in ``order``, as a scalar subquery."""
    return df.agg(F.min_by(column, order)).scalar()


def top_values(df: DataFrame, column: str, k: int) -> Column:
    """The k lowest values of a column as an array, as a scalar subquery."""
    return df.orderBy(column).limit(k).agg(F.sort_array(F.collect_list(column))).scalar()


def semi_topk(a: DataFrame, b: DataFrame, key: str, ranked: str, k: int) -> DataFrame:
    """Rows of ``a`` whose key is among the k lowest ``ranked`` values of ``b``."""
    top = b.orderBy(ranked).limit(k).select(F.col(ranked).alias("_top"))
    return a.join(top, F.col(key) == F.col("_top"), "left_semi")


def with_each(df: DataFrame, rows: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """Every row of ``df`` with every one of a few fixed rows: an explode, not a cross join."""
    structs = [F.struct(*[c.alias(n) for c, n in zip(row, names, strict=True)]) for row in rows]
    exploded = df.withColumn("_each", F.explode(F.array(*structs)))
    return exploded.select(*df.columns, *[F.col(f"_each.{n}").alias(n) for n in names])


def child_facts(
    parents: DataFrame, children: DataFrame, fk: str, facts: Sequence[Column]
) -> DataFrame:
    """Each parent with aggregates of its children, null where it has none.

    Aggregates only, so a parent may have any number of children.
    """
    found = children.groupBy(F.col(fk).alias("_fk")).agg(*facts)
    return parents.join(found, F.col("id") == F.col("_fk"), "left").drop("_fk")


def nest_children(
    parents: DataFrame,
    children: DataFrame,
    fk: str,
    order: Sequence[str],
    fields: Sequence[str],
    name: str,
) -> DataFrame:
    """Each parent once, with all its children as one ordered array, empty where it has none.

    The array is for children whose number per parent a rule of the data bounds, as the seats of
    a booking are (a seat once per booking, so at most those of a screen).  Where no rule does,
    use ``child_facts``.  Children are ordered by ``order``, which must be unique in a parent.
    """
    entry = F.struct(*order, *[f for f in fields if f not in order])
    grouped = children.groupBy(F.col(fk).alias("_fk")).agg(
        F.sort_array(F.collect_list(entry)).alias("_children")
    )
    shape = lambda c: F.struct(*[c[f].alias(f) for f in fields])
    joined = parents.join(grouped, F.col("id") == F.col("_fk"), "left")
    none = F.array().cast(f"array<{children.select(*fields).schema.simpleString()}>")
    nested = F.coalesce(F.transform("_children", shape), none)
    return joined.select(*parents.columns, nested.alias(name))
