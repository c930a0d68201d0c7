"""Positions, running sums and generated ids over a whole data set, without a single-task sort.

An order is a list of column names, '-' first for descending; nulls come last either way.  It must
be unique: end it with a key.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate, groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions import add_seconds
from marquee.session import durable

#: Rows a range is meant to hold, the most ranges, and keys looked at to place each bound.
RANGE_ROWS, MOST_RANGES, SAMPLED = 50_000, 4096, 12


def parts(order: Sequence[str]) -> list[tuple[str, bool]]:
    """(column, descending) of each part of an order."""
    return [(o.lstrip("-"), o.startswith("-")) for o in order]


def sort_columns(order: Sequence[str]) -> list[Column]:
    return [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in parts(order)]


Key = tuple[str | None, ...]


@dataclass(frozen=True)
class Ranges:
    """Fixed cuts through an order; range i holds the rows from cut i - 1 on and before cut i.

    A cut is the beginning of a key as literals, and lies before all rows that start so.  It is one
    value of the first column unless many rows share that value, and so on; finding the range of a
    row is mostly a few comparisons of one column, and hot values are divided by the columns after.
    """

    order: tuple[str, ...]
    kinds: tuple[str, ...]
    cuts: tuple[Key, ...]

    def _literal(self, depth: int, value: str) -> str:
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"CAST('{escaped}' AS {self.kinds[depth]})"

    def _sides(self, depth: int, value: str | None) -> tuple[str, str, str]:
        """SQL for a row's column being before, equal to and after a value; nulls come last."""
        name, down = parts(self.order)[depth]
        if value is None:
            return f"`{name}` IS NOT NULL", f"`{name}` IS NULL", "FALSE"
        v = self._literal(depth, value)
        less, more = ("<", ">") if not down else (">", "<")
        return f"`{name}` {less} {v}", f"`{name}` = {v}", f"(`{name}` {more} {v} OR `{name}` IS NULL)"

    def _search(self, cuts: Sequence[Key], depth: int, base: int) -> str:
        """SQL for ``base`` and the number of cuts that a row is not before: a binary search as cases."""
        groups = [(value, list(group)) for value, group in groupby(cuts, key=lambda c: c[depth])]
        starts = list(accumulate((len(group) for _, group in groups), initial=base))

        def leaf(i: int) -> str:
            if i < 0:
                return str(base)
            value, group = groups[i]
            inside = [cut for cut in group if len(cut) > depth + 1]
            if not inside:
                return str(starts[i + 1])
            inner = self._search(inside, depth + 1, starts[i + 1] - len(inside))
            return f"CASE WHEN {self._sides(depth, value)[1]} THEN {inner} ELSE {starts[i + 1]} END"

        def cases(low: int, high: int) -> str:
            if low == high:
                return leaf(low - 1)
            mid = (low + high) // 2
            before = self._sides(depth, groups[mid][0])[0]
            return f"CASE WHEN {before} THEN {cases(low, mid)} ELSE {cases(mid + 1, high)} END"

        return cases(0, len(groups))

    def column(self) -> Column:
        """The number of a row's range, from 0."""
        return F.expr(self._search(self.cuts, 0, 0)) if self.cuts else F.lit(0)

    def from_cut(self, i: int) -> Column:
        """Whether a row is at cut ``i`` or after it; plain comparisons, which reach the scan."""
        text = "TRUE"
        for depth, value in reversed(list(enumerate(self.cuts[i]))):
            _, same, after = self._sides(depth, value)
            text = f"({after} OR {same})" if text == "TRUE" else f"({after} OR ({same} AND {text}))"
        return F.expr(text)

    def before_cut(self, i: int) -> Column:
        text = "FALSE"
        for depth, value in reversed(list(enumerate(self.cuts[i]))):
            before, same, _ = self._sides(depth, value)
            text = before if text == "FALSE" else f"({before} OR ({same} AND {text}))"
        return F.expr(text)


def split_ranges(keys: DataFrame, order: Sequence[str], rows: int, wanted: int) -> Ranges:
    """About ``wanted`` ranges of equal size over ``rows`` keys.

    The cuts are taken from keys chosen by their hash, so the same keys give the same cuts however
    they are partitioned; some ``SAMPLED`` keys per range come to the driver, as text.
    """
    names = [c for c, _ in parts(order)]
    kinds = tuple(keys.select(*names).schema[c].dataType.simpleString() for c in names)
    if wanted < 2:
        return Ranges(tuple(order), kinds, ())
    one_of = max(1, rows // (wanted * SAMPLED))
    chosen = keys.select(*names).where(F.pmod(F.xxhash64(*names), F.lit(one_of)) == 0)
    inorder = chosen.repartition(1).sortWithinPartitions(*sort_columns(order))
    found = [tuple(r) for r in inorder.select(*[F.col(c).cast("string") for c in names]).collect()]
    wanted = min(wanted, len(found))
    shared = Counter(key[:n] for key in found for n in range(1, len(names)))

    def cut(key: Key) -> Key:
        """The shortest beginning that less than half a range shares."""
        return next((key[:n] for n in range(1, len(names)) if 2 * wanted * shared[key[:n]] < len(found)), key)

    cuts = dict.fromkeys(cut(found[i * len(found) // wanted]) for i in range(1, wanted))
    return Ranges(tuple(order), kinds, tuple(cuts))


def running_totals(
    df: DataFrame, order: Sequence[str], measures: dict[str, Column], costly: bool = False
) -> DataFrame:
    """Every row with the sums of ``measures`` (whole numbers) over all rows before it.

    Two passes: the first reads the order columns and the measures alone, fixes the bounds of
    ranges and adds up each range; the second deals the rows by range, sums within each, and adds
    what lies before it.  Both use the same literal cuts, so a task that runs again, or another
    partitioning of the input, gives the same numbers, and no row is written.  ``costly`` inputs
    have those columns written once, instead of being worked out for the count, the bounds and the
    totals.  Ranges hold some ``RANGE_ROWS`` rows, more where ``MOST_RANGES`` of them do not suffice.
    """
    names = [c for c, _ in parts(order)]
    keys = df.select(*names, *[m.cast("bigint").alias(f"_{n}") for n, m in measures.items()])
    if costly:
        keys = durable(keys)
    rows = keys.count()
    ranges = split_ranges(keys, order, rows, min(MOST_RANGES, -(-rows // RANGE_ROWS)))
    sums = [F.coalesce(F.sum(f"_{n}"), F.lit(0)).alias(n) for n in measures]
    totals = {r["_range"]: r for r in keys.groupBy(ranges.column().alias("_range")).agg(*sums).collect()}
    within = Window.partitionBy("_range").orderBy(*sort_columns(order))
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    out = []
    for name, measure in measures.items():
        each = [totals[i][name] if i in totals else 0 for i in range(len(ranges.cuts) + 1)]
        starts = F.lit(list(accumulate(each, initial=0))).cast("array<bigint>")
        inside = F.coalesce(F.sum(measure.cast("bigint")).over(before), F.lit(0))
        out.append((F.element_at(starts, F.col("_range") + 1) + inside).alias(name))
    return df.withColumn("_range", ranges.column()).select(*df.columns, *out)


def number_rows(df: DataFrame, order: Sequence[str], name: str = "rn", costly: bool = False) -> DataFrame:
    """1-based position of every row in an order; see :func:`running_totals`."""
    placed = running_totals(df, order, {"_before": F.lit(1)}, costly)
    return placed.select(*df.columns, (F.col("_before") + 1).alias(name))


def highest_id(df: DataFrame, column: str = "id") -> Column:
    """Largest id present, 0 for an empty table, as a scalar subquery."""
    return F.coalesce(df.agg(F.max(column)).scalar(), F.lit(0).cast("bigint"))


def assign_ids(
    df: DataFrame, start: Column | int, order: Sequence[str], name: str = "id", costly: bool = False
) -> DataFrame:
    """New ids ``start + 1, start + 2, ...`` in the given (unique) order."""
    base = F.lit(start) if isinstance(start, int) else start
    numbered = number_rows(df.drop(name), order, "_rn", costly)
    return numbered.select((base + F.col("_rn")).alias(name), *[c for c in df.columns if c != name])


def stagger(
    df: DataFrame, order: Sequence[str], start: Column, step_seconds: int, name: str
) -> DataFrame:
    """Consecutive time slots: the first row gets ``start``, each next one a step later."""
    numbered = number_rows(df, order, "_rn")
    offset = (F.col("_rn") - 1) * F.lit(step_seconds)
    return numbered.withColumn(name, add_seconds(start, offset)).drop("_rn")
