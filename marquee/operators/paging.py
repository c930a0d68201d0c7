"""Ordered pages with a total."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.operators.ranking import parts, sort_columns, split_ranges

# Page size when none is asked for, and the largest one.
DEFAULT_LIMIT, MAX_LIMIT = 50, 200
ITEMS_DEFAULT_LIMIT, ITEMS_MAX_LIMIT = 100, 500

#: Rows that are simply ordered to cut a page from them, and ranges that a selection counts at once.
PAGE_ROWS, PAGE_RANGES = 50_000, 256


def leading_int(value) -> int | None:
    """Integer at the start of a parameter, None if there is none."""
    match = re.match(r"\s*([+-]?[0-9]+)", str(value)) if value is not None else None
    return int(match.group(1)) if match else None


def clamp_page(page) -> int:
    number = leading_int(page)
    return number if number and number >= 1 else 1


def clamp_limit(limit, default: int = DEFAULT_LIMIT, cap: int = MAX_LIMIT) -> int:
    number = leading_int(limit)
    return min(number, cap) if number and number >= 1 else default


def ranked(df: DataFrame, order: Sequence[str], skip: int, size: int) -> tuple[DataFrame, int]:
    """(rows among which those at positions skip + 1 to skip + size lie, rows left out before them).

    Selection by rank: the rows are counted in ranges of the sort key and only the ranges that the
    page reaches into are kept, again and again until few rows are left.  Each round reads the sort
    key alone and moves one number per range; its cost does not depend on the offset.
    """
    keys = df.select(*dict.fromkeys(c for c, _ in parts(order)))
    left, before = keys.count(), 0
    if skip >= left:
        return df.limit(0), skip
    while left > PAGE_ROWS:
        ranges = split_ranges(keys, order, left, min(PAGE_RANGES, -(-left * 4 // PAGE_ROWS)))
        counts = {r["_range"]: r["count"] for r in keys.groupBy(ranges.column().alias("_range")).count().collect()}
        ends = list(accumulate(counts.get(i, 0) for i in range(len(ranges.cuts) + 1)))
        first = next(i for i, end in enumerate(ends) if end > skip - before)
        last = next((i for i, end in enumerate(ends) if end >= skip - before + size), len(ends) - 1)
        inside = [ranges.from_cut(first - 1)] if first else []
        if last < len(ranges.cuts):
            inside.append(ranges.before_cut(last))
        for clause in inside:
            df, keys = df.where(clause), keys.where(clause)
        passed = ends[first - 1] if first else 0
        before, remaining = before + passed, ends[last] - passed
        if remaining == left:  # equal keys only
            break
        left = remaining
    return df, before


def paginate(
    df: DataFrame,
    order: Sequence[str],
    page=None,
    limit=None,
    default: int = DEFAULT_LIMIT,
    cap: int = MAX_LIMIT,
) -> DataFrame:
    """One page of an ordering ('-' first for descending, nulls last).

    Give a unique key last, or pages are not reproducible.  All offsets take the same way.
    """
    size = clamp_limit(limit, default, cap)
    skipped = (clamp_page(page) - 1) * size
    near, before = ranked(df, order, skipped, size)
    return near.orderBy(*sort_columns(order)).offset(skipped - before).limit(size)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    total: DataFrame
    page: int
    limit: int

    def with_total(self) -> DataFrame:
        """The rows, each with the total beside it."""
        return self.rows.withColumn("total", self.total.scalar())


def page_of(
    base: DataFrame,
    order: Sequence[str],
    page=None,
    limit=None,
    default: int = DEFAULT_LIMIT,
    cap: int = MAX_LIMIT,
    named: Callable[[DataFrame], DataFrame] | None = None,
) -> Page:
    """Page of ``base`` with the total of its rows.

    ``named`` adds columns of the parents to the rows of the page, after it is chosen.  It must
    keep every row, which references that are declared and checked do, and the order columns.
    """
    rows = paginate(base, order, page, limit, default, cap)
    if named:
        rows = named(rows).orderBy(*sort_columns(order))
    return Page(rows, total(base), clamp_page(page), clamp_limit(limit, default, cap))


def page_to_json(page: Page, order: Sequence[str], name: str = "rows") -> DataFrame:
    """The page as one JSON document; it holds at most ``page.limit`` rows.

    ``order`` are the columns the rows are sorted by in the document, '-' first for descending.
    """
    columns = page.rows.columns
    listed = F.collect_list(F.struct(*columns))

    def compare(left: Column, right: Column) -> Column:
        result = F.lit(0)
        for key, down in reversed(parts(order)):
            low, high = (1, -1) if down else (-1, 1)
            result = (
                F.when(left[key] < right[key], F.lit(low))
                .when(left[key] > right[key], F.lit(high))
                .otherwise(result)
            )
        return result

    return page.rows.agg(
        F.to_json(
            F.struct(
                F.array_sort(listed, compare).alias(name),
                page.total.scalar().alias("total"),
                F.lit(page.page).alias("page"),
                F.lit(page.limit).alias("limit"),
            ),
            {"ignoreNullFields": "false"},
        ).alias("document")
    )
