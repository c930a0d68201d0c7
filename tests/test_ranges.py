"""Pages and numbers by ranges of the sort key, in small ranges and over other splits of the input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marquee.operators import paging, ranking
from marquee.operators.ranking import assign_ids, number_rows, running_totals, split_ranges


@pytest.fixture
def small(monkeypatch):
    """Ranges and pages of a few hundred rows, so that every step is taken several times."""
    monkeypatch.setattr(ranking, "RANGE_ROWS", 300)
    monkeypatch.setattr(paging, "PAGE_ROWS", 200)
    monkeypatch.setattr(paging, "PAGE_RANGES", 5)


@pytest.fixture(scope="module")
def mixed(spark):
    """Ties, nulls and a hot value in the sort columns; ``id`` is unique."""
    key = F.col("id")
    return spark.range(4000).select(
        key,
        F.when(key % 3 != 0, key * 7919 % 50).alias("k"),
        F.when(key % 5 != 0, F.concat(F.lit("é"), (key * 31 % 97).cast("string"))).alias("s"),
        F.when(key % 4 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (key % 40).cast("int"))).alias("d"),
        (key % 6).alias("m"),
    )


ORDERS = (["-k", "s", "-id"], ["-d", "k", "id"], ["s", "id"])


def sorted_rows(df, order):
    """Rows in an order, nulls last, worked out without Spark."""
    rows = df.collect()
    for name, down in reversed(ranking.parts(order)):
        value = lambda r: r[name].encode() if isinstance(r[name], str) else r[name]  # noqa: E731, B023
        have, none = [r for r in rows if r[name] is not None], [r for r in rows if r[name] is None]
        rows = sorted(have, key=value, reverse=down) + none
    return rows


@pytest.mark.parametrize("order", ORDERS, ids=" ".join)
def test_numbers_and_sums(small, mixed, order):
    want = sorted_rows(mixed, order)
    for split in (mixed, mixed.repartition(11, "m")):
        got = running_totals(split, order, {"before": F.lit(1), "total": F.col("m")}).collect()
        got.sort(key=lambda r: r.before)
        assert [r.before for r in got] == list(range(4000))
        assert [r.id for r in got] == [r.id for r in want]
        total = 0
        for r in got:
            assert r.total == total
            total += r.m


def test_bounds_do_not_depend_on_the_split(small, mixed):
    order = ["-k", "s", "id"]
    one, two = (split_ranges(df, order, 4000, 9) for df in (mixed.repartition(2), mixed.repartition(7, "s")))
    assert one.cuts == two.cuts and len(one.cuts) == 8
    counts = [r["count"] for r in mixed.groupBy(one.column()).count().collect()]
    assert len(counts) == 9 and max(counts) < 3 * 4000 / 9


def test_costly_keys_are_written_alone(small, mixed, monkeypatch):
    kept = []
    real = ranking.durable
    monkeypatch.setattr(ranking, "durable", lambda df: kept.append(df.columns) or real(df))
    numbered = number_rows(mixed, ["s", "id"], "n", costly=True)
    assert kept == [["s", "id", "__before"]]
    assert sorted(r.n for r in numbered.collect()) == list(range(1, 4001))
    assign_ids(mixed.drop("id").limit(5), 7, ["k"])
    assert len(kept) == 1


@pytest.mark.parametrize("order", ORDERS, ids=" ".join)
def test_every_page_is_its_part_of_the_order(small, mixed, order):
    want = [r.id for r in sorted_rows(mixed, order)]
    for page, limit in ((1, 7), (41, 50), (20, 200), (999, 200)):
        begin = (page - 1) * limit
        assert [r.id for r in paging.paginate(mixed, order, page, limit).collect()] == want[begin : begin + limit]


def test_deep_pages(spark):
    """The same steps for every offset; what is ordered in the end does not grow with it."""
    df = spark.range(600_000).select((F.col("id") * 7919 % 600_011).alias("id"), (F.col("id") % 10).alias("k"))
    for offset in (0, 5_000, 500_000):
        near, before = paging.ranked(df, ["k", "-id"], offset, 200)
        assert before <= offset and near.count() <= paging.PAGE_ROWS
        want = df.orderBy("k", F.col("id").desc()).offset(offset).limit(200).collect()
        assert paging.paginate(df, ["k", "-id"], offset // 200 + 1, 200).collect() == want


def test_equal_keys_only(small, spark):
    same = spark.range(500).select(F.lit(1).alias("k"))
    assert paging.paginate(same, ["k"], 3, 100).count() == 100
    assert sorted(r.n for r in number_rows(same, ["k"], "n").collect()) == list(range(1, 501))
    nothing = spark.range(500).select(F.lit(None).cast("string").alias("k"))
    assert paging.paginate(nothing, ["-k"], 5, 100).count() == 100


def test_names_are_joined_to_the_page_alone(spark):
    base = spark.range(3000).select("id", (F.col("id") % 7).alias("parent"))
    parents = spark.range(7).select(F.col("id").alias("parent"), F.concat(F.lit("p"), "id").alias("name"))
    seen = []

    def named(rows):
        seen.append(rows.count())
        return rows.join(parents, "parent")

    page = paging.page_of(base, ["-id"], 3, 20, named=named)
    assert seen == [20]
    assert [(r.id, r.name) for r in page.rows.collect()] == [(i, f"p{i % 7}") for i in range(2959, 2939, -1)]
    assert page.total.first().total == 3000
