"""One key with a third of all rows, plans without products, and pushed-down filters."""

from __future__ import annotations

import re
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from marquee.operators import changes, identity, metrics, quality, ranking, skew
from marquee.operators.joins import child_facts, missing_in, nest_children, with_parent
from marquee.operators.ranking import number_rows, split_ranges
from marquee.session import durable, new_folder
from marquee.sources import append, conform, read_table
from suite import registry
from suite.domain import Domain

N = 30_000


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows has key 0, a third a null key, the rest distinct keys."""
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, F.col("id"))
    return spark.range(N).select("id", key.cast("bigint").alias("k"))


def sizes(df, *keys):
    """Rows per shuffle partition once the frame is hash-partitioned by its join key."""
    counts = df.repartition(8, *keys).groupBy(F.spark_partition_id()).count()
    return sorted(r["count"] for r in counts.collect())


def test_hot_keys_join_right_and_spread(spark, rows):
    grouped = spark.range(N).groupBy((F.col("id") - F.col("id") % 2).alias("rk"))
    right = grouped.agg(F.concat(F.lit("v"), F.min("id")).alias("v"))
    joined = skew.join_unique(rows, right, "k", "rk")
    plain = rows.join(right, F.col("k") == F.col("rk"), "left")
    assert joined.columns == ["id", "k", "rk", "v"]
    key = lambda r: r.id
    assert sorted(joined.collect(), key=key) == sorted(plain.collect(), key=key)


def test_hot_key_beside_an_aggregate_is_split(spark, rows):
    names = ("autoBroadcastJoinThreshold", "adaptive.advisoryPartitionSizeInBytes",
             "adaptive.skewJoin.skewedPartitionThresholdInBytes", "adaptive.skewJoin.skewedPartitionFactor")
    kept = {n: spark.conf.get(f"spark.sql.{n}") for n in names}
    for name, value in zip(names, ("-1", "16k", "16k", "1.5"), strict=True):
        spark.conf.set(f"spark.sql.{name}", value)
    try:
        wide = rows.repartition(16).withColumn("pad", F.sha2(F.col("id").cast("string"), 256))
        right = spark.range(N).groupBy(F.col("id").alias("rk")).agg(F.count("*").alias("v"))
        joined = skew.join_unique(wide, right, "k", "rk")
        assert len(joined.collect()) == N
        assert "(skew=true)" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in kept.items():
            spark.conf.set(f"spark.sql.{name}", value)


def test_spread_key_is_even(rows):
    spread = rows.withColumn("s", F.xxhash64("id", "k"))
    assert sizes(rows, "k")[-1] > N / 3
    assert sizes(spread, "s")[-1] < N / 8 * 1.2


def test_hot_email(spark):
    users = spark.range(100).select(
        "id", F.concat(F.lit("U"), F.col("id"), F.lit("@example.com")).alias("email")
    )
    asked = spark.range(3000).select(
        F.col("id").alias("n"),
        F.lit(None).cast("bigint").alias("id"),
        F.when(F.col("id") < 1000, "u7@Example.com")
        .when(F.col("id") < 2000, F.concat(F.lit("u"), F.col("id") % 200, F.lit("@example.com")))
        .alias("email"),
    )
    got = {r.n: r.user_id for r in identity.resolve_user(asked, users).collect()}
    assert len(got) == 3000
    assert {got[n] for n in range(1000)} == {7}
    assert all(got[n] == (n % 200 if n % 200 < 100 else None) for n in range(1000, 2000))
    assert {got[n] for n in range(2000, 3000)} == {None}


def test_hot_parent_is_one_row(spark):
    parents = spark.range(4)
    children = spark.range(27_000).select(
        F.col("id").alias("seat"),
        F.when(F.col("id") < 25_000, 1).otherwise(F.col("id") % 2 + 2).cast("bigint").alias("booking_id"),
    )
    nested = nest_children(parents, children, "booking_id", ["seat"], ["seat"], "seats").collect()
    got = {r.id: [s.seat for s in r.seats] for r in nested}
    assert len(nested) == 4
    assert got[0] == [] and got[1] == list(range(25_000))
    facts = [F.count("seat").alias("n"), F.min("seat").alias("low"), F.sum("seat").alias("total")]
    for r in child_facts(parents, children, "booking_id", facts).collect():
        seats = got[r.id]
        assert (r.n, r.low, r.total) == ((len(seats), seats[0], sum(seats)) if seats else (None,) * 3)


def test_row_numbers_split_a_hot_key(rows, monkeypatch):
    monkeypatch.setattr(ranking, "RANGE_ROWS", N // 8)
    ranges = split_ranges(rows, ["k", "id"], N, 8)
    held = [r["count"] for r in rows.groupBy(ranges.column()).count().collect()]
    assert len(held) == 8 and max(held) < N / 8 * 2
    numbered = number_rows(rows, ["k", "id"], "n").orderBy("n").collect()
    assert [r.n for r in numbered] == list(range(1, N + 1))
    keys = [(r.k is None, r.k or 0, r.id) for r in numbered]
    assert keys == sorted(keys)


def test_hot_payment_ref(spark):
    known = spark.createDataFrame([], "id bigint, transaction_ref string")
    batch = spark.range(3000).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, "same")
        .when(F.col("id") % 3 == 1, F.concat(F.lit("r"), F.col("id")))
        .alias("transaction_ref"),
        F.lit("PAID").alias("status"),
    )
    added, outcome = changes.ingest_payments(known, batch, "seq", "2026-01-01 00:00:00")
    assert added.count() == 2001
    assert outcome.where("existed").count() == 999
    assert outcome.count() == 3000


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_query_multiplies_rows_or_runs_python(spark, monkeypatch):
    """No nested-loop join, no product, no Python in any plan, even with nothing broadcast.

    The plans before each intermediate table are looked at too.
    """
    plans = {}
    for module in [m for name, m in sys.modules.items() if name.startswith("marquee.") and hasattr(m, "durable")]:
        if not module.__name__.startswith("marquee.llm"):

            def looked_at(df):
                plans.setdefault(key, []).append(plan_of(df))
                return durable(df)

            monkeypatch.setattr(module, "durable", looked_at)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for key, build in registry.QUERIES.items():
            if re.match(r"op\d+_|pipeline$", key):
                continue
            plans.setdefault(key, []).append(plan_of(build(spark, "/root/testdata/sf0.001")))
            for plan in plans[key]:
                for bad in ("NestedLoop", "CartesianProduct", "Python", "Pandas", "Arrow"):
                    assert bad not in plan, f"{key}: {bad}"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) >= 110 and sum(map(len, plans.values())) > len(plans)


def test_filters_and_columns_reach_the_scan(spark):
    d = Domain(spark, "/root/testdata/sf0.001")
    folder = new_folder(spark, "stored")
    for name in ("payments", "bookings"):
        append(conform(getattr(d, name), name, "2001-08-01 00:00:00"), f"{folder}/{name}.parquet")
    paid = metrics.paid_by_user(
        read_table(spark, folder, "payments"), read_table(spark, folder, "bookings")
    )
    scans = [line for line in plan_of(paid).splitlines() if "FileScan parquet" in line]
    payments = next(line for line in scans if "amount" in line)
    assert "EqualTo(status,PAID)" in payments
    assert "struct<booking_id:bigint,amount:decimal(10,2),status:string>" in payments
    bookings = next(line for line in scans if "amount" not in line)
    assert "struct<id:bigint,user_id:bigint>" in bookings


ADAPTIVE = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


def test_plain_joins_are_split_at_run_time(spark):
    """A parent of a third of all rows, once too large to broadcast, is split by Spark."""
    child = spark.range(3_000_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 100_000).cast("bigint").alias("k"),
        F.concat(F.lit("x"), "id").alias("s"),
    )
    parent = spark.range(200_000).select("id", F.concat(F.lit("n"), "id").alias("name"))
    keys = spark.range(400_000).select((F.col("id") % 90_000).alias("k"))
    before = {k: spark.conf.get(k, None) for k in ADAPTIVE}
    try:
        for k, v in ADAPTIVE.items():
            spark.conf.set(k, v)
        for joined in (
            with_parent(child, parent, "k", {"name": "parent"}, "left"),
            quality.orphans(child, parent, "k"),
            missing_in(child, keys, ["k"]),
        ):
            total = joined.agg(F.count("*"), F.max("s"))
            total.collect()
            assert "skew=true" in plan_of(total)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
