"""Helpers that several operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds at least 1/HOT_SHARE of the rows, so there are at most HOT_SHARE.
HOT_SHARE = 1000


def read(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def identified(df: DataFrame, *columns: str | Column) -> DataFrame:
    """The columns and ``_row``, a number of the row; write it out before relying on it."""
    return df.select(*columns, F.monotonically_increasing_id().alias("_row"))


def join_groups(
    rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, facts: str = "_facts"
) -> DataFrame:
    """Rows with the one row of ``groups`` that has their key, as struct ``facts`` (null: none).

    ``size`` in ``groups`` counts the rows of a key and ``total`` all rows.  Hot keys are
    answered by a broadcast of at most HOT_SHARE rows and never shuffled by the key; the rest
    joins by shuffle.  Both ways give the same rows, whatever the sizes.
    """
    fields = F.struct(*[c for c in groups.columns if c != key]).alias(facts)
    is_hot = F.col(size) * HOT_SHARE >= F.lit(total)
    hot = F.broadcast(groups.where(is_hot).select(key, fields))
    cold = groups.where(~is_hot).select(key, fields)
    answered = rows.join(hot, key)
    others = rows.join(hot, key, "left_anti").join(cold, key, "left")
    return answered.unionByName(others)
