"""Labels: which rows may teach, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: str | Column) -> Column:
    """Rows that no label may be learnt from; a null key counts as an empty text."""
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled(labels: DataFrame, key: str, label: str) -> DataFrame:
    """_id, _label (0 or 1) and _held_out: one row per key, the largest label of several."""
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    return (
        rows.groupBy(F.col(key).alias("_id"))
        .agg(F.max(F.col(label)).cast("int").alias("_label"))
        .withColumn("_held_out", held_out("_id"))
    )


def sample(rows: DataFrame, by: str, most: int) -> DataFrame:
    """At most ``most`` rows of each of the values 0 and 1 of ``by``, chosen by a hash of the id."""
    order = F.xxhash64("_id")
    picked = [rows.where(F.col(by) == value).orderBy(order, "_id").limit(most) for value in (0, 1)]
    return picked[0].unionByName(picked[1])
