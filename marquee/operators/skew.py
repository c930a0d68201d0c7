"""A join that stays balanced when one key fills a large part of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_unique(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str
) -> DataFrame:
    """Left outer join to a side with at most one row per key; adds the columns of ``right``.

    Adaptive execution can split a hot partition, or that of the null keys, only where the join
    shuffles both sides itself.  An aggregate lies partitioned by its key already and would be
    joined as it is, so ``right`` is dealt by its key and a hash of it first, which no join can
    use.  There is no count of keys and no bound: the split follows the sizes of the partitions.
    """
    dealt = right.repartition(F.col(right_key), F.xxhash64(right_key))
    return left.join(dealt, F.col(left_key) == F.col(right_key), "left").select(
        *left.columns, *right.columns
    )
