"""Connected components of a graph whose edges lie in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.session import durable


def connected(edges: DataFrame) -> DataFrame:
    """node, label of every node of ``edges`` (a, b): the label is the least node it reaches.

    Each round a node takes the least label of its neighbours and then that label's label, so
    long chains shrink by half and stars need two rounds.  Rounds are written out, so lineage
    stays short and nothing comes to the driver but a count.  Neighbours are reduced on the
    map side, and joins with a node of very many edges are split by adaptive execution.
    """
    once = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    there, back = F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    both = durable(once.select(F.inline(F.array(there, back))))
    first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    labels = durable(first.select("node", F.least("node", "label").alias("label")))
    while True:
        # The least label of the neighbours and the own one, which is remembered.
        near = both.join(labels, both["b"] == labels["node"]).select(
            F.col("a").alias("node"), "label", F.lit(None).cast("string").alias("_own")
        )
        own = labels.select("node", "label", F.col("label").cast("string").alias("_own"))
        lower = durable(
            near.unionByName(own).groupBy("node").agg(F.min("label").alias("label"), F.max("_own").alias("_old"))
        )
        if lower.where("label != _old").isEmpty():
            return labels
        of_label = lower.select(F.col("node").alias("_at"), F.col("label").alias("_next"))
        labels = durable(
            lower.join(of_label, lower["label"] == of_label["_at"]).select("node", F.col("_next").alias("label"))
        )
