"""Connected components of a link table, as joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablevec.session import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node reachable.

    Each round takes the least label among neighbours and then follows labels one step further, so the rounds
    needed grow with the logarithm of the longest path. Every round is written to the shared folder.
    """
    both = materialise(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")), "labels")
    while True:
        least = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("least"))
        near = labels.join(least, labels.node == least.a).select("node", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        ahead = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = materialise(near.join(ahead, "label").select("node", "old", F.least("label", "next").alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.where("label <> old").limit(1).count() == 0:
            return labels.select("node", F.col("label").alias("component"))
