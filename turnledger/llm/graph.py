"""Connected components of a graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node reachable. edges has the columns a and b.

    Each round takes the smallest label among the neighbours, then follows labels twice
    (pointer jumping), so rounds grow with the logarithm of the longest path. Labels stay
    in tables; only the number of changed ones comes to the driver.
    """
    both = durable(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = durable(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low")))
        jump = hooked.select(F.col("node").alias("low"), F.col("low").alias("next"))
        # A label is itself a node, so every row finds its next one.
        moved = durable(hooked.join(jump, "low").select("node", F.col("label").alias("was"), "next"))
        changed = moved.filter("was <> next").limit(1).count()
        labels = moved.select("node", F.col("next").alias("label"))
        if not changed:
            return labels
