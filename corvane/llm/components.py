"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of longs -> (node, component): the smallest node reachable, for each node of a link.

    Labels spread to neighbours and then jump to their label's label, so the rounds grow with the logarithm of the
    longest path. No links, no rows.
    """
    edges = checkpointed(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = checkpointed(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        spread = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        onward = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        step = checkpointed(spread.join(onward, "component", "left").select("node", "old", F.least("component", F.coalesce("next", "component")).alias("component")))
        done = step.where("component < old").isEmpty()
        labels = step.select("node", "component")
        if done:
            return labels
