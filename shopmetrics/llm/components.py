"""Connected components of a table of links, by least labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, forget


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b): the least node reachable.

    Each turn takes the least label among a node and its neighbours, then follows
    the label's own label, so chains shrink by a power of two. All steps are
    joins and aggregations with map-side combine; a node of any degree is spread."""
    both = durable(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        nearer = durable(labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")))
        up = nearer.select(F.col("node").alias("label"), F.col("label").alias("up"))
        following = durable(nearer.join(up, "label").select("node", "was", F.least("label", "up").alias("label")))
        done = following.where("label <> was").isEmpty()
        forget(nearer, labels)
        labels = following
        if done:
            forget(both)
            return labels.select("node", "label")
