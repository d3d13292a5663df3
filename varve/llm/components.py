"""Connected components of an edge table, with lineage cut in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, component (smallest node reachable) of every node.

    Each round gives a node the least label among its own and its neighbours', then
    jumps to that label's own label, so long chains shrink by about half a round. Labels
    meet by min() with partial aggregation: a hub's edges are reduced before the shuffle.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    # Labels only fall, so this ends; a chain's rounds are about the logarithm of its length.
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        )
        step = labels.join(near, "node").select("node", F.least("component", "c").alias("component"), F.col("component").alias("old"))
        root = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        step = step.join(root, "component", "left").select("node", F.coalesce("up", "component").alias("component"), "old")
        step = written(step, "labels")
        labels = step.select("node", "component")
        if step.where("component <> old").limit(1).count() == 0:
            return labels
