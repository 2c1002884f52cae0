"""Connected components by minimum labels and pointer jumping, in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a long, b long) -> (node, root): the smallest node that each node reaches.

    Each round takes the least label among a node's neighbours and then follows
    labels one step further, so chains shorten by half or more.  Minima are
    aggregated before the shuffle, and the joins are plain equi-joins in which a
    hub's rows can be split.  No row leaves the executors but one count.
    """
    both = cut(edges.where("a <> b").selectExpr("a AS u", "b AS v").unionByName(edges.where("a <> b").selectExpr("b AS u", "a AS v")).distinct())
    labels = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    for _ in range(most_rounds):
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("m"))
        lower = labels.join(near, F.col("node") == F.col("u"), "left").select("node", F.least("label", "m").alias("next"), "label")
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        stepped = cut(lower.join(jump, F.col("next") == F.col("at"), "left").select("node", F.least("next", "beyond").alias("new"), "label"))
        changed = stepped.where("new <> label").limit(1).count()
        labels = stepped.select("node", F.col("new").alias("label"))
        if not changed:
            return labels.select("node", F.col("label").alias("root"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
