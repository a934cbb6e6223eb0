"""Connected components of a table of links, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.llm.common import let_go, scratch, step


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Each round passes the smallest label over the links and then jumps to the
    label's own label, so a chain of n nodes needs about log n rounds. Minima are
    combined before the shuffle: a hub with a third of all links is one row a task.
    Raises if ``max_rounds`` are not enough; no links give no rows.
    """
    with step() as keep:
        both = scratch(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
        moved = labels = scratch(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
        for _ in range(max_rounds):
            over = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
            next_ = labels.join(over, labels["node"] == over["a"], "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
            jump = next_.select(F.col("node").alias("at"), F.col("label").alias("far"))
            before, moved = moved, scratch(next_.join(jump, next_["label"] == jump["at"], "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
            labels = moved.select("node", "label")
            let_go(before)
            if moved.where("old <> label").isEmpty():
                keep(moved)
                return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
