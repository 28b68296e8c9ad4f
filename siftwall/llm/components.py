"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``node, label`` for every node of ``a, b`` edges; the label is the smallest node.

    Each round takes the smallest label among a node and its neighbours and then follows
    labels of labels, so the rounds grow as the logarithm of the longest chain. Each round
    is a table in the shared folder; the driver sees one number, how many labels changed.
    An empty edge table has no components; loops and repeated edges do no harm.
    """
    both = stage(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "edges",
    )
    labels = stage(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")),
        "labels",
    )
    for _ in range(rounds):
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "node").select(
            "node", F.least("label", "near").alias("next"), F.col("label").alias("old")
        )
        follow = labels.select(F.col("node").alias("next"), F.col("label").alias("beyond"))
        moved = stage(
            lower.join(follow, "next", "left").select(
                "node", F.least("next", F.coalesce("beyond", "next")).alias("label"), "old"
            ),
            "labels",
        )
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            return labels
    raise RuntimeError("components did not settle")
