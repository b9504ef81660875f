"""Connected components of an edge table, by minimum label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.storage import written


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(a, b) -> (node, label): the smallest node reachable, for every node that has an edge.

    ``known`` may give the labels of a part of the edges, to start from.

    Each round takes the smallest label of a node and its neighbours, then the
    label of that label, so the distance covered about doubles.  A hub's rows
    are reduced by partial aggregation; labels are written to the shared folder
    each round, and only the number of changes reaches the driver.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node")
    if known is not None:
        old = known.select(F.col("node").alias("__n"), F.col("label").alias("__l"))
        labels = labels.join(old, F.col("node") == F.col("__n"), "left").select("node", F.least("label", F.coalesce("__l", "label")).alias("label"))
    labels = written(labels, "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, labels["node"] == near["a"], "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")
        )
        jump = labels.select(F.col("node").alias("__n"), F.col("label").alias("__l"))
        moved = written(
            least.join(jump, F.col("label") == F.col("__n"), "left").select(
                "node", F.least("label", F.coalesce("__l", "label")).alias("label"), "old"
            ),
            "labels",
        )
        labels = moved.select("node", "label")
        if moved.where(F.col("label") != F.col("old")).limit(1).count() == 0:
            return labels
