"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of edges (a, b): label is the smallest node of its component.

    Each round gives every node the smallest label among itself and its neighbours, then the label of its label; rounds
    are written, and end when no label changes. Hubs only meet grouped minima and joins, which Spark can split.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumn("changed", F.lit(True)))
    while not labels.where("changed").isEmpty():
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = written(labels.select("node", "label").join(near, "node").select("node", "label", F.least("label", "near").alias("next")))
        jump = met.select(F.col("node").alias("next"), F.col("next").alias("further"))
        new = F.least("next", "further")
        labels = written(met.join(jump, "next").select("node", new.alias("label"), (new != F.col("label")).alias("changed")))
    return labels.select("node", "label")
