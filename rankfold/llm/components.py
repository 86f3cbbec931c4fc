"""Connected components by minimum labels with pointer jumping, on Spark joins.

Labels never leave the cluster; each round is cut by a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node in ``edges`` (a, b): the smallest node it
    reaches. Each round takes the smallest label among a node and its
    neighbours, then the label's own label, so paths shorten by doubling."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("next"))
        far = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        step = materialize(step.join(far, "next", "left").select(
            "node", F.least("next", F.coalesce("far", "next")).alias("next"), "comp"))
        labels = step.select("node", F.col("next").alias("comp"))
        if step.where("next <> comp").isEmpty():
            return labels
