"""Connected components by tables: every round each node takes the least label of its neighbours and of its label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, hot_keys, meet


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b: long), label being the component's least node. No edges, no rows.

    Each round's labels are written to the shared folder, and those of the round before deleted. A round joins the edges with
    the labels once, then lets each node jump to its label's label, so chains shorten by doubling. Hubs are dealt over tasks."""
    both = cut(spark, edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    first = cut(spark, both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label"), F.count("*").alias("n")), "labels")
    hot = hot_keys(first.select(F.col("node").alias("b"), "n"), ["b"])
    labels = first.select("node", "label")
    while True:
        near = meet(both, labels.withColumnRenamed("node", "b"), ["b"], hot, ["a"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"], "left").select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        step = cut(spark, lower.join(jump, "new", "left").select("node", F.least("new", "far").alias("label"), (F.least("new", "far") < F.col("label")).alias("moved")), "labels")
        discard(labels)
        labels = step.select("node", "label")
        if step.where("moved").isEmpty():
            discard(both)
            return labels
