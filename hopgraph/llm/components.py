"""Connected components by smallest label, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopgraph.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, label): the smallest node that each linked node can reach.

    Every round takes the smallest label among the neighbours, then the label of
    that label, so long chains halve. Each round's labels are written to the
    shared folder; rounds end when no label changes.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = written(both, "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        further = labels.select(F.col("node").alias("via"), F.col("label").alias("next"))
        done = written(step.join(further, "via").select("node", "old", F.least("via", "next").alias("label")), "labels")
        labels = done.select("node", "label")
        if done.where("old <> label").isEmpty():
            return labels
