"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of each connected component (src, dst); only for nodes that have a link.

    Every round takes the smallest label over the neighbours and then jumps to the label's label. Rounds are
    written to shared storage; both joins read written tables, so that the hub of a large group can be split.
    """
    edges = materialise(edges.union(edges.select("dst", "src")).toDF("src", "dst").distinct(), "edges")
    labels = materialise(edges.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("node")).alias("label")), "labels")
    while True:
        around = edges.join(labels, edges.src == labels.node).select(F.col("dst").alias("node"), "label")
        least = materialise(labels.union(around).groupBy("node").agg(F.min("label").alias("label")), "labels")
        up = least.select(F.col("node").alias("at"), F.col("label").alias("up"))
        jumped = materialise(least.join(up, least.label == up["at"], "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        changed = jumped.join(labels.withColumnRenamed("label", "was"), "node").filter(F.col("label") != F.col("was")).limit(1).count()
        labels = jumped
        if not changed:
            return labels
