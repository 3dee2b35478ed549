"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import salted_join, written


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node that its links reach) from links (a, b). Nodes without links don't appear.

    Each round takes the smallest label among the neighbours and then that label's own label, so chains halve. A hub may have a
    third of all links: labels travel by a salted join and are reduced before the shuffle.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        offered = salted_join(both, labels.select(F.col("node").alias("a"), "label"), ["a"], ["b"]).groupBy(
            F.col("b").alias("node")).agg(F.min("label").alias("offered"))
        step = written(labels.join(offered, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "offered").alias("label")), "labels")
        # A label is a node of the same component: follow its own label.
        jumps = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = written(salted_join(step, jumps, ["label"], ["node"]).select("node", "old", F.least("label", "further").alias("label")), "labels")
        if labels.where("old <> label").limit(1).count() == 0:
            return labels.select("node", "label")
        labels = labels.select("node", "label")
