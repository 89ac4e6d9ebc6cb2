"""Connected components of links by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwave.session import cut


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b): the label is the smallest node that can be reached.

    Each pass takes the smallest label among a node's neighbours and then the label of that label, so a chain of n links needs
    about log n passes.  Minima are summed up per task before the shuffle, so a hub of any size is one row per task.  Passes are
    written to the shared folder.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        )
        low = labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = cut(low.join(jump, "label", "left").select("node", "old", F.least("label", "next").alias("label")))
        labels = new.select("node", "label")
        if new.where(F.col("old") != F.col("label")).limit(1).count() == 0:
            return labels
