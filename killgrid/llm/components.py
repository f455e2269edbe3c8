"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persist, release


def connected_components(links: DataFrame, files: int | None = None) -> DataFrame:
    """(node, label) for the nodes of links (a, b): label is the smallest node of the component.

    Each round takes the smallest label among the neighbours, then the label of that label, so chains shrink
    by doubling. Only minima are gathered per node (combined before the shuffle); state goes to the shared
    folder every round. The joins on a node of many links move two numbers a row; the adaptive split of
    skewed partitions deals with them. files: as in persist, for the tables of a round.
    """
    both = persist(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).where("u <> v").distinct(), "cc-links", files)
    labels = persist(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "cc-labels", files)
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("m"))
        hooked = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", "label", F.least("label", "m").alias("m"))
        jump = labels.select(F.col("node").alias("m"), F.col("label").alias("mm"))
        new = persist(hooked.join(jump, "m").select("node", F.least("m", "mm").alias("label"), (F.least("m", "mm") != F.col("label")).alias("moved")), "cc-labels", files)
        moved = new.where("moved").limit(1).count()
        release(labels)
        labels = new.select("node", "label")
        if not moved:
            release(both)
            return labels
