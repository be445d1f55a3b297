"""Connected components by hash-to-minimum propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.session import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node it can reach.

    Each round takes the least label of the neighbours and then the label of that label, so labels
    travel in doubling steps. Labels are written every round; the driver sees one count.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialize(both, "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("component").alias("c"))
        least = both.join(seen, "b").groupBy("a").agg(F.min("c").alias("c"))
        near = labels.join(least, F.col("node") == F.col("a")).select("node", F.col("component").alias("was"), F.least("component", "c").alias("c"))
        jump = labels.select(F.col("node").alias("m"), F.col("component").alias("up"))
        new = materialize(near.join(jump, F.col("c") == F.col("m")).select("node", F.least("c", "up").alias("component"), "was"), "labels")
        changed = new.where("component <> was").count()
        discard(labels)
        labels = new
        if not changed:
            return labels.select("node", "component")
