"""Connected components of a link table by alternating large-star and small-star steps.

Every round is two joins and two aggregations over the links and is written to the shared folder,
so lineage stays short and neither links nor components ever reach the driver: it only sees one
count and one checksum a round. A node of very many links is pre-aggregated by ``min`` before its
shuffle, and its side of the join is a skewed one that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.session import discard, materialize


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _to_minimum(links: DataFrame, near: DataFrame) -> DataFrame:
    """Joins every (a, b) of ``near`` with the least of a and all its b, as (b, least)."""
    least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least")).withColumnRenamed("a", "n")
    return links.join(least, F.col("a") == F.col("n")).select("a", "b", "least")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node it can reach.

    Links of a node with itself and repeated links change nothing; rows with a null end are
    ignored; an empty table gives no rows.
    """
    pair = links.where("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a"))
    now, seen = materialize(pair.distinct(), "links"), None
    while True:
        check = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(check) == seen:
            break
        seen = tuple(check)
        # Large star: a node's larger neighbours move to its least neighbour.
        both = _both_ways(now)
        large = _to_minimum(both, both).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.where("a <> b").distinct()
        # Small star: a node and its smaller neighbours move to the least of them.
        moved = _to_minimum(large, large)
        small = moved.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            moved.select("a", F.col("least").alias("b"))
        )
        before, now = now, materialize(small.where("a <> b").distinct(), "links")
        discard(before)
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
