"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` of every node in ``links``; root is the component's least node.

    Alternates the large-star and small-star steps, each an aggregate with
    map-side minimum and one join, until no link changes.  Every round is
    written to the shared folder, so a lost executor costs one round.  So are the
    minima before they are joined on again: only then can the join of a hub's links
    be split, which is not done for an aggregate in the join's own stage.
    """
    edges = stage(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                  .where("u <> v").distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = broadcast_if_small(stage(
            both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.where("u <> v").distinct(), "links")
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(broadcast_if_small(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).where("u <> v")
        edges = stage(small.distinct(), "links")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
