"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """links(a, b) -> (node, component): the smallest node reachable, for nodes that have a link.

    Self links, repeats and nulls are ignored; an empty table gives an empty table. Each round is four shuffles by key
    with map-side minimum, so a hub node costs one row for each task; nothing is collected but whether the links have become
    stars: each greater end has one lesser end, which is no greater end itself, so it is its component's smallest node.
    """
    edges = cut(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("low")))
        if ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("low").alias("low")).where("up > 1 or up > 0 and low > 0").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    found = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
