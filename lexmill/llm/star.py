"""Connected components of an edge table, by stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b); root is the least node of its component.

    Each round ties the larger neighbours of a node to the least one around it, then the smaller ones,
    until the edges are stars and stay so. Minima are combined before the shuffle; no group is collected.
    """
    now = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        now = cut_lineage(small.select("a", F.col("m").alias("b")).unionByName(
            small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
