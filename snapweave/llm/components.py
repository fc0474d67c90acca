"""Connected components by alternating large-star and small-star steps on written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    edges: two long columns (a, b), in any direction, repeats and self loops allowed. Every step is a
    grouped minimum (combined before the shuffle) and an equi-join, whose hot keys Spark may split; the
    number of rows never exceeds twice the number of edges. Rounds grow as the logarithm of the longest
    chain. Empty edges give an empty result.
    """
    a, b = edges.columns
    star = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    star, mark = scratch.table(star, f"{name}-0"), None
    k = 0
    while True:
        k += 1
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = moved.unionByName(low.withColumnRenamed("m", "v")).distinct()
        new = scratch.table(new, f"{name}-{k}")
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{k - 1}")
        star = new
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    roots = star.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return scratch.table(star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), name)
