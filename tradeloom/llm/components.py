"""Connected components of a link table by alternating large-star and small-star steps; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged


def _signature(edges: DataFrame) -> tuple:
    """Equal for equal edge sets; two sums of hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of links (a, b): label is the smallest node that it reaches.

    Each step is a shuffle by node whose rows a partial aggregation has combined: a node of many links moves once for
    each task.  The number of steps grows with the logarithm of the longest chain.
    """
    edges = staged(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    of = _signature(edges)
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("hi"), F.col("m").alias("lo")).where(F.col("hi") != F.col("lo")).distinct()
        large = staged(large, "large-star")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(least, "hi")
        small = joined.where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
        small = staged(small, "small-star")
        before, edges = of, small
        if before == (of := _signature(edges)):
            break
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct())
