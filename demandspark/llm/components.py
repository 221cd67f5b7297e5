"""Connected components by alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.llm.tables import stored


def _stars(edges: DataFrame) -> DataFrame:
    """Every node with a neighbour not above itself: each edge points to the smallest node around."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    # large star: every larger neighbour of u is tied to the smallest node around u
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    # small star: u and its smaller neighbours are tied to the smallest of them
    near = large.groupBy("u").agg(F.min("v").alias("m"))
    tied = large.join(near, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node of the component) for all nodes that an edge ``u, v`` names.

    The edges stay distributed; a node with many neighbours is pre-aggregated by map tasks and its
    edges are joined, not gathered. The rounds go on until nothing changes; they grow with the log of the
    longest chain.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges = stored(edges, "links")
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            labels = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return labels.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = now
        edges = stored(_stars(edges), "links")
