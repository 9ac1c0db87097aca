"""Connected components over a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dealt_anew, forget


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): for every linked node the smallest node that links reach.

    Alternating large-star and small-star rounds over the links. A node's minimum
    is a partial aggregate and comes back by a join whose hot keys AQE splits, so that a node with very many
    links is neither collected nor windowed in one task. Null ends and self-links
    are ignored; nodes without links don't appear.
    """
    links = links.where(f"{left} is not null and {right} is not null and {left} <> {right}")
    edges = cut(links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct(), "links")
    seen = None
    while True:
        # large-star: every larger neighbour of u moves to u's smallest neighbour
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(dealt_anew(lowest, "u"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: every smaller neighbour of u, and u, move to the smallest
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(dealt_anew(lowest, "u"), "u")
        small = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()
        edges, before = cut(small, "links"), edges
        forget(before)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = now
