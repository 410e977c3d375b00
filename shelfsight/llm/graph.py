"""Connected components of a graph of links, by alternating large and small stars.

Each round every node's neighbours move to the least node they can see; the number of links
doesn't grow, and rounds grow with the logarithm of the longest path. Minima are computed with
partial sums and written before they are joined back, so that the join reads two exchanges and a
hub with very many links can be split among tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _star(edges: DataFrame) -> DataFrame:
    """For each u, the pairs (v, least neighbour of u or u itself)."""
    least = materialise(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars")
    return edges.join(least, "u")


def _key(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``id, component`` of every id that has a link to another id; the component is its least id."""
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = materialise(edges, "links")
    before = _key(edges)
    while True:
        both = materialise(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
        large = _star(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = materialise(large, "large")
        near = _star(down)
        edges = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialise(edges, "small")
        now = _key(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots).distinct()
