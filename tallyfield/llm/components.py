"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _min_of_neighbours(edges: DataFrame) -> DataFrame:
    """Every (u, v) with the least node among u and all its partners."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _min_of_neighbours(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v in every row."""
    near = _min_of_neighbours(edges)
    links = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return links.union(near.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, component): the least node that each node reaches.

    Alternating large-star and small-star steps until nothing changes: every step is a grouped minimum
    and an equi-join, so no neighbour list is gathered anywhere and a node with a
    third of all links is split by the partial aggregation and by the adaptive
    skew join. The steps needed grow with the logarithm of the nodes, squared at most. Each round
    is written to the shared folder and the one before it deleted. Nodes without a
    link do not appear; null ends and self links are passed over.
    """
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    seen, state = None, ()
    while state != seen:
        seen = state
        new = written(_small_star(_large_star(now).distinct()).distinct(), "edges")
        forget(now)
        now = new
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
