"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexweave.session import materialised


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return (down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.withColumnRenamed("m", "v")).filter("u <> v").distinct())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` of every node with a link to another; ``component`` is the smallest node reachable.

    A node's neighbours are only ever reduced to their minimum, so a node with very many links is no burden on
    one task beyond its partial minima.  Rounds end when the links no longer change.
    """
    edges = materialised(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                         .filter("u <> v").distinct(), "links")

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(edges)
    while True:
        edges = materialised(_small_star(_large_star(edges)), "stars")
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
