"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def stars(edges: DataFrame) -> bool:
    """Whether each node has one edge at most to a smaller one (edges a > b), and no such smaller node has one itself."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("own"), F.lit(0).alias("of")).union(edges.select("b", F.lit(0), F.lit(1)))
    found = ends.groupBy("node").agg(F.sum("own").alias("own"), F.max("of").alias("of")).where("own > 1 or own = 1 and of = 1")
    return found.agg(F.count("*")).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of links (a long, b long), self links allowed.

    Rounds go on until every component is a star around its smallest node, without a cap: their number grows with
    the logarithm of the nodes. Each ends in a stored table, so lineage stays short. A node with very many links is
    a skewed join key, which adaptive execution splits; its minimum is pre-aggregated.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while not stars(edges):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_of = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = small_of.groupBy("a").agg(F.min("b").alias("m"))
        small = small_of.join(least, "a")
        edges = stored(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.join(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
