"""Connected components by alternating stars, on any number of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsift.session import settle


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the (a, b) links: the smallest node that it reaches.

    Each round hooks all neighbours of a node to the smallest of them, first the larger ones, then the
    smaller ones, until every component is a star around its smallest node. Minima are taken by an
    aggregation, so a node with many links sends one row per task; every round is written out, which
    cuts the lineage. Loops and repeated links do no harm.
    """
    edges = settle(links.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.filter("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        edges = settle(small.distinct(), "links")
        # Stars around smallest nodes: nobody is both a centre and a neighbour.
        both_ways = edges.select(F.col("b").alias("a")).join(edges.select("a"), "a", "left_semi")
        if both_ways.isEmpty() and edges.groupBy("a").count().filter("count > 1").isEmpty():
            break
    stars = edges.groupBy("a").agg(F.min("b").alias("component"))
    centres = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), "component").unionByName(centres)
