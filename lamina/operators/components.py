"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..storage import discard, materialize, written


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has one smaller neighbour, which has none itself: then that is the component's smallest."""
    ends = edges.select(F.col("v").alias("n"), F.lit(1).alias("up")).unionByName(edges.select(F.col("u").alias("n"), F.lit(0).alias("up")))
    mixed = ends.groupBy("n").agg(F.sum("up").alias("up"), F.min("up").alias("low")).filter("up > 1 OR (up = 1 AND low = 0)")
    return mixed.isEmpty()


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of longs to (node, component): the smallest node that each linked node reaches.

    Each round rewires every node's links to the smallest node near it, with two aggregations and joins; rounds grow
    with the logarithm of a component's diameter, and no task holds a component. Rounds are written to the shared
    folder, each in place of the one before. An empty table gives an empty result; repeated links and self-links do no harm.
    """
    spark = links.sparkSession
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links")
    while not _are_stars(edges):
        old = written(spark)[-1]
        # Large star: a node's larger neighbours go to the smallest of the node and all its neighbours.
        both = edges.select(F.col("v").alias("n"), F.col("u").alias("o")).unionByName(edges.select(F.col("u").alias("n"), F.col("v").alias("o")))
        low = both.groupBy("n").agg(F.min("o").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.filter("o > n").join(low, "n").select(F.col("o").alias("v"), F.col("m").alias("u")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of those.
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(low.select("v", F.col("m").alias("u")))
        edges = materialize(small.filter("v <> u").distinct(), "links")
        discard(spark, [old])
    nodes = edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return nodes.unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
