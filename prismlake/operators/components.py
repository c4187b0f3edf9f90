"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, materialize


def _least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least of u and its neighbours: partial sums meet first, so a hot node is one row of each task."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").withColumn("m", F.least("m", "u"))


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of every node of links (a, b); nodes without links are not listed.

    Rounds go on until one changes nothing, when every component is a star around its least node; there
    are O(log^2) of the number of nodes.
    """
    pairs = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    scratch = Scratch(links.sparkSession)
    mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    edges = scratch.table(pairs, "links")
    now = mark(edges)
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _least(both).where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b")
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = _least(down)
        small = low.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(low.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a <> b").distinct()
        edges, before = scratch.table(small, "links"), now
        now = mark(edges)
        if now == before:
            break
    found = edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")))
    found = materialize(found.groupBy("node").agg(F.min("component").alias("component")), "components")
    scratch.clear()
    return found
