"""Connected components of an edge table by alternating large-star and small-star steps.

A step is a grouped minimum and a join; each round's edges are written to the shared folder, so lineage stays short and
an executor's loss costs one round. The number of rounds grows with the logarithm of the graph's size. A round never
makes more edges than it got, so the number of files follows the edges that are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _rooted(edges: DataFrame) -> DataFrame:
    """u, v, m: each edge with the smallest of u and its neighbours."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m")), "u")


def _state(edges: DataFrame) -> tuple[int, bool]:
    """The number of edges, and whether a node still points to several or to one that points on."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    row = nodes.agg(F.sum("out").alias("n"), F.max((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("in") > 0))).alias("open")).first()
    return row["n"] or 0, bool(row["open"])


def components(links: DataFrame) -> DataFrame:
    """links: u, v (any order, repeats and loops allowed). Returns node, root: the smallest node it is linked to, for
    every node that has a link to another."""
    edges = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "links")
    n, opened = _state(edges)
    while opened:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _rooted(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        small = _rooted(large)
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = written(small.filter("u != v").distinct(), "links", rows=n)
        n, opened = _state(edges)
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
