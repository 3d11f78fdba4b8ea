"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a grouped minimum, combined before the shuffle, and a join back on the same
key; nodes with very many edges get their minimum by a broadcast of bounded size instead.
Nothing about the nodes reaches the driver but whether the edges rest, and how many edges
the busiest node has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FREQUENT_ROWS, by_key, written


def _lower(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger node ``a`` to the smaller ``b``."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _with_least(rows: DataFrame, least: DataFrame, busy: bool) -> DataFrame:
    return by_key(rows, least, ["a"], "n") if busy else rows.join(least.drop("n"), "a")


def _large_star(edges: DataFrame, busy: bool) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return _with_least(both, least, busy).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, busy: bool) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    near = _with_least(edges, least, busy).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.union(least.select("a", F.col("m").alias("b")))


def _rests(edges: DataFrame) -> bool:
    """Whether the edges are stars: each node hangs on one other at most, and none hangs on a node that hangs itself."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.max("down").alias("downs"))
    return nodes.where("ups > 1 OR (ups > 0 AND downs > 0)").limit(1).count() == 0


def connected(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, its component's smallest node, of every node of ``edges`` (a, b).

    Edges with a null end are left out. Nodes that are their own component's smallest are
    not listed.
    """
    edges = written(_lower(edges.where("a IS NOT NULL AND b IS NOT NULL")), "edges")
    while not _rests(edges):
        busy = edges.count() > 64 * FREQUENT_ROWS
        stars = written(_lower(_large_star(edges, busy)), "edges")
        edges = written(_lower(_small_star(stars, busy)), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
