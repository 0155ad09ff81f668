"""Graphs of pairs: components and small cliques."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumizh.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the graph of (a, b) with a < b; a component is its smallest node.

    Alternating large and small stars: in each round every node's larger neighbours, then
    every node's smaller ones, are tied to the smallest node around.  The number of rounds
    grows with the logarithm of the longest path; a node's neighbours are only ever
    reduced to their minimum, never gathered.
    """
    nodes = cut(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    star = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())

    def tie(pairs: DataFrame, larger: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = both.join(least, "u")
        moved = joined.where("v > u") if larger else joined.where("v <> m")
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not larger:  # the node itself is tied to the smallest as well
            out = out.unionByName(joined.select("u", F.col("m").alias("v")))
        return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    state = None
    while True:
        star = cut(tie(tie(star, True), False))
        now = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = star.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def triangles(edges: DataFrame) -> DataFrame:
    """(x, y, z), x < y < z, of the graph of distinct (a, b) with a < b.

    Each edge points from the end with fewer neighbours to the other, so that a hub
    starts few wedges; wedges are closed by a join.
    """
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    side = lambda e, c: e.join(degree.select(F.col("node").alias(c), F.struct("d", F.col("node").alias("n")).alias(f"r{c}")), c)
    ranked = side(side(edges, "a"), "b")
    up = F.col("ra") < F.col("rb")
    directed = ranked.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("t"))
    wedges = directed.alias("p").join(directed.alias("q"), "s").where("p.t < q.t").select("s", F.col("p.t").alias("a"), F.col("q.t").alias("b"))
    closed = wedges.join(edges, ["a", "b"])
    return closed.select(F.array_sort(F.array("s", "a", "b")).alias("t")).select(*(F.col("t")[i].alias(n) for i, n in enumerate("xyz")))


def cliques4(three: DataFrame, edges: DataFrame) -> DataFrame:
    """(x, y, z, w), in order, of the triangles (x, y, z) and the edges (a, b) of one graph: two triangles over one edge, closed by another."""
    left = three.select("x", "y", "z")
    met = left.join(left.withColumnRenamed("z", "w"), ["x", "y"]).where("z < w")
    return met.join(edges.select(F.col("a").alias("z"), F.col("b").alias("w")), ["z", "w"]).select("x", "y", "z", "w")


def maximal(three: DataFrame, four: DataFrame) -> DataFrame:
    """(members) of the cliques of four, and of those of three that are part of none."""
    parts = F.array(F.array("x", "y", "z"), F.array("x", "y", "w"), F.array("x", "z", "w"), F.array("y", "z", "w"))
    inside = four.select(F.explode(parts).alias("members")).distinct()
    alone = three.select(F.array("x", "y", "z").alias("members")).join(inside, "members", "left_anti")
    return four.select(F.array("x", "y", "z", "w").alias("members")).unionByName(alone)
