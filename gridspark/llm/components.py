"""Connected components by alternating large-star and small-star rewrites.

Every round is a per-node minimum and a join, twice, so no adjacency list is
ever gathered. A node's edges are dealt out by a hash of their other end into
``SALTS`` parts: each part has its own minimum, a node has at most ``SALTS``
of those, and the join back is by node and part. A hub with a third of all
edges is thus spread over as many tasks, at every size alike. The edges of
each round are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

SALTS = 256


def _star(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least neighbour of u, itself included, as m."""
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    parts = dealt.groupBy("u", "part").agg(F.min("v").alias("part_v"))
    least = parts.groupBy("u").agg(F.min("part_v").alias("least_v")).select(F.col("u"), F.least("u", "least_v").alias("m"))
    return dealt.join(parts.select("u", "part").join(least, "u"), ["u", "part"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    star = _star(down)
    up = star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return up.unionByName(star.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v), longs, undirected → (node, root): root is the least node reachable.

    Nodes without an edge to another node don't appear; loops and repeated
    edges are ignored; no edges give an empty table. Rounds go on until one
    changes nothing, about the logarithm of the longest path's length.
    """
    now = written(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    mark, row = None, _mark(now)
    while row[0] and row != mark:
        after = written(_small_star(_large_star(now)), "cc")
        discard(now)
        now, mark = after, row
        row = _mark(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and the sum of their hashes: equal for equal sets of edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
