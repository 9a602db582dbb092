"""Connected components: within an array, and of an edge table by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import durable


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each node's smallest reachable node, of n nodes linked by a[i] - b[i]."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable from each node of edges (a, b: long), roots themselves left out.

    Each round joins every node's neighbours with the smallest one of them and is checkpointed; rounds grow with the logarithm of the
    largest component. A node of many edges is a hot join key that AQE splits. Loops, repeated edges and edges with a null end add
    nothing; an empty table gives an empty one; other columns of edges aren't looked at.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())

    def large(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()

    e = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = None
    while (now := state(e)) != was and now[0]:
        was = now
        e = durable(small(durable(large(e))))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
