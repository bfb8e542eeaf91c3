"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.store import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest id reachable from each node of *edges* (a long, b long).

    Every round links a node's neighbours to the smallest of them (large star, then small star),
    so the number of rounds grows with the logarithm of a component's diameter. Edges with a
    null end and loops are ignored; no edges give an empty table. Each round is a written table.
    A hub costs one row per neighbour: minima are pre-aggregated and joined back.
    """
    e = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    if e.isEmpty():
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    seen = None
    while True:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # Now every edge runs from a larger to a smaller id.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def settle(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives the ends of all pairs (a, b) one root, the smallest."""
    while True:
        while (root[root] != root).any():
            root[:] = root[root]
        low = np.minimum(root[a], root[b])
        if (root[a] == low).all() and (root[b] == low).all():
            return
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
