"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import stage

MAX_ROUNDS = 200


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (columns ``a`` and ``b``, longs).

    The component is its smallest node. Alternates large and small star steps:
    every node's neighbours are linked to the least of them, so a group shrinks
    to a star in a few rounds whatever its shape, and a hub is never gathered:
    its least neighbour is an aggregate and its edges are joined to one row.
    Every round is staged.
    """
    edges = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = _digest(edges)
    for _ in range(MAX_ROUNDS):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low, "a")
        small = hung.select("a", F.col("m").alias("b")).union(
            hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        edges = stage(small.distinct(), "edges")
        after = _digest(edges)
        if after == before:
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
        before = after
    raise RuntimeError("components did not settle")
