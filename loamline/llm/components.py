"""Connected components of a links table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loamline.llm.shared import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first())


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component): each node of ``links`` (a, b) with the smallest node that it reaches.

    The large star hangs every larger neighbour on a node's smallest neighbour, the small star does so with the smaller
    ones. Both are aggregations with a join on the node, so a node with a third of all links is combined before the
    shuffle and its join is split by AQE. Rounds go on until nothing changes; their number grows with the logarithm of
    the number of nodes. Each round is written to the shared folder.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")
        ).select("e.*").where("a <> b").distinct()
        edges = stored(small)
        state, before = _state(edges), state
        if state == before:
            break
    low = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return low.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def joined(reach: DataFrame, links: DataFrame) -> DataFrame:
    """``reach``, the components (node, component) of earlier links, after more ``links`` (a, b). Only links between two of
    its components are contracted, with these as nodes, so neither work nor plans grow with the earlier links."""
    of = lambda end: F.coalesce(f"_{end}", end).alias(end)
    ends = links
    for end in ("a", "b"):
        ends = ends.join(reach.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")), end, "left")
    up = stored(components(ends.select(of("a"), of("b"))))
    moved = reach.join(up.select(F.col("node").alias("component"), F.col("component").alias("_up")), "component", "left")
    return moved.select("node", F.coalesce("_up", "component").alias("component")).union(up).groupBy("node").agg(
        F.min("component").alias("component"))
