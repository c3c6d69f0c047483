"""Connected groups of linked rows, by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.session import written


def _order(c: str, turn: int) -> Column:
    """An order of the nodes that is new in every round, so that no numbering of the input makes rounds slow."""
    return F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("id"))


def _to_roots(up: DataFrame) -> DataFrame:
    """(id, up) with each pointer led to the root of its tree: pointers of pointers, doubled until none moves."""
    while True:
        above = up.select(F.col("id").alias("up"), F.col("up").alias("_top"))
        moved = written(up.join(above, "up").select("id", F.col("_top").alias("up"), (F.col("_top") != F.col("up")).alias("_moved")))
        up = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return up


def connected(links: DataFrame) -> DataFrame:
    """(id, label) of every node of ``links`` (id, other): label is the smallest id reachable, in either direction.

    Each round, every node points to the first of itself and its neighbours in that round's order; pointers always lead
    down that order, so they form trees, and a tree becomes one node. A node stays a root only if it comes before all its
    neighbours, so a constant share of the nodes is expected to
    go each round: a chain of n nodes takes log n rounds where handing labels on takes n. Null ids link with nothing; repeated links, links in both directions and links of a
    node with itself change nothing, but a node linked only with itself is its own label.
    """
    links = links.where("id is not null and other is not null").select("id", "other")
    both = links.unionByName(links.select(F.col("other").alias("id"), F.col("id").alias("other")))
    members = written(both.select("id").distinct()).withColumn("root", F.col("id"))
    edges, turn = written(both.where("id <> other").distinct()), 0
    while not edges.isEmpty():
        best = edges.groupBy("id").agg(F.min(_order("other", turn)).alias("_best"))
        up = _to_roots(written(best.select("id", F.least("_best", _order("id", turn))["id"].alias("up"))))
        at = lambda c: up.select(F.col("id").alias(c), F.col("up").alias(f"_{c}"))
        members = written(members.join(at("root"), "root", "left").select("id", F.coalesce("_root", "root").alias("root")))
        merged = edges.join(at("id"), "id").join(at("other"), "other").where("_id <> _other")
        edges = written(merged.select(F.col("_id").alias("id"), F.col("_other").alias("other")).distinct())
        turn += 1
    smallest = members.groupBy("root").agg(F.min("id").alias("label"))
    return members.join(smallest, "root").select("id", "label")
