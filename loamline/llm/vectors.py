"""Exact near-duplicates of vectors: a metric range join over pivot cells.

On unit vectors a cosine of at least t is a Euclidean distance of at most r = sqrt(2 - 2 t). Each vector's home is the
cell of its nearest pivot. A vector v of another cell can only be within r of u if, by the triangle inequality,
d(u, pivot of v) <= d(u, own pivot) + 2 r and d(u, pivot of v) <= radius of that cell + r; and as v lies on its pivot's
side of the plane halfway between the two pivots, u may not lie further than r on the other side of it. u is copied to
the cells that meet all three. Each cell then joins on its own: all partners of a home vector are in its cell.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from loamline.llm.components import components
from loamline.llm.shared import stored


@dataclass(frozen=True)
class Range:
    """``cell``: vectors per pivot aimed at, with at most ``pivots`` per group. ``chunk``: vectors assigned in one task;
    ``block``: vectors on each side of a comparison task, whatever the size of a cell."""

    cosine: float = 0.98
    cell: int = 1000
    pivots: int = 256
    chunk: int = 5000
    block: int = 2000
    slack: float = 1e-6

    @property
    def radius(self) -> float:
        return float(np.sqrt(2 - 2 * self.cosine)) + self.slack


def unit(column: pa.Array) -> np.ndarray:
    """Rows of a list column, in double precision and of length one."""
    if not len(column):
        return np.zeros((0, 1))
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _combined(table: pa.Table, name: str) -> pa.Array:
    got = table.column(name).combine_chunks()
    return got.chunk(0) if isinstance(got, pa.ChunkedArray) else got


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ y.T)))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable index of each of n nodes, over the links a[i] - b[i]."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """Rows (label, dim, embedding, rep, copies): vectors that can link, equal ones of a label as one."""
    x = F.col("embedding").cast("array<double>")
    fine = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    valid = vectors.where("label is not null and vec_id is not null").where(fine).select("vec_id", F.col("label").cast("string").alias("label"), x.alias("embedding"))
    return valid.groupBy("label", "embedding").agg(F.min("vec_id").cast("long").alias("rep"), F.count("*").alias("copies")).withColumn(
        "dim", F.size("embedding"))


def cells(rows: DataFrame, plan: Range) -> DataFrame:
    """Rows (label, dim, cell, home, rep, copies, embedding): each vector in its home cell and copied to the cells near it."""
    sizes = rows.groupBy("label", "dim").agg(F.count("*").alias("n"))
    order = W.partitionBy("label", "dim").orderBy(F.xxhash64("rep"), "rep")
    # Under names of their own, as both sides of the cogroup come from the same rows.
    ranked = rows.select(*[F.col(c).alias(c) for c in ("label", "dim", "embedding")], F.row_number().over(order).alias("nr"), "rep").where(F.col("nr") <= plan.pivots)
    wanted = F.least(F.lit(plan.pivots), F.ceil(F.col("n") / plan.cell))
    groups = ["label", "dim"]
    pivots = ranked.join(sizes, groups).where(F.col("nr") <= wanted).select(*groups, "nr", "embedding", F.explode(F.sequence(
        F.lit(0).cast("long"), F.call_function("div", F.col("n") - 1, F.lit(plan.chunk)))).alias("chunk"))
    dealt = rows.join(sizes, groups).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.call_function("div", F.col("n") - 1, F.lit(plan.chunk)) + 1))
    near = plan.radius

    def assign(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return ASSIGNED.empty_table()
        right = right.sort_by("nr")
        x, p = unit(_combined(left, "embedding")), unit(_combined(right, "embedding"))
        d = distances(x, p)
        home = d.argmin(axis=1)
        own = d[np.arange(len(x)), home]
        between = np.maximum(distances(p, p), 1e-9)[home]
        close = (d <= own[:, None] + 2 * near) & ((d * d - (own * own)[:, None]) / (2 * between) <= near)
        close[np.arange(len(x)), home] = True
        row, cell = np.nonzero(close)
        took = left.select(["label", "dim", "rep", "copies", "embedding"]).take(pa.array(row))
        return took.append_column("cell", pa.array(cell.astype(np.int64))).append_column(
            "home", pa.array(cell == home[row])).append_column("far", pa.array(d[row, cell])).select(ASSIGNED.names).cast(ASSIGNED)

    schema = "label string, dim int, rep long, copies long, embedding array<double>, cell long, home boolean, far double"
    made = stored(dealt.select(*groups, "chunk", "rep", "copies", "embedding").groupBy(*groups, "chunk").cogroup(
        pivots.groupBy(*groups, "chunk")).applyInArrow(assign, schema))
    radii = made.where("home").groupBy(*groups, "cell").agg(F.max("far").alias("reach"), F.count("*").alias("homes"))
    # A cell without a home vector has no radius: nothing has to be copied to it.
    return made.join(radii, [*groups, "cell"]).where(F.col("home") | (F.col("far") <= F.col("reach") + near))


ASSIGNED = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("rep", pa.int64()), ("copies", pa.int64()),
                      ("embedding", pa.list_(pa.float64())), ("cell", pa.int64()), ("home", pa.bool_()), ("far", pa.float64())])


def link_rows(rows: DataFrame, plan: Range) -> DataFrame:
    """Rows (a, b, n): b null: vector a has n more links to other vectors; else a and b are connected.

    A task compares a block of a cell's home vectors with a block of all its vectors. It gives a count per home vector
    and a star per connected set, never the pairs. Vectors too far apart as seen from the pivot are not compared.
    """
    placed = cells(rows, plan)
    sizes = placed.groupBy("label", "dim", "cell").agg(F.count("*").alias("_all"), F.count(F.when(F.col("home"), 1)).alias("_home"))
    parts = lambda c: F.call_function("div", F.col(c) - 1, F.lit(plan.block)) + 1
    sized = placed.join(sizes, ["label", "dim", "cell"]).withColumns({
        "_lefts": parts("_home"), "_rights": parts("_all"), "_spread": F.abs(F.shiftright(F.xxhash64("rep"), 8))})
    columns = ["label", "dim", "cell", "rep", "copies", "embedding", "far"]
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = sized.where("home").select(*columns, F.lit(True).alias("left"), (F.col("_spread") % F.col("_lefts")).alias("i"), every("_rights").alias("j"))
    right = sized.select(*columns, F.lit(False).alias("left"), every("_lefts").alias("i"), (F.col("_spread") % F.col("_rights")).alias("j"))
    near, cosine = plan.radius, plan.cosine

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("far")
        rep, side = table.column("rep").to_numpy(), table.column("left").to_numpy()
        copies, far = table.column("copies").to_numpy(), table.column("far").to_numpy()
        x = unit(_combined(table, "embedding"))
        lefts, rights = np.flatnonzero(side), np.flatnonzero(~side)
        count, links_a, links_b = np.zeros(len(rep), dtype=np.int64), [], []
        for begin in range(0, len(lefts), 256):
            some = lefts[begin:begin + 256]
            lo = np.searchsorted(far[rights], far[some[0]] - near)
            hi = np.searchsorted(far[rights], far[some[-1]] + near, side="right")
            against = rights[lo:hi]
            hit = (x[some] @ x[against].T >= cosine) & (rep[some][:, None] != rep[against][None, :])
            count[some] += hit @ copies[against]
            a, b = np.nonzero(hit)
            links_a.append(some[a])
            links_b.append(against[b])
        a, b = (np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in (links_a, links_b))
        ids, node = np.unique(rep, return_inverse=True)
        label = forest(node[a], node[b], len(ids))
        member = np.flatnonzero(label != np.arange(len(ids)))
        counted = lefts[count[lefts] > 0]
        return pa.table({
            "a": pa.array(np.concatenate([rep[counted], ids[member]])),
            "b": pa.array([None] * len(counted) + ids[label[member]].tolist(), pa.int64()),
            "n": pa.array(np.concatenate([count[counted], np.zeros(len(member), dtype=np.int64)]))})

    return left.union(right).groupBy("label", "dim", "cell", "i", "j").applyInArrow(compare, "a long, b long, n long")


def near_vectors(vectors: DataFrame, plan: Range = Range()) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Only vectors with equal, not null labels and equal length are compared. Null and zero vectors, and those with null
    or non-finite components, link with nothing. Equal vectors count as one for the join and link with each other. Rows
    that share a vec_id are one node of the components. A null vec_id links with nothing, has a null component and is
    kept. Other columns are not read.
    """
    rows = stored(distinct_vectors(vectors))
    found = stored(link_rows(rows, plan))
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    x = F.col("embedding").cast("array<double>")
    keyed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), x.alias("embedding"))
    members = keyed.join(rows.select("label", "embedding", "rep", "copies"), ["label", "embedding"], "left").select(
        "vec_id", F.when(F.col("vec_id").isNotNull(), F.col("rep")).alias("rep"), "copies")
    members = stored(members)
    same = members.where("rep <> vec_id").select(F.col("rep").alias("a"), F.col("vec_id").alias("b"))
    reach = components(found.where("b is not null").select("a", "b").union(same))
    linked = members.join(counts, "rep", "left").select("vec_id", F.when(
        F.col("rep").isNotNull(), F.coalesce("n", F.lit(0)) + F.col("copies") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"))
    return linked.join(reach.withColumnRenamed("node", "vec_id"), "vec_id", "left").select(
        "vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
