"""Regression trees for all folds at once. A level of every tree of every fold is one aggregation by (tree, node, feature,
bin); only that histogram and the chosen splits are shuffled between levels. A label of 0 and 1 gives a classification tree,
as the Gini gain of two classes is twice the variance gain."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.operators.scan import grouped_quantiles
from loamline.session import written


def binned(rows: DataFrame, by: Sequence[str], features: Sequence[str], bins: int = 32, weight: str = "_w") -> DataFrame:
    """Adds ``_bins``: for each feature how many of its ``bins - 1`` inner quantiles lie below the value. Quantiles are exact
    and come from the group's rows of positive weight, so no fold sees values of its test rows. A null value counts as lowest."""
    cells = F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v")) for i, c in enumerate(features)])
    long = rows.where(F.col(weight) > 0).select(*by, F.explode(cells).alias("_c")).select(*by, F.col("_c.f").alias("_feature"), F.col("_c.v").alias("_v"))
    names = {f"_q{i}": i / bins for i in range(1, bins)}
    per = grouped_quantiles(long, [*by, "_feature"], "_v", names)
    edges = per.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_feature", F.array(*names)))).alias("_edges"))

    def place(i, c):
        below = F.filter(F.try_element_at("_edges", F.lit(i)), lambda e: e < F.col(c).cast("double"))
        return F.coalesce(F.size(F.when(F.col(c).isNotNull(), below)), F.lit(-1))

    # size() of null is null or -1, depending on a setting; both mean below every edge.
    place_all = F.array(*[F.greatest(place(i, c), F.lit(0)) for i, c in enumerate(features)])
    return rows.join(edges, list(by), "left").withColumn("_bins", place_all).drop("_edges")


def place_of(tree: Column, depth: int) -> Column:
    """(node, value) that a row with ``_bins`` and ``_cat`` reaches in a tree (root, splits): the children of node n are 2n+1
    and, beyond the split, 2n+2."""
    start = F.struct(F.lit(0).alias("node"), tree["root"].alias("value"))
    if depth == 0:
        return start

    def step(at, _):
        s = F.try_element_at(tree["splits"], at["node"])
        right = F.when(s["cat"].isNotNull(), F.coalesce(F.col("_cat") == s["cat"], F.lit(False))).otherwise(
            F.try_element_at("_bins", s["f"] + 1) > s["bin"])
        return F.when(s.isNull(), at).otherwise(F.struct(
            (2 * at["node"] + 1 + right.cast("int")).alias("node"), F.when(right, s["right"]).otherwise(s["left"]).alias("value")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), start, step)


def value_of(tree: Column, depth: int) -> Column:
    """Prediction of a tree; null where a group had nothing to learn from."""
    return place_of(tree, depth)["value"]


def _best_splits(cells: DataFrame, keys: Sequence[str], min_rows: int, subset: int | None, seed: int) -> DataFrame:
    """Mean of each node and its split of largest gain, ties by feature and bin, null where no split gains. ``cells``: (keys, f,
    bin, cat, n, s, c) sums of weights, weighted targets and rows. A split carries the means of both sides, so the values of
    the last level need no further pass."""
    total = cells.where("f = 0").groupBy(*keys).agg(F.sum("n").alias("_n"), F.sum("s").alias("_s"), F.sum("c").alias("_c"))
    # At most one row per bin in a window.
    upto = Window.partitionBy(*keys, "f").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    numeric = cells.where("f >= 0").select(*keys, "f", "bin", "cat", *[F.sum(c).over(upto).alias(c) for c in ("n", "s", "c")])
    sides = numeric.unionByName(cells.where("f < 0")).join(total, list(keys))
    other = {c: F.col(f"_{c}") - F.col(c) for c in ("n", "s", "c")}
    gain = F.col("s") * F.col("s") / F.col("n") + other["s"] * other["s"] / other["n"] - F.col("_s") * F.col("_s") / F.col("_n")
    sides = sides.where((F.col("c") >= min_rows) & (other["c"] >= min_rows) & (F.col("n") > 0) & (other["n"] > 0)).withColumn("_gain", gain)
    order = F.struct("_gain", (-F.col("f")).alias("f"), (-F.col("bin")).alias("bin"), "cat")
    near, far = F.col("s") / F.col("n"), other["s"] / other["n"]
    # A category's cell is the side beyond its split.
    split = F.struct("f", "bin", "cat", F.when(F.col("f") < 0, far).otherwise(near).alias("left"),
                     F.when(F.col("f") < 0, near).otherwise(far).alias("right"))
    per = sides.groupBy(*keys, "f").agg(F.max_by(split, order).alias("split"), F.max("_gain").alias("_gain"))
    if subset is not None:
        # A node looks at some features only, drawn by hash; one row per feature in a window.
        drawn = Window.partitionBy(*keys).orderBy(F.xxhash64(*keys, "f", F.lit(seed)), "f")
        per = per.withColumn("_r", F.row_number().over(drawn)).where(F.col("_r") <= subset)
    # A gain of rounding noise is none.
    best = per.where("_gain > 0").groupBy(*keys).agg(F.max_by("split", F.struct("_gain", (-F.col("f")).alias("f"))).alias("split"))
    return total.select(*keys, (F.col("_s") / F.col("_n")).alias("value")).join(best, list(keys), "left")


def grow(rows: DataFrame, by: Sequence[str], depth: int, min_rows: int = 1, subset: int | None = None, seed: int = 42) -> DataFrame:
    """One tree per group, all groups level by level: (by, root, splits). ``rows`` has ``_bins`` (at least one feature), ``_cat``
    (string, split by one value against the rest; null: none), ``_y`` and ``_w``; rows of no weight are not learned from. A level
    writes its splits to the shared folder, so the next one reads the rows and one small table."""
    if depth < 1:
        raise ValueError("depth must be at least 1")
    by = list(by)
    train = rows.where("_w > 0 and _y is not null")
    models = None
    for level in range(depth):
        placed = train.withColumn("_node", F.lit(0)) if models is None else train.join(models, by).withColumn(
            "_node", place_of(F.struct("root", "splits"), level)["node"]).where(F.col("_node") >= 2**level - 1)
        each = F.transform("_bins", lambda b, i: F.struct(i.alias("f"), b.alias("bin"), F.lit(None).cast("string").alias("cat")))
        one = F.filter(F.array(F.struct(F.lit(-1).alias("f"), F.lit(0).alias("bin"), F.col("_cat").alias("cat"))), lambda c: c["cat"].isNotNull())
        parts = placed.select(*by, "_node", "_y", "_w", F.explode(F.concat(each, one)).alias("_p"))
        cells = parts.groupBy(*by, "_node", "_p").agg(
            F.sum("_w").alias("n"), F.sum(F.col("_w") * F.col("_y")).alias("s"), F.count("*").alias("c")).select(*by, "_node", "_p.*", "n", "s", "c")
        best = _best_splits(cells, [*by, "_node"], min_rows, subset, seed)
        # As many splits as a tree has nodes in this level.
        found = best.groupBy(*by).agg(F.max(F.when(F.col("_node") == 0, F.col("value"))).alias("root"), F.map_from_entries(
            F.filter(F.collect_list(F.struct("_node", "split")), lambda e: e["split"].isNotNull())).alias("splits"))
        if models is not None:
            more = found.select(*by, F.col("splits").alias("_more"))
            models = models.join(more, by, "left").select(
                *by, "root", F.when(F.col("_more").isNull(), F.col("splits")).otherwise(F.map_concat("splits", "_more")).alias("splits"))
        models = written(found if models is None else models)
    return models


def bootstrap_count(key: Sequence[str], tree: Column, seed: int) -> Column:
    """How often a row is drawn into a tree's sample: Poisson with mean one, from a hash of the row's key and the tree."""
    u = F.pmod(F.xxhash64(*key, tree, F.lit(seed)), F.lit(2**31)) / F.lit(float(2**31))
    below, out = 0.0, F.lit(0)
    for k in range(12):
        below += math.exp(-1) / math.factorial(k)
        out = out + (u >= below).cast("int")
    return out


def forest(rows: DataFrame, by: Sequence[str], key: Sequence[str], trees: int, depth: int, min_rows: int = 1,
           subset: int | None = None, seed: int = 42) -> DataFrame:
    """Adds ``_p``: mean over ``trees`` trees per group, each grown on a bootstrap sample. ``rows`` as for ``grow``; ``key`` names a row."""
    by = list(by)
    many = rows.withColumn("_tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    many = many.withColumn("_w", F.col("_w") * bootstrap_count([*by, *key], F.col("_tree"), seed))
    grown = grow(many, [*by, "_tree"], depth, min_rows, subset, seed)
    # A group's trees travel as one row: their number and size are parameters.
    # In order of their number, so that sums of predictions are the same in every run.
    per = grown.groupBy(*by).agg(F.collect_list(F.struct("_tree", "root", "splits")).alias("_trees")).withColumn(
        "_trees", F.array_sort("_trees", lambda a, b: a["_tree"] - b["_tree"]))
    total = F.aggregate("_trees", F.lit(0.0), lambda a, t: a + value_of(t, depth))
    return rows.join(per, by, "left").withColumn("_p", total / F.size("_trees")).drop("_trees")


def boosted(rows: DataFrame, by: Sequence[str], rounds: int, depth: int, min_rows: int = 1, step: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds ``_p``: least-squares boosting per group, from the weighted mean. Each round grows one tree per group on what is left
    of the target and writes the rows with their new prediction."""
    by = list(by)
    mean = rows.where("_w > 0 and _y is not null").groupBy(*by).agg((F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("_p"))
    now = written(rows.join(mean, by, "left"))
    for _ in range(rounds):
        left = now.withColumn("_y", F.col("_y") - F.col("_p"))
        tree = grow(left, by, depth, min_rows, None, seed)
        move = F.coalesce(value_of(F.struct("root", "splits"), depth), F.lit(0.0))
        now = written(now.join(tree, by, "left").withColumn("_p", F.col("_p") + step * move).drop("root", "splits"))
    return now
