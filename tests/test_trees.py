"""Trees of all folds against a plain search, and what folds may not see."""

import random

import numpy as np
from pyspark.sql import functions as F

from loamline.operators import models as M
from loamline.operators import trees as R


def best_split(rows, edges, least):
    """Exhaustive: (gain, feature, bin or category) of the best split of ``rows`` of (x, z, cat, y, w)."""
    def score(part):
        w = sum(r[4] for r in part)
        return sum(r[4] * r[3] for r in part) ** 2 / w if part else 0.0

    found = []
    for f in (0, 1):
        for b, edge in enumerate(edges[f]):
            found.append((f, b, lambda r, f=f, edge=edge: r[f] is not None and r[f] > edge))
    for c in sorted({r[2] for r in rows}):
        found.append((-1, c, lambda r, c=c: r[2] == c))
    best = None
    for f, b, beyond in found:
        right = [r for r in rows if beyond(r)]
        left = [r for r in rows if not beyond(r)]
        if min(len(left), len(right)) < least:
            continue
        gain = score(left) + score(right) - score(rows)
        if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
            best = (gain, f, b, beyond)
    return best


def predict(rows, edges, least, depth, row):
    split = best_split(rows, edges, least) if depth else None
    if split is None:
        return sum(r[4] * r[3] for r in rows) / sum(r[4] for r in rows)
    side = split[3](row)
    return predict([r for r in rows if split[3](r) == side], edges, least, depth - 1, row)


def test_weighted_trees_of_two_groups_equal_a_plain_search(spark):
    random.seed(7)
    data = []
    for g in (1, 2):
        for i in range(60):
            x, z, cat = round(random.random(), 3), random.choice([None, 1.0, 2.0, 3.0]), random.choice("abc")
            data.append((g, i, x, z, cat, round(3 * x * g + (2 if cat == "b" else 0) + random.random(), 3), float(random.choice([0, 1, 1, 2]))))
    rows = spark.createDataFrame(data, "g int, i int, x double, z double, _cat string, _y double, _w double")
    placed = R.binned(rows, ["g"], ["x", "z"], 8)
    out = placed.join(R.grow(placed, ["g"], 3, 2), "g").withColumn("p", R.value_of(F.struct("root", "splits"), 3))
    got = {(r.g, r.i): r.p for r in out.collect()}
    for g in (1, 2):
        learn = [(x, z, c, y, w) for h, _, x, z, c, y, w in data if h == g and w > 0]
        edges = [np.quantile([v for v in (r[k] for r in learn) if v is not None], [i / 8 for i in range(1, 8)]) for k in (0, 1)]
        for h, i, x, z, c, _, w in data:
            if h == g:
                assert abs(got[g, i] - predict(learn, edges, 2, 3, (x, z, c))) < 1e-9


def panel(spark, later):
    data = [(e, 2000 + y, float(e * y % 7), None if e == 3 else float(e), (later if y >= 6 else 1.0) * (10.0 * e + y * y)) for e in range(1, 7) for y in range(8)]
    return spark.createDataFrame(data, "e int, y int, a double, b double, t double")


def test_no_fold_sees_later_years_and_runs_repeat(spark):
    for kind, params in (("tree", {"maxDepth": 2, "maxBins": 4}), ("forest", {"numTrees": 5, "maxDepth": 2, "maxBins": 4}), ("boosted", {"maxIter": 2, "maxDepth": 1, "maxBins": 4})):
        runs = []
        for later in (1.0, 50.0):
            out = M.tree_fit_predict(panel(spark, later), kind, ["a", "b"], "e", "y", "t", [2003, 2006], params)
            runs.append(sorted((r.e, r.y, r.predicted) for r in out.collect()))
        assert runs[0] == runs[1] and len(runs[0]) == 12
        assert all(p is not None for _, _, p in runs[0])


def test_a_fold_without_earlier_rows_predicts_nothing(spark):
    out = M.tree_fit_predict(panel(spark, 1.0), "forest", ["a"], "e", "y", "t", [2000, 2004], {"numTrees": 3, "maxDepth": 1, "maxBins": 4})
    got = {(r.y, r.predicted is None) for r in out.collect()}
    assert got == {(2000, True), (2004, False)}
