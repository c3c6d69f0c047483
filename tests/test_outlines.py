"""Feature documents of any length and layout, points in outlines of many edges, and cells of a scan line."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loamline.operators import spatial as S
from loamline.sources import readers as R

NAMED = StructType([StructField("name", StringType())])
SHAPE = "poly string, rings array<array<struct<x: double, y: double>>>"


def feature(i, kind, coordinates, name="x", **more):
    return {"type": "Feature", "id": i, "properties": {"name": name}, "geometry": {"type": kind, "coordinates": coordinates}, **more}


SQUARE = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
HOLE = [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 1.0]]
FEATURES = [
    feature("a", "Point", [100.5, 13.25, 7.0], 'brace } { "quote\\" \\\\'),
    feature("b", "Polygon", [SQUARE, HOLE], "}}}{{{"),
    feature(3, "MultiPolygon", [[SQUARE], [[[9, 9], [10, 9], [9, 10]]]], "[]\n\t\\u007d"),
    feature("a", "LineString", [[0, 0], [1, 1]], ""),
    {"id": "d", "geometry": None, "properties": {"name": None}, "type": "Feature"},
]
COLLECTION = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "Feature"}}, "features": FEATURES, "end": {"bbox": [0, 1]}}


@pytest.mark.parametrize("text", [
    json.dumps(COLLECTION), json.dumps(COLLECTION, indent=2), json.dumps(COLLECTION, indent=1) + "\n\n",
    "\n".join(json.dumps({**COLLECTION, "features": [f]}) for f in FEATURES) + "\n"])
def test_features_of_all_kinds_and_layouts(spark, tmp_path, text):
    (tmp_path / "f.json").write_text(text, encoding="utf-8")
    rows = R.read_features(spark, str(tmp_path / "f.json"), NAMED).collect()
    assert sorted((r.id, r.kind or "", r["name"] or "", r.id_count) for r in rows) == sorted(
        (str(f["id"]), (f["geometry"] or {}).get("type", ""), f["properties"]["name"] or "", 2 if f["id"] == "a" else 1) for f in FEATURES)
    by = {(r.id, r.kind): r for r in rows}
    assert tuple(by["a", "Point"].point) == (100.5, 13.25) and by["a", "Point"].parts is None
    assert [[tuple(c) for c in ring] for ring in by["b", "Polygon"].parts[0]] == [[tuple(c) for c in SQUARE[:-1]], [tuple(c) for c in HOLE[:-1]]]
    assert [len(part) for part in by["3", "MultiPolygon"].parts] == [1, 1] and len(by["3", "MultiPolygon"].parts[1][0]) == 3
    assert by["a", "LineString"].parts is None and by["d", None].parts is None


def test_a_long_document_is_read_in_several_tasks(spark, tmp_path):
    many = [feature(i, "Polygon", [[[i + math.cos(k / 20), math.sin(k / 20)] for k in range(rng)]], "}" * (i % 5))
            for i, rng in enumerate([5] * 3000 + [4000] + [5] * 500)]
    path = str(tmp_path / "long.json")
    with open(path, "w", encoding="utf-8") as file:
        json.dump({"type": "FeatureCollection", "features": many}, file)  # one line
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        pieces = spark.read.text(path, lineSep="}")
        assert pieces.rdd.getNumPartitions() > 5
        rows = R.read_features(spark, path, NAMED).select("id", "name", F.size(F.col("parts")[0][0]).alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((int(r.id), r["name"], r.n) for r in rows) == [(f["id"], f["properties"]["name"], len(f["geometry"]["coordinates"][0])) for f in many]


def test_a_cut_document_stops_the_query(spark, tmp_path):
    (tmp_path / "cut.json").write_text(json.dumps(COLLECTION)[:-200])
    with pytest.raises(Exception, match="Braces do not match"):
        R.read_features(spark, str(tmp_path / "cut.json"), NAMED).collect()
    (tmp_path / "empty.json").write_text('{"type": "FeatureCollection", "features": []}')
    assert R.read_features(spark, str(tmp_path / "empty.json"), NAMED).count() == 0


def inside(x, y, ring):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
            odd = not odd
    return odd


def star(cx, cy, n, rng, low=0.4, high=1.0):
    return [(cx + r * math.cos(2 * math.pi * k / n), cy + r * math.sin(2 * math.pi * k / n)) for k in range(n) for r in [rng.uniform(low, high)]]


@pytest.mark.parametrize("step,dense", [(0.25, 32), (5.0, 4), (0.07, 1000)])
def test_points_in_outlines_against_ray_casting(spark, step, dense):
    rng = random.Random(7)
    shapes = [("lake", [star(100, 10, 900, rng), star(100, 10, 200, rng, 0.1, 0.3), star(100.2, 10.3, 50, rng, 0.01, 0.05)]),
              ("spike", [[(99.0, 9.0), (101.0, 9.001), (99.0, 9.002), (99.1, 9.001)]]), ("far", [[(-50.0, -50.0), (-49.0, -50.0), (-50.0, -49.0)]]),
              ("big", [[(90.0, 0.0), (110.0, 0.0), (110.0, 20.0), (90.0, 20.0)]]), ("lake", [star(101, 11, 60, rng)]), ("none", [[]])]
    points = [(i, rng.uniform(98.9, 101.9), rng.uniform(8.9, 11.9)) for i in range(1500)]
    points += [(2000 + i, 100.0 + rng.gauss(0, 0.001), 10.9 + rng.gauss(0, 0.001)) for i in range(500)] + [(3000, None, 10.0), (3001, -49.9, -49.9)]
    found = S.point_in_polygon_join(spark.createDataFrame(points, "id int, lon double, lat double"), spark.createDataFrame(
        [(n, [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for n, rings in shapes], SHAPE), step=step, dense=dense)
    assert "rings" not in found.columns
    got = sorted((r.id, r.poly) for r in found.collect())
    want = sorted((i, n) for i, x, y in points if x is not None for n, rings in shapes
                  if inside(x, y, rings[0]) and not any(inside(x, y, h) for h in rings[1:]))
    assert got == want and len(got) > 2000


def test_boundaries_belong_to_the_outer_ring_and_to_holes_sides(spark):
    shapes = [("s", [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]])]
    points = {"corner": (4.0, 4.0), "side": (0.0, 2.2), "top": (3.3, 4.0), "hole side": (1.0, 1.5), "hole": (1.5, 1.5), "in": (3.0, 3.0), "out": (4.0001, 2.0)}
    df = spark.createDataFrame([(k, x, y) for k, (x, y) in points.items()], "id string, lon double, lat double")
    polygons = spark.createDataFrame([(n, [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for n, rings in shapes], SHAPE)
    for step in (0.25, 1.0, 10.0):
        assert {r.id for r in S.point_in_polygon_join(df, polygons, step=step, dense=2).collect()} == {"corner", "side", "top", "hole side", "in"}


@pytest.mark.parametrize("step,dense,full,depth", [(0.25, 32, 1024, 12), (1.0, 8, 64, 4)])
def test_sums_of_points_in_outlines_against_ray_casting(spark, step, dense, full, depth):
    rng = random.Random(5)
    shapes = [("lake", [star(100, 10, 300, rng), star(100, 10, 90, rng, 0.1, 0.3), star(100.2, 10.1, 40, rng, 0.05, 0.2)]), ("lake", [star(101, 11, 60, rng)]),
              ("spike", [[(99.0, 9.0), (101.0, 9.001), (99.0, 9.002), (99.1, 9.001)]]), ("bow", [[(99.0, 9.0), (100.5, 10.5), (100.5, 9.0), (99.0, 10.5)]]),
              ("box", [[(99.5, 9.5), (100.503, 9.5), (100.503, 10.497), (99.5, 10.497)], [(99.7, 9.7), (99.9, 9.7), (99.9, 9.9), (99.7, 9.9)]]),
              ("tile", [[(100.01, 10.51), (100.03, 10.51), (100.03, 10.53), (100.01, 10.53)]]), ("far", [[(-50.0, -50.0), (-49.0, -50.0), (-50.0, -49.0)]]), ("none", [[]])]
    points = [(i, rng.uniform(98.9, 101.9), rng.uniform(8.9, 11.9)) for i in range(900)]
    points += [(2000 + i, 100.02 + rng.gauss(0, 0.01), 10.52 + rng.gauss(0, 0.01)) for i in range(400)]
    points += [(3000 + i, 100.1, 10.6) for i in range(300)] + [(None, 100.1, 10.6), (None, 99.62, 9.6), (3999, None, 10.0), (4000, 100.0, None), (10, *points[10][1:])]
    found = S.point_in_polygon_join(spark.createDataFrame(points, "id int, lon double, lat double"), spark.createDataFrame(
        [(f"{n}{k}", [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for k, (n, rings) in enumerate(shapes)], SHAPE),
        step=step, dense=dense, full=full, depth=depth, totals={"points": F.lit(1), "ids": F.col("id")})
    assert sorted(found.columns) == ["ids", "points", "poly"]
    want = {}
    for k, (n, rings) in enumerate(shapes):
        held = [i for i, x, y in points if x is not None and y is not None and rings[0] and inside(x, y, rings[0]) and not any(inside(x, y, h) for h in rings[1:])]
        if held:
            want[f"{n}{k}"] = (len(held), sum(i for i in held if i is not None))
    assert {r.poly: (r.points, r.ids) for r in found.collect()} == want and len(want) == 5


def test_sums_count_boundaries_and_keep_keys_apart(spark):
    rings = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]]
    places = [(4.0, 4.0), (0.0, 2.2), (3.3, 4.0), (1.0, 1.5), (1.5, 1.5), (3.0, 3.0), (4.0001, 2.0)]
    df = spark.createDataFrame([(g, 10**i, x, y) for g in "ab" for i, (x, y) in enumerate(places)], "g string, id long, lon double, lat double")
    polygons = spark.createDataFrame([(g, n, [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for g, n in [("a", "s"), ("a", "t"), ("c", "u")]], "g string, " + SHAPE)
    for step, full in ((1.0, 1024), (10.0, 1)):
        found = S.point_in_polygon_join(df, polygons, step=step, on=["g"], dense=2, full=full, depth=3, totals={"ids": F.col("id")})
        assert {(r.poly, r.ids) for r in found.collect()} == {("s", 101111), ("t", 101111)}


def test_scan_lines_give_the_cells_of_an_outline(spark):
    rng = random.Random(11)
    shapes = [("lake", [star(5, 5, 400, rng), star(5, 5, 80, rng, 0.1, 0.3)]), ("box", [[(1.05, 1.05), (2.0, 1.05), (2.0, 1.95), (1.05, 1.95)]]),
              ("u", [[(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (2.0, 3.0), (2.0, 1.0), (1.0, 1.0), (1.0, 3.0), (0.0, 3.0)]])]
    polygons = spark.createDataFrame([(n, [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for n, rings in shapes], SHAPE)
    got = {(r.poly, r.cx, r.cy) for r in S.rasterise(polygons, "poly", 0.1).collect()}
    want = set()
    for n, rings in shapes:
        if n == "box":  # its lower left centres lie on the boundary
            want |= {(n, cx, cy) for cx in range(10, 20) for cy in range(10, 20) if cy < 20 and (cy + 0.5) * 0.1 <= 1.95 + 1e-12}
            continue
        for cx in range(-1, 70):
            for cy in range(-1, 70):
                x, y = (cx + 0.5) * 0.1, (cy + 0.5) * 0.1
                if inside(x, y, rings[0]) and not any(inside(x, y, h) for h in rings[1:]):
                    want.add((n, cx, cy))
    assert got == want
