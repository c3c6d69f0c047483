"""Point, polygon, cell and cluster operators without a geometry library.

Polygons are rows with ``rings``: array<array<struct<x, y>>>, the outer ring first, then holes. A
multipolygon is several rows with the same id. Edges are dealt to grid cells, so an outline of any size
is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions.climate import haversine_km
from loamline.functions.text import district_key
from loamline.operators.graph import connected
from loamline.session import cut_lineage, written

EDGE_TOLERANCE = 1e-11
# An edge belongs to a cell that it comes this near to, which is far more than the tolerance and rounding together.
MARGIN = 1e-9
# Where the reference point of a cell lies in it: the fractions of two square roots, so that no line through round
# coordinates meets it.
REF_X, REF_Y = 2**0.5 - 1, 3**0.5 - 1
# So many edges of one ring in a cell are tested without a lambda.
FEW = 4


def _edges(polygons: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per edge: ``keep``, _ring (0 is the outer one), ax, ay, bx, by. Rings are closed; corners that repeat the one
    before make no edge."""
    ring = polygons.select(*keep, F.posexplode("rings").alias("_ring", "_r"))
    ends = F.concat(F.slice("_r", 2, F.size("_r")), F.slice("_r", 1, 1))
    edge = ring.where(F.size("_r") > 1).select(*keep, "_ring", F.explode(F.arrays_zip(F.col("_r").alias("a"), ends.alias("b"))).alias("_e"))
    return edge.select(*keep, "_ring", F.col("_e.a.x").alias("ax"), F.col("_e.a.y").alias("ay"), F.col("_e.b.x").alias("bx"), F.col("_e.b.y").alias("by")).where(
        (F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by")))


def _cell(c: Column, width: float) -> Column:
    return F.floor(c / F.lit(width))


def _edge_cells(edges: DataFrame, width: float) -> DataFrame:
    """Each edge once per cell that it comes near: column by column, the rows that its part in the column spans."""
    low, high = F.least("ax", "bx"), F.greatest("ax", "bx")
    cols = edges.withColumn("_cx", F.explode(F.sequence(_cell(low - MARGIN, width), _cell(high + MARGIN, width))))
    slope = (F.col("by") - F.col("ay")) / F.nullif(F.col("bx") - F.col("ax"), F.lit(0.0))
    upright = F.col("ax") == F.col("bx")
    inside = lambda x: F.least(F.greatest(F.col("ay") + (x - F.col("ax")) * slope, F.least("ay", "by")), F.greatest("ay", "by"))
    left = F.when(upright, F.col("ay")).otherwise(inside(F.greatest(low, F.col("_cx") * F.lit(width) - MARGIN)))
    right = F.when(upright, F.col("by")).otherwise(inside(F.least(high, (F.col("_cx") + 1) * F.lit(width) + MARGIN)))
    return cols.withColumns({"_y0": F.least(left, right), "_y1": F.greatest(left, right)}).withColumn(
        "_cy", F.explode(F.sequence(_cell(F.col("_y0") - MARGIN, width), _cell(F.col("_y1") + MARGIN, width)))).drop("_y0", "_y1")


def _row_crossings(edges: DataFrame, width: float, at: float) -> DataFrame:
    """Where each edge crosses the scan line of each grid row: _cy and _x. The line of row cy is at (cy + at) * width; an
    edge counts its lower end and not its upper one, so that a corner is crossed once."""
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    first = F.ceil(low / F.lit(width) - at) - 1
    rows = edges.where("ay <> by").withColumn("_cy", F.explode(F.sequence(first, F.ceil(high / F.lit(width) - at))))
    line = (F.col("_cy") + at) * F.lit(width)
    return rows.where((F.col("ay") > line) != (F.col("by") > line)).withColumn(
        "_x", F.col("ax") + (line - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay")))


def _side(ax, ay, bx, by, x, y) -> Column:
    return (bx - ax) * (y - ay) - (by - ay) * (x - ax) > 0


def _crosses(px, py, rx, ry, ax, ay, bx, by) -> Column:
    """Does the way from p to r cross the edge from a to b? A corner on the way falls on one side for both of its edges."""
    return (_side(px, py, rx, ry, ax, ay) != _side(px, py, rx, ry, bx, by)) & (_side(ax, ay, bx, by, px, py) != _side(ax, ay, bx, by, rx, ry))


def _touches(x, y, e) -> Column:
    cross = (x - e["ax"]) * (e["by"] - e["ay"]) - (y - e["ay"]) * (e["bx"] - e["ax"])
    return ((F.abs(cross) < EDGE_TOLERANCE)
            & x.between(F.least(e["ax"], e["bx"]) - EDGE_TOLERANCE, F.greatest(e["ax"], e["bx"]) + EDGE_TOLERANCE)
            & y.between(F.least(e["ay"], e["by"]) - EDGE_TOLERANCE, F.greatest(e["ay"], e["by"]) + EDGE_TOLERANCE))


def _inside_cell(x, y, rx, ry) -> Column:
    """Even-odd test of a point against the edges in its cell: ``_es`` (bounded), ``_in``: rings that hold the cell's
    reference point. The outer boundary counts as inside, a hole's interior does not."""
    def odd(ring):
        crossed = F.size(F.filter("_es", lambda e: (e["_ring"] == ring) & _crosses(x, y, rx, ry, e["ax"], e["ay"], e["bx"], e["by"])))
        return (crossed % 2 == 1) != F.array_contains("_in", ring)

    on = lambda ring: F.exists("_es", lambda e: (e["_ring"] == ring) & _touches(x, y, e))
    holes = F.filter(F.array_union(F.transform("_es", lambda e: e["_ring"]), F.col("_in")), lambda r: r > 0)
    return (odd(F.lit(0)) | on(F.lit(0))) & ~F.exists(holes, lambda h: odd(h) & ~on(h))


def _few_edges(x, y) -> Column:
    """``_inside_cell`` for at most ``FEW`` edges of one ring, from plain columns that are never null: with lambdas or arrays Spark
    makes no code, or more than Java compiles. ``_rx``, ``_ry``: the reference point, ``_q``: the ring holds it."""
    sides = [{c: F.col(f"_{c}{k}") for c in ("ax", "ay", "bx", "by")} for k in range(FEW)]
    rx, ry = F.col("_rx"), F.col("_ry")
    more = lambda c: F.when(F.col("_k") > 1, c).otherwise(False)
    first, *others = [_crosses(x, y, rx, ry, *e.values()) for e in sides]
    odd = (first != F.col("_q")) != more(reduce(lambda a, b: a != b, others))
    first, *others = [_touches(x, y, e) for e in sides]
    on = first | more(reduce(lambda a, b: a | b, others))
    return (odd == (F.col("_ring") == 0)) | on


def _cell_sums(leaves: DataFrame, places: DataFrame, cells: DataFrame, key: Sequence[str], x, y, rx, ry, sums: Sequence[str]) -> DataFrame:
    """_pid, sums: of the places in each polygon. A cell without edges is all in or all out and adds its own sums; the places of
    the others are tested one by one, and no pair leaves its task."""
    added = lambda df: df.groupBy("_pid").agg(*[F.sum(c).alias(c) for c in sums])
    never_null = lambda c, other: F.coalesce(c, F.lit(other))
    rings, held = F.array_distinct(F.transform("_es", lambda e: e["_ring"])), F.col("_in")
    edged, ring = F.size("_es") > 0, F.get(rings, F.lit(0))
    few = (F.size("_es") <= FEW) & (F.size(rings) == 1)
    whole = leaves.where(~edged & F.array_contains(held, 0) & (F.size(held) == 1)).join(cells, list(key))
    # An edge that is not there lies at no place: nothing crosses or touches it.
    corner = {f"_{c}{k}": never_null(F.get("_es", F.lit(k))[c], float("inf")) for k in range(FEW) for c in ("ax", "ay", "bx", "by")}
    # The outer ring has to hold the cell if no edge of it is there, and no other hole may.
    plain = leaves.where(edged & few & ((ring == 0) | F.array_contains(held, 0)) & ~F.exists(held, lambda h: (h > 0) & (h != ring)))
    plain = plain.select(*key, "_pid", F.size("_es").alias("_k"), never_null(ring, 0).alias("_ring"), never_null(F.array_contains(held, ring), False).alias("_q"),
                         never_null(rx, 0.0).alias("_rx"), never_null(ry, 0.0).alias("_ry"), *[c.alias(n) for n, c in corner.items()])
    spots = places.select(*key, never_null(x, 0.0).alias("_x"), never_null(y, 0.0).alias("_y"), *sums)
    tested = plain.join(spots, list(key)).where(_few_edges(F.col("_x"), F.col("_y")))
    rest = leaves.where(edged & ~few).join(places, list(key)).where(_inside_cell(x, y, rx, ry))
    return reduce(DataFrame.unionByName, map(added, (whole, tested, rest)))


def point_in_polygon_join(points: DataFrame, polygons: DataFrame, lon: str = "lon", lat: str = "lat", step: float = 0.25,
                          on: Sequence[str] = (), dense: int = 32, depth: int = 12, totals: Mapping[str, Column] | None = None,
                          full: int = 1024) -> DataFrame:
    """Every (point, polygon) pair where the polygon holds the point; ``on`` adds equality keys.

    Edges, not rings, are dealt to the cells of a quadtree. The scan line of each grid row tells which cells have their
    reference point inside a ring; a point crosses only those edges of its own cell that lie between it and that
    reference point. A cell in which a polygon has more than ``dense`` edges is cut into four, whose reference points are
    reached from the old one in the same way, until it is sparse or ``depth`` cuts deep. So no row holds a ring, and a
    pair costs the edges of one cell. Cells without points are dropped at each level.

    ``totals`` (name: column of the points) asks for the sums over the points of each polygon row in place of the pairs, whose
    number grows with points times polygons. Points of one place are added up first, then those of each cell, and a cell
    that lies in the polygon as a whole gives its sum. A cell with an edge is cut while it has more than ``full``
    places, or a 64th of them if several rings or more than ``FEW`` edges meet there. So a polygon costs the cells
    along its outline, whose number grows with the square root of the points. Polygon rows without a point are left out.

    Points with null coordinates are in no polygon; a polygon row without corners holds none.
    """
    on, key = list(on), [*on, "_cx", "_cy"]
    shapes = cut_lineage(polygons.withColumn("_pid", F.monotonically_increasing_id()))
    edges = _edges(shapes, [*on, "_pid"])
    width, x, y = step, F.col(lon), F.col(lat)
    located = points.where(x.isNotNull() & y.isNotNull())
    sums = [f"_sum{i}" for i in range(len(totals or {}))]
    if totals:
        located = cut_lineage(located.groupBy(*on, x.alias(lon), y.alias(lat)).agg(*[F.sum(c).alias(s) for s, c in zip(sums, totals.values())]))
    located = located.withColumns({"_cx": _cell(x, width), "_cy": _cell(y, width)})
    taken = located.select(*key).distinct()
    near = cut_lineage(_edge_cells(edges, width).join(taken, key, "left_semi"))
    runs = _row_crossings(edges, width, REF_Y).select(*on, "_pid", "_ring", "_cy", "_x")
    order = Window.partitionBy(*on, "_pid", "_ring", "_cy").orderBy("_x")
    runs = runs.withColumns({"_to": F.lead("_x").over(order), "_n": F.row_number().over(order)}).where("_n % 2 = 1")
    first, last = (F.ceil(F.col(c) / F.lit(width) - REF_X) for c in ("_x", "_to"))
    held = runs.where(last > first).withColumn("_cx", F.explode(F.sequence(first, last - 1))).select(*key, "_pid", "_ring")
    held = cut_lineage(held.join(taken, key, "left_semi"))
    hits = []
    edge = F.struct("_ring", "ax", "ay", "bx", "by")
    for level in range(depth + 1):
        rx, ry = (F.col("_cx") + REF_X) * F.lit(width), (F.col("_cy") + REF_Y) * F.lit(width)
        whole = [*key, "_pid"]
        crowded = near.groupBy(*whole).agg(F.count("*").alias("_k"), F.min("_ring").alias("_r0"), F.max("_ring").alias("_r1"))
        if totals:
            cells = located.groupBy(*key).agg(F.count("*").alias("_m"), *[F.sum(s).alias(s) for s in sums])
            few = (F.col("_k") <= FEW) & (F.col("_r0") == F.col("_r1"))
            crowded = crowded.join(cells.select(*key, "_m"), key).where((F.col("_k") > dense) | (F.col("_m") > F.when(few, full).otherwise(full // 64)))
        else:
            crowded = crowded.where(F.col("_k") > dense)
        crowded = crowded.select(*whole)
        crowded = cut_lineage(crowded) if level < depth else crowded.where("false")
        leaves = near.join(crowded, whole, "left_anti").select(*whole, edge.alias("_e"), F.lit(None).cast("int").alias("_r")).unionByName(
            held.join(crowded, whole, "left_anti").select(*whole, F.lit(None).cast(near.select(edge.alias("_e")).schema["_e"].dataType).alias("_e"), F.col("_ring").alias("_r")))
        leaves = leaves.groupBy(*whole).agg(F.collect_list("_e").alias("_es"), F.collect_set("_r").alias("_in"))
        if totals:
            # Written once for the three joins, which also keeps their plans short.
            hits.append(_cell_sums(cut_lineage(leaves), located, cells, key, x, y, rx, ry, sums))
        else:
            hits.append(located.join(leaves, key).where(_inside_cell(x, y, rx, ry)).drop("_cx", "_cy", "_es", "_in"))
        if level == depth or crowded.isEmpty():
            break
        half = width / 2
        child = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
        sub = lambda df: df.join(crowded, whole, "left_semi").withColumn("_c", child).withColumns(
            {"_nx": 2 * F.col("_cx") + F.col("_c.i"), "_ny": 2 * F.col("_cy") + F.col("_c.j")})
        located = located.join(crowded.select(*key).distinct(), key, "left_semi").withColumns({"_cx": _cell(x, half), "_cy": _cell(y, half)})
        taken = located.select(*key).distinct()
        parts = sub(near)
        flip = _crosses((F.col("_nx") + REF_X) * F.lit(half), (F.col("_ny") + REF_Y) * F.lit(half), rx, ry, *map(F.col, ("ax", "ay", "bx", "by")))
        names = [*on, "_pid", "_ring", "_nx", "_ny"]
        turns = parts.where(flip).select(*names).unionByName(sub(held).select(*names))
        turned = turns.groupBy(*names).agg((F.count("*") % 2).alias("_t")).where("_t = 1").drop("_t")
        moved = {"_nx": "_cx", "_ny": "_cy"}
        held = cut_lineage(turned.withColumnsRenamed(moved).join(taken, key, "left_semi"))
        cx, cy, reach = (F.col("_nx") + 0.5) * F.lit(half), (F.col("_ny") + 0.5) * F.lit(half), half / 2 + MARGIN
        dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
        off = F.abs(dx * (cy - F.col("ay")) - dy * (cx - F.col("ax")))
        meets = (F.least("ax", "bx") <= cx + reach) & (F.greatest("ax", "bx") >= cx - reach) & (F.least("ay", "by") <= cy + reach) & (
            F.greatest("ay", "by") >= cy - reach) & (off <= (F.abs(dx) + F.abs(dy)) * reach * (1 + 1e-9))
        near = cut_lineage(parts.where(meets).drop("_c", "_cx", "_cy").withColumnsRenamed(moved).join(taken, key, "left_semi"))
        width = half
    found = reduce(DataFrame.unionByName, hits)
    if totals:
        found = found.groupBy("_pid").agg(*[F.sum(s).alias(name) for s, name in zip(sums, totals)])
    return found.join(shapes.drop("rings", *on), "_pid").drop("_pid")


def attribute_at_point(points: DataFrame, polygons: DataFrame, point_id: str, unit: Sequence[str],
                       registry_district: str | None = None, mapped_district: str | None = None,
                       step: float = 0.25) -> DataFrame:
    """The unit of the single distinct polygon unit at a point: mapped, ambiguous, not_mapped, or
    district_conflict when the registry names another district than the mapped unit."""
    hit = point_in_polygon_join(points.select(point_id, "lon", "lat"), polygons, step=step)
    packed = F.struct(*unit)
    units = hit.groupBy(point_id).agg(F.count_distinct(packed).alias("_n"), F.min(packed).alias("_unit"))
    out = points.join(units, point_id, "left")
    status = F.when(F.col("_n").isNull(), "not_mapped").when(F.col("_n") > 1, "ambiguous")
    if registry_district and mapped_district:
        named = F.coalesce(F.col(registry_district), F.lit("")) != ""
        status = status.when(
            named & (district_key(registry_district) != district_key(F.col("_unit")[mapped_district])), "district_conflict")
    out = out.withColumn("match_status", status.otherwise("mapped"))
    single = F.col("match_status") == "mapped"
    return out.select(*points.columns, "match_status", *[F.when(single, F.col("_unit")[c]).alias(f"mapped_{c}") for c in unit])


def nearest_assign(points: DataFrame, representatives: DataFrame, by: Sequence[str], rep_id: str) -> DataFrame:
    """Nearest representative of the same group by great-circle distance, ties by id.

    The representatives of a group are few by construction (at most sixteen) and travel as one array.
    """
    reps = representatives.groupBy(*by).agg(F.collect_list(F.struct(
        F.col(rep_id).alias("id"), F.col("lat").alias("lat"), F.col("lon").alias("lon"))).alias("_reps"))
    best = F.array_min(F.transform("_reps", lambda r: F.struct(
        haversine_km("lat", "lon", r["lat"], r["lon"]).alias("km"), r["id"].alias("id"))))
    out = points.join(reps, list(by), "left").withColumn("_best", best)
    return out.select(*points.columns, F.col("_best.id").alias("sample_id"), F.col("_best.km").alias("distance_km"))


def farthest_points(points: DataFrame, by: Sequence[str], point_id: str, k: int) -> DataFrame:
    """Deterministic farthest-point representatives per group, at most ``k`` <= 16, chosen for all groups at
    once: round by round, one aggregation finds the farthest point of every group.

    The first is nearest the coordinate mean; ties follow the id; a group stops at distance zero.
    """
    if not 1 <= k <= 16:
        raise ValueError("k must be 1..16")
    by = list(by)
    chosen = F.struct(F.col(point_id).alias("id"), "lat", "lon")
    centre = points.groupBy(*by).agg(F.avg("lat").alias("_la"), F.avg("lon").alias("_lo"))
    state = points.select(*by, point_id, "lat", "lon").join(centre, by)
    state = state.withColumn("_d", haversine_km("lat", "lon", "_la", "_lo")).drop("_la", "_lo")
    picked = state.groupBy(*by).agg(F.min_by(chosen, F.struct("_d", point_id)).alias("_pick"))
    reps = picked.select(*by, F.lit(1).alias("round"), "_pick")
    state = state.withColumn("_d", F.lit(float("inf")))
    for number in range(2, k + 1):
        latest = picked.select(*by, F.col("_pick.lat").alias("_la"), F.col("_pick.lon").alias("_lo"))
        state = state.join(latest, by).withColumn(
            "_d", F.least("_d", haversine_km("lat", "lon", "_la", "_lo"))).drop("_la", "_lo")
        if number % 4 == 0:
            # Keep the plan short; the reliable checkpoint survives executor loss.
            state = cut_lineage(state)
            reps = cut_lineage(reps)
        # -distance keeps ties on the smaller id.
        picked = state.where(F.col("_d") > 1e-9).groupBy(*by).agg(
            F.min_by(chosen, F.struct(-F.col("_d"), F.col(point_id))).alias("_pick"))
        reps = reps.unionByName(picked.select(*by, F.lit(number).alias("round"), "_pick"))
    return reps.select(*by, "round", F.col("_pick.id").alias(point_id), F.col("_pick.lat").alias("lat"),
                       F.col("_pick.lon").alias("lon"))


def representative_weights(assigned: DataFrame, by: Sequence[str]) -> DataFrame:
    """Assigned points, share of the group and largest distance per representative."""
    per = assigned.groupBy(*by, "sample_id").agg(
        F.count("*").alias("assigned_points"), F.max("distance_km").alias("max_distance_km"))
    total = per.groupBy(*by).agg(F.sum("assigned_points").alias("_t"))
    return per.join(total, list(by)).withColumn("weight", F.col("assigned_points") / F.col("_t")).drop("_t")


def rasterise(polygons: DataFrame, polygon_id: str, step: float) -> DataFrame:
    """Cells of a square grid whose centre lies in the polygon: (id, cx, cy, other columns), each once.

    One scan line runs through the cell centres of a row. The places where a ring crosses it, in order, open and close the
    ring; a cell is inside from an opening of the outer ring to its closing, but for what holes cover. Rows grow with the
    crossings and with the cells of the result, not with cells times corners. Centres on the outer boundary are inside,
    those on a hole's boundary too.
    """
    keep = [c for c in polygons.columns if c != "rings"]
    shapes = cut_lineage(polygons.withColumn("_pid", F.monotonically_increasing_id()))
    edges = _edges(shapes, ["_pid"])
    tol = EDGE_TOLERANCE
    crossings = _row_crossings(edges, step, 0.5).select("_pid", "_ring", "_cy", "_x")
    order = Window.partitionBy("_pid", "_ring", "_cy").orderBy("_x")
    runs = crossings.withColumns({"_to": F.lead("_x").over(order), "_n": F.row_number().over(order)}).where("_n % 2 = 1").drop("_n")
    # An edge that lies on the scan line is boundary as well.
    flat = edges.where(F.abs(F.col("ay") - F.col("by")) < tol).withColumn("_cy", F.round(F.col("ay") / step - 0.5).cast("long")).where(
        F.abs(F.col("ay") - (F.col("_cy") + 0.5) * F.lit(step)) < tol)
    flat = flat.select("_pid", "_ring", "_cy", F.least("ax", "bx").alias("_x"), F.greatest("ax", "bx").alias("_to"))
    outer = runs.unionByName(flat).where("_ring = 0")
    spread = lambda df, a, b: df.withColumns({"_a": a, "_b": b}).where("_a <= _b").select(
        "_pid", "_cy", F.explode(F.sequence("_a", "_b")).alias("_cx"))
    place = lambda c, e: F.col(c) / F.lit(step) - 0.5 + e / step
    cells = spread(outer, F.ceil(place("_x", -tol)), F.floor(place("_to", tol))).distinct()
    holes = spread(runs.where("_ring > 0"), F.floor(place("_x", tol)) + 1, F.ceil(place("_to", -tol)) - 1)
    bare = holes.join(flat.where("_ring > 0").transform(lambda d: spread(d, F.ceil(place("_x", -tol)), F.floor(place("_to", tol)))), ["_pid", "_cy", "_cx"], "left_anti")
    inside = cells.join(bare, ["_pid", "_cy", "_cx"], "left_anti")
    return inside.join(shapes.select("_pid", *keep), "_pid").select(*keep, F.col("_cx").alias("cx"), F.col("_cy").alias("cy")).distinct()


def cell_area(cy: Column, step: float) -> Column:
    """Area of a cell in square kilometres at its centre latitude."""
    side = F.lit(step * 6371.0088 * 3.141592653589793 / 180)
    return side * side * F.cos(F.radians((cy + 0.5) * step))


def grid_overlay(a_cells: DataFrame, b_cells: DataFrame, a_id: str, b_class: str, step: float) -> DataFrame:
    """Per (A record, B class): overlapping area; the null class is the part of A that B does not cover.

    Also the double-counted area: cells where several B records of the class meet the same A cell.
    """
    b = b_cells.groupBy("cx", "cy", b_class).agg(F.count("*").alias("_k"))
    joined = a_cells.select(a_id, "cx", "cy").join(b, ["cx", "cy"], "left").withColumn("_area", cell_area(F.col("cy"), step))
    return joined.groupBy(a_id, b_class).agg(
        F.count("*").alias("cells"), F.sum("_area").alias("area"),
        F.sum(F.when(F.col("_k") > 1, F.col("_area") * (F.col("_k") - 1)).otherwise(0.0)).alias("double_counted_area"))


def partition_qc(a_cells: DataFrame, b_cells: DataFrame, a_id: str, step: float, tol: float = 0.1) -> DataFrame:
    """Does layer B partition each A record? Covered plus uncovered equals the whole within the tolerance,
    no cell is counted twice, and how much of B lies outside every A record."""
    b = b_cells.groupBy("cx", "cy").agg(F.count("*").alias("_k"))
    area = cell_area(F.col("cy"), step)
    joined = a_cells.select(a_id, "cx", "cy").join(b, ["cx", "cy"], "left").withColumn("_area", area)
    per = joined.groupBy(a_id).agg(
        F.sum("_area").alias("whole"), F.sum(F.when(F.col("_k").isNotNull(), F.col("_area")).otherwise(0.0)).alias("covered"),
        F.sum(F.when(F.col("_k").isNull(), F.col("_area")).otherwise(0.0)).alias("uncovered"),
        F.sum(F.when(F.col("_k") > 1, F.col("_area") * (F.col("_k") - 1)).otherwise(0.0)).alias("double_counted"))
    outside = b.join(a_cells.select("cx", "cy").distinct(), ["cx", "cy"], "left_anti").withColumn("_area", area).agg(
        F.coalesce(F.sum("_area"), F.lit(0.0)).alias("outside"))
    sums = F.abs(F.col("covered") + F.col("uncovered") - F.col("whole")) <= tol
    return per.crossJoin(F.broadcast(outside)).withColumn(
        "ok", sums & (F.col("double_counted") <= tol) & (F.col("uncovered") <= tol))


def cell_weights(points: DataFrame, by: Sequence[str], value: Column, step: float = 0.25) -> DataFrame:
    """Share of each grid cell in its group; the weights of a group add to one."""
    cells = points.groupBy(*by, F.floor(F.col("lon") / step).alias("cx"), F.floor(F.col("lat") / step).alias("cy")).agg(
        F.sum(value).alias("amount"))
    total = cells.groupBy(*by).agg(F.sum("amount").alias("_t"))
    return cells.join(total, list(by)).withColumn("weight", F.col("amount") / F.col("_t")).drop("_t")


def bin_points(points: DataFrame, x: Column, y: Column, size: float) -> DataFrame:
    """Pixel-grid bins with their member count and centroid."""
    binned = points.withColumns({"bin_x": F.floor(x / size), "bin_y": F.floor(y / size)})
    return binned.groupBy("bin_x", "bin_y").agg(
        F.count("*").alias("members"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))


def world_pixel(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Web-Mercator pixel coordinates at a zoom level."""
    world = F.lit(256.0 * 2**zoom)
    phi = F.radians(lat)
    x = (lon + 180) / 360 * world
    y = (1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / F.lit(3.141592653589793)) / 2 * world
    return x, y


def linked_bins(groups: DataFrame, zoom: int, spacing: float) -> DataFrame:
    """(id, other): pairs of centroids closer than the spacing. Only the neighbouring cells of a spacing-wide grid meet."""
    x, y = world_pixel(F.col("lon"), F.col("lat"), zoom)
    placed = groups.withColumns({"x": x, "y": y})
    placed = placed.withColumns({"gx": F.floor(F.col("x") / spacing), "gy": F.floor(F.col("y") / spacing)})
    around = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    other = placed.withColumn("_n", F.explode(around)).select(
        F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"),
        (F.col("gx") + F.col("_n.dx")).alias("gx"), (F.col("gy") + F.col("_n.dy")).alias("gy"))
    return placed.join(other, ["gx", "gy"]).where(
        (F.col("id") != F.col("other")) & (F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")) < spacing)
    ).select("id", "other")


def merge_clusters(bins: DataFrame, zoom: int, spacing: float) -> DataFrame:
    """Merge centroids closer than the spacing until none are: connected groups take the smallest label,
    then member-weighted centroids are formed and compared again.

    Bins are bounded by the map area over the cell size, not by the number of points.
    """
    groups = written(bins.select(F.monotonically_increasing_id().alias("id"), "members", "lon", "lat"))
    while True:
        links = written(linked_bins(groups, zoom, spacing))
        if links.isEmpty():
            return groups
        label = F.coalesce("label", "id").alias("label")
        named = groups.join(connected(links), "id", "left").select(label, "members", "lon", "lat")
        groups = written(named.groupBy("label").agg(
            F.sum("members").alias("members"), (F.sum(F.col("lon") * F.col("members")) / F.sum("members")).alias("lon"),
            (F.sum(F.col("lat") * F.col("members")) / F.sum("members")).alias("lat")).withColumnRenamed("label", "id"))
