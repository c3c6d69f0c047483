"""Point, polygon, cell and cluster queries. The polygons are small literal layers in both engines."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loamline.operators import aggregates as A
from loamline.operators import spatial as S
from loamline.operators.graph import connected
from loamline.operators.windows import topk
from loamline.plans.q_sources import outlines, scratch
from loamline.plans.q_windows import ints
from loamline.plans.registry import query
from loamline.sources import readers as R

# (id, district, code, rings): a square with a hole, a concave shape, and a square that overlaps both.
POLYGONS = [
    ("A", "north", "s1", [[(100.4, 12.6), (101.2, 12.6), (101.2, 13.4), (100.4, 13.4)], [(100.7, 12.9), (100.9, 12.9), (100.9, 13.1), (100.7, 13.1)]]),
    ("B", "south", "s2", [[(101.0, 12.5), (101.8, 12.7), (101.5, 13.0), (101.9, 13.5), (101.1, 13.3)]]),
    ("C", "north", "s1", [[(100.9, 13.2), (101.3, 13.2), (101.3, 13.7), (100.9, 13.7)]]),
    ("C", "north", "s1", [[(100.0, 12.0), (100.3, 12.0), (100.3, 12.4), (100.0, 12.4)]]),
]
SHAPE = "poly string, district string, code string, rings array<array<struct<x: double, y: double>>>"


def polygons(t):
    return t.spark.createDataFrame(POLYGONS, SHAPE)


def _edge_values():
    rows = []
    for part, (poly, district, code, rings) in enumerate(POLYGONS):
        for ring_no, ring in enumerate(rings):
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                rows.append(f"('{poly}', '{district}', '{code}', {part}, {ring_no}, {x1}::double, {y1}::double, {x2}::double, {y2}::double)")
    return ", ".join(rows)


INSIDE = f"""
    with edges as (select * from (values {_edge_values()}) e(poly, district, code, part, ring, x1, y1, x2, y2)),
    rings as (select p.point_id, e.poly, e.district, e.code, e.part, e.ring, count(*) filter ((y1 > lat) <> (y2 > lat) and lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1 as odd from pts p cross join edges e group by all),
    hit as (select point_id, poly, district, code from rings group by point_id, poly, district, code, part having bool_or(odd and ring = 0) and not bool_or(odd and ring > 0))
"""


@query("j16_point_in_polygon", "pts", INSIDE + "select point_id, poly, district, code from hit")
def _(t):
    return S.point_in_polygon_join(t.pts, polygons(t)).select("point_id", "poly", "district", "code")


@query("j17_attribute_at_point", "pts", INSIDE + """
    , u as (select point_id, count(distinct district || code) as n, min(district) as district, min(code) as code from hit group by point_id),
    s as (select p.point_id, u.district, u.code, case when n is null then 'not_mapped' when n > 1 then 'ambiguous' when p.point_id % 3 = 0 and u.district <> 'north' then 'district_conflict' else 'mapped' end as match_status from pts p left join u on u.point_id = p.point_id)
    select point_id, match_status, case when match_status = 'mapped' then district end as mapped_district, case when match_status = 'mapped' then code end as mapped_code from s""")
def _(t):
    points = t.pts.withColumn("registry", F.when(F.col("point_id") % 3 == 0, "อ. north"))
    out = S.attribute_at_point(points, polygons(t), "point_id", ["district", "code"], "registry", "district")
    return out.select("point_id", "match_status", "mapped_district", "mapped_code")


@query("j16_polygons_from_documents", "pts", """
    with b as (select point_id as id, x, y, size, hole from (
        select point_id, lon - 0.1 as x, lat - 0.1 as y, 0.3 as size, 0.05 as hole from pts where point_id % 3 = 1
        union all select point_id, lon, lat, 0.02, 0 from pts where point_id % 3 = 2 union all select point_id, lon + 0.1, lat, 0.25, 0 from pts where point_id % 3 = 2))
    select cast(id as varchar) as id, cast(count(*) as bigint) as points, cast(sum(point_id) as bigint) as ids from b join pts
        on lon between x and x + size and lat between y and y + size and not (hole > 0 and lon > x + 0.1 and lon < x + 0.1 + hole and lat > y + 0.1 and lat < y + 0.1 + hole) group by id""")
def _(t):
    path = scratch(t)
    outlines(t, path)
    shapes = R.polygon_rows(R.read_features(t.spark, path, StructType([])))
    # Points off the grid of the corners, so that none lies on a side but for rounding.
    hits = S.point_in_polygon_join(t.pts.select("point_id", "lon", "lat"), shapes.select("id", "rings"), totals={"points": F.lit(1), "ids": F.col("point_id")})
    return hits.groupBy("id").agg(F.sum("points").alias("points"), F.sum("ids").alias("ids"))


KM = """2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(r.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(r.lat)) * pow(sin(radians(r.lon - p.lon) / 2), 2))))"""


@query("j18_nearest_representative", "pts", f"""
    with r as (select *, row_number() over (partition by province order by point_id) as n from pts),
    d as (select p.point_id, p.province, r.point_id as sample, {KM} as km from pts p join r on r.province = p.province and r.n <= 4)
    select point_id, arg_min(sample, struct_pack(k := km, i := sample)) as sample_id, round(min(km), 6) as distance_km from d group by point_id""")
def _(t):
    reps = topk(t.pts, ["province"], [F.col("point_id")], 4).select("province", F.col("point_id").alias("rep"), "lat", "lon")
    return S.nearest_assign(t.pts, reps, ["province"], "rep").select("point_id", "sample_id", F.round("distance_km", 6).alias("distance_km"))


def _cells(t):
    step = 0.1
    return t.pts.select(F.floor(F.col("lon") / step).alias("cx"), F.floor(F.col("lat") / step).alias("cy"), "source", "point_id")


BOXES = """
    with b as (select province, cast(floor(min(lon) / 0.1) as bigint) as x0, cast(floor(max(lon) / 0.1) as bigint) as x1, cast(floor(min(lat) / 0.1) as bigint) as y0, cast(floor(max(lat) / 0.1) as bigint) as y1, min(lon) lx, max(lon) hx, min(lat) ly, max(lat) hy from pts group by province),
    a as (select province, cx, cy, pow(0.1 * 6371.0088 * pi() / 180, 2) * cos(radians((cy + 0.5) * 0.1)) as area from b, generate_series(x0, x1) g(cx), generate_series(y0, y1) h(cy) where (cx + 0.5) * 0.1 between lx and hx and (cy + 0.5) * 0.1 between ly and hy),
    c as (select cast(floor(lon / 0.1) as bigint) as cx, cast(floor(lat / 0.1) as bigint) as cy, source, count(*) as k from pts group by all)
"""


def _boxes(t):
    b = A.bbox(t.pts, ["province"])
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("min_x", "min_y"), corner("max_x", "min_y"), corner("max_x", "max_y"), corner("min_x", "max_y"))
    return S.rasterise(b.select("province", F.array(ring).alias("rings")), "province", 0.1)


@query("j19_grid_overlay", "pts", BOXES + """
    select cast(a.province as bigint) as province, cast(c.source as bigint) as source, cast(count(*) as bigint) as cells, round(sum(area), 4) as area, round(sum(case when k > 1 then area * (k - 1) else 0 end), 4) as double_counted_area
    from a left join c on c.cx = a.cx and c.cy = a.cy group by all""")
def _(t):
    out = S.grid_overlay(_boxes(t), _cells(t), "province", "source", 0.1)
    return out.select(*ints("province", "source"), "cells", F.round("area", 4).alias("area"), F.round("double_counted_area", 4).alias("double_counted_area"))


@query("g01_pixel_bins", "pts", """
    with p as (select *, (lon + 180) / 360 * 256 * pow(2, 10) as x, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 256 * pow(2, 10) as y from pts)
    select cast(floor(x / 72) as bigint) as bin_x, cast(floor(y / 72) as bigint) as bin_y, cast(count(*) as bigint) as members, round(avg(lon), 9) as lon, round(avg(lat), 9) as lat from p group by all""")
def _(t):
    x, y = S.world_pixel(F.col("lon"), F.col("lat"), 10)
    return S.bin_points(t.pts, x, y, 72).select("bin_x", "bin_y", "members", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


@query("g01_merged_clusters")
def _(t):
    x, y = S.world_pixel(F.col("lon"), F.col("lat"), 10)
    return S.merge_clusters(S.bin_points(t.pts, x, y, 72), 10, 56).select("members", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


@query("g01_linked_bins", "pts", """
    with recursive p as (select *, (lon + 180) / 360 * 256 * pow(2, 10) as x, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 256 * pow(2, 10) as y from pts),
    b as (select cast(floor(x / 18) as bigint) as bin_x, cast(floor(y / 18) as bigint) as bin_y, avg(lon) as lon, avg(lat) as lat from p group by all),
    c as (select bin_x * 1048576 + bin_y as id, (lon + 180) / 360 * 256 * pow(2, 10) as x, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 256 * pow(2, 10) as y from b),
    e as (select i.id, o.id as other from c i join c o on i.id <> o.id and abs(i.x - o.x) < 14 and abs(i.y - o.y) < 14 and sqrt(pow(i.x - o.x, 2) + pow(i.y - o.y, 2)) < 14),
    r(id, reached) as (select id, id from e union select r.id, e.other from r join e on e.id = r.reached)
    select cast(c.id as bigint) as bin, cast(coalesce(min(r.reached), c.id) as bigint) as label from c left join r on r.id = c.id group by c.id""")
def _(t):
    x, y = S.world_pixel(F.col("lon"), F.col("lat"), 10)
    bins = S.bin_points(t.pts, x, y, 18).withColumn("id", F.col("bin_x") * 1048576 + F.col("bin_y"))
    labels = connected(S.linked_bins(bins, 10, 14))
    return bins.join(labels, "id", "left").select(F.col("id").alias("bin"), F.coalesce("label", "id").alias("label"))


@query("g02_cell_weights", "pts", """
    with c as (select province, cast(floor(lon / 0.25) as bigint) as cx, cast(floor(lat / 0.25) as bigint) as cy, count(*) as n from pts group by all)
    select cast(province as bigint) as province, cx, cy, cast(n as bigint) as amount, round(n / sum(n) over (partition by province), 9) as weight from c""")
def _(t):
    out = S.cell_weights(t.pts, ["province"], F.lit(1))
    return out.select(*ints("province", "cx", "cy", "amount"), F.round("weight", 9).alias("weight"))


@query("g03_partition_qc", "pts", BOXES + """
    , d as (select cx, cy, sum(k) as k from c group by all), o as (select coalesce(sum(pow(0.1 * 6371.0088 * pi() / 180, 2) * cos(radians((cy + 0.5) * 0.1))), 0) as outside from d anti join a using (cx, cy)),
    p as (select province, sum(area) as whole, sum(case when k is not null then area else 0 end) as covered, sum(case when k is null then area else 0 end) as uncovered, sum(case when k > 1 then area * (k - 1) else 0 end) as double_counted from a left join d using (cx, cy) group by province)
    select cast(province as bigint) as province, round(whole, 4) as whole, round(covered, 4) as covered, round(uncovered, 4) as uncovered, round(double_counted, 4) as double_counted, round(outside, 4) as outside, double_counted <= 0.1 and uncovered <= 0.1 as ok from p cross join o""")
def _(t):
    out = S.partition_qc(_boxes(t), _cells(t), "province", 0.1)
    return out.select(*ints("province"), *[F.round(c, 4).alias(c) for c in ("whole", "covered", "uncovered", "double_counted", "outside")], "ok")


@query("k07_farthest_points")
def _(t):
    reps = S.farthest_points(t.pts, ["province"], "point_id", 4)
    assigned = S.nearest_assign(t.pts, reps, ["province"], "point_id")
    out = S.representative_weights(assigned, ["province"])
    return out.select("province", "sample_id", "assigned_points", F.round("max_distance_km", 6).alias("max_distance_km"), F.round("weight", 9).alias("weight"))
