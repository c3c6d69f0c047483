"""Source and sink queries. Files they read are written from the given tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loamline.plans.registry import query
from loamline.session import shared_folder
from loamline.sources import readers as R
from loamline.sources import sinks as S


def scratch(t) -> str:
    return f"{shared_folder(t.spark)}/run-{uuid.uuid4().hex}"


def iso(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("s01_csv_scan", "", """
    select lpad(cast(c_custkey as varchar), 8, '0') as code, c_name as name,
        case when c_mktsegment = 'BUILDING' then null else c_mktsegment end as segment, c_acctbal as balance from customer""")
def _(t):
    path = scratch(t)
    t.customer.select(
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("code"), F.col("c_name").alias("name"),
        F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.col("c_acctbal").alias("balance")).write.csv(path, header=True, emptyValue="")
    return R.read_table(t.spark, path, "code string, name string, segment string, balance double")


@query("s02_feature_documents", "pts", """
    select cast(point_id as varchar) as id, lon, lat, cast(province as varchar) as province,
        cast(1 as bigint) as id_count from pts""")
def _(t):
    path = scratch(t)
    feature = F.struct(
        F.col("point_id").cast("string").alias("id"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
        F.struct(F.col("province").cast("string").alias("province")).alias("properties"))
    docs = t.pts.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))))
    docs.write.text(path)
    schema = StructType([StructField("province", StringType())])
    out = R.read_features(t.spark, path, schema)
    return out.select("id", F.col("point.lon").alias("lon"), F.col("point.lat").alias("lat"), "province", "id_count")


def outlines(t, path: str) -> None:
    """Collections of up to 40 features each: a point, a square with a square hole, or two squares, by point_id."""
    def square(x, y, size):
        corner = lambda dx, dy: F.array(F.col("lon") + x + dx * size, F.col("lat") + y + dy * size)
        return F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))

    shapes = [("Point", F.array("lon", "lat")), ("Polygon", F.array(square(-0.1, -0.1, 0.3), square(0.0, 0.0, 0.05))),
              ("MultiPolygon", F.array(F.array(square(0.0, 0.0, 0.02)), F.array(square(0.1, 0.0, 0.25))))]
    place = F.col("point_id") % 3
    # Strings with braces and quotes in them, which are no structure.
    named = F.struct(F.col("province").cast("string").alias("province"), F.concat(F.lit('a}{"\\'), F.col("point_id")).alias("note"))
    rows = t.pts.select("point_id", *[F.when(place == i, F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.col("point_id").cast("string").alias("id"), named.alias("properties"),
        F.struct(F.lit(kind).alias("type"), at.alias("coordinates")).alias("geometry")))).alias(kind) for i, (kind, at) in enumerate(shapes)])
    text = F.coalesce(*[F.col(kind) for kind, _ in shapes])
    docs = rows.groupBy(F.floor(F.col("point_id") / 40).alias("d")).agg(F.array_join(F.array_sort(F.collect_list(text)), ", ").alias("features"))
    docs.select(F.concat(F.lit('{"type": "FeatureCollection", "crs": {"type": "name"}, "features": ['), "features", F.lit("]}"))).write.text(path)


@query("s02_polygon_documents", "pts", """
    select cast(point_id as varchar) as id, case point_id % 3 when 0 then 'Point' when 1 then 'Polygon' else 'MultiPolygon' end as kind, cast(province as varchar) as province,
        'a}{"\\' || point_id as note, case when point_id % 3 = 0 then lon end as lon, cast(case point_id % 3 when 0 then 0 when 1 then 1 else 2 end as int) as parts,
        cast(case point_id % 3 when 0 then 0 when 1 then 8 else 8 end as bigint) as corners, round(cast(case point_id % 3 when 0 then 0 when 1 then 0.3 * 0.3 - 0.05 * 0.05 else 0.02 * 0.02 + 0.25 * 0.25 end as double), 6) as area from pts""")
def _(t):
    path = scratch(t)
    outlines(t, path)
    found = R.read_features(t.spark, path, StructType([StructField("province", StringType()), StructField("note", StringType())]))
    rings = R.polygon_rows(found).select("id", F.posexplode("rings").alias("ring", "r"))
    nxt = F.concat(F.slice("r", 2, F.size("r")), F.slice("r", 1, 1))
    twice = F.aggregate(F.arrays_zip(F.col("r").alias("a"), nxt.alias("b")), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))
    sizes = rings.groupBy("id").agg(F.sum(F.size("r")).alias("corners"), F.sum(F.when(F.col("ring") == 0, 1).otherwise(-1) * F.abs(twice) / 2).alias("area"))
    return found.join(sizes, "id", "left").select(
        "id", "kind", "province", "note", F.col("point.lon").alias("lon"), F.coalesce(F.size("parts"), F.lit(0)).alias("parts"),
        F.coalesce("corners", F.lit(0)).alias("corners"), F.round(F.coalesce("area", F.lit(0.0)), 6).alias("area"))


@query("s03_nested_daily_json", "daily", """
    with y as (select distinct province, year(day) as y from daily),
    g as (select province, cast(unnest(generate_series(make_date(cast(y as int), 1, 1), make_date(cast(y as int), 12, 31), interval 1 day)) as date) as day from y)
    select g.province, cast(g.day as varchar) as day, round(d.t_max, 6) as t_max,
        case when d.rain_mm = 0 then null else round(d.rain_mm, 6) end as rain from g left join daily d using (province, day)""")
def _(t):
    key = F.date_format("day", "yyyyMMdd")
    rain = F.when(F.col("rain_mm") == 0, -999.0).otherwise(F.col("rain_mm"))
    # One document per entity and year, as the provider sends it.
    docs = t.daily.groupBy("province", F.year("day").alias("y")).agg(
        F.map_from_entries(F.collect_list(F.struct(key, "t_max"))).alias("a"),
        F.map_from_entries(F.collect_list(F.struct(key, rain))).alias("b"))
    docs = docs.select("province", "y", F.to_json(F.struct(F.struct(F.struct(
        F.col("a").alias("TMAX"), F.col("b").alias("RAIN")).alias("parameter")).alias("properties"))).alias("payload"))
    first, last = F.make_date("y", F.lit(1), F.lit(1)), F.make_date("y", F.lit(12), F.lit(31))
    rows = R.decode_param_map(docs, "payload", ["TMAX", "RAIN"], first, last)
    return rows.select("province", F.col("day").cast("string").alias("day"), F.round("TMAX", 6).alias("t_max"),
                       F.round("RAIN", 6).alias("rain"))


@query("s04_nested_monthly_json", "month", """
    select cast(province as bigint) as province, cast(year_ce as bigint) as year, cast(month as bigint) as month,
        cast(day(last_day(make_date(cast(year_ce as int), cast(month as int), 1))) as bigint) as days, round(tonnes, 6) as rate,
        round(tonnes * day(last_day(make_date(cast(year_ce as int), cast(month as int), 1))), 6) as total from month""")
def _(t):
    key = F.concat(F.col("year_ce").cast("string"), F.lpad(F.col("month").cast("string"), 2, "0"))
    annual = F.concat(F.col("year_ce").cast("string"), F.lit("13"))
    docs = t.month.groupBy("province", "year_ce").agg(
        F.collect_list(F.struct(key.alias("k"), F.col("tonnes").alias("v"))).alias("e"), F.sum("tonnes").alias("s"),
        F.first(annual).alias("k13"))
    docs = docs.withColumn("m", F.map_from_entries(F.concat("e", F.array(F.struct(F.col("k13").alias("k"), F.col("s").alias("v"))))))
    docs = docs.select("province", F.to_json(F.struct(F.struct(F.struct(F.col("m").alias("RATE")).alias("parameter"))
                                                      .alias("properties"))).alias("payload"))
    rows = R.decode_monthly(docs, "payload", ["RATE"], {"RATE": "total"})
    return rows.select(*[F.col(c).cast("long").alias(c) for c in ("province", "year", "month", "days")],
                       F.round("RATE", 6).alias("rate"), F.round("total", 6).alias("total"))


@query("s05_ingest_payload", "sensor", """
    select case when event_id % 3 = 0 then cast(device_id as varchar) || ':' || strftime(recorded_at, '%Y-%m-%dT%H:%M:%SZ')
            else 'ev-' || event_id end as event_id, cast(device_id as varchar) as device_id,
        strftime(recorded_at, '%Y-%m-%d %H:%M:%S') as recorded_at, case when sig1 <> 'error' then soil end as soil,
        temp_c from sensor""")
def _(t):
    stamp = F.date_format("recorded_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    soil = F.when(F.col("sig1") == "error", F.concat(F.lit('"'), F.col("soil"), F.lit('"'))).otherwise(
        F.col("soil").cast("string"))
    event = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit('"event_id":"ev-'), F.col("event_id"), F.lit('",')))
    payload = F.concat(F.lit("{"), event, F.lit('"device_id":"'), F.col("device_id"), F.lit('","recorded_at":"'), stamp,
                       F.lit('","soil":'), soil, F.lit(',"temp":'), F.col("temp_c"), F.lit(',"forecast":[1,2],"flag":true}'))
    out = R.flatten_payload(t.sensor.select(payload.alias("payload")), "payload",
                            {"soil": "$.soil", "temp_c": "$.temp", "flag": "$.flag"})
    return out.select("event_id", "device_id", iso("recorded_at").alias("recorded_at"), "soil", "temp_c").where(
        F.col("event_id").isNotNull())


@query("s06_html_tables", "", """
    with r as (select page_id, regexp_extract_all(html, '<li>.*?</li>') as items from pages),
    u as (select page_id, unnest(items) as item, generate_subscripts(items, 1) - 1 as row_no from r)
    select page_id, cast(row_no as bigint) as row_no, cast(0 as bigint) as cell_no,
        trim(regexp_replace(regexp_replace(item, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) as cell from u""")
def _(t):
    html = F.col("html")
    for a, b in (("<ul>", "<table>"), ("</ul>", "</table>"), ("<li>", "<tr><td>"), ("</li>", "</td></tr>")):
        html = F.replace(html, F.lit(a), F.lit(b))
    out = R.html_rows(t.pages.select("page_id", html.alias("html")), "html")
    return out.select("page_id", F.col("row_no").cast("long"), F.col("cell_no").cast("long"), "cell")


@query("s06_html_unknown", "", "select page_id, true as unknown from pages where html not ilike '%<table%'")
def _(t):
    out = R.html_rows(t.pages.select("page_id", "html"), "html")
    return out.groupBy("page_id").agg(F.bool_and(F.col("cell").isNull()).alias("unknown")).where("unknown")


@query("s07_index_text", "month", """
    select cast(province as bigint) as file, cast(year_ce as bigint) as year, cast(month as bigint) as month,
        round(tonnes / 10000, 3) as value,
        case when tonnes / 10000 > 10 then 'value' when lag(year_ce * 12 + month) over (partition by province order by year_ce, month) <> year_ce * 12 + month - 1
             then 'sequence' end as problem from month""")
def _(t):
    season = F.element_at(F.array(*[F.lit(s) for s in R.SEASONS]), F.col("month"))
    line = F.concat_ws("   ", season, F.col("year_ce"), F.round(F.col("tonnes") / 10000, 3))
    body = t.month.select(F.col("province").cast("long").alias("file"),
                          (F.col("year_ce") * 12 + F.col("month")).alias("line_no"), line.alias("line"))
    head = t.month.select(F.col("province").cast("long").alias("file")).distinct().select(
        "file", F.lit(0).alias("line_no"), F.lit(" SEAS  YR   ANOM").alias("line"))
    out = R.parse_index(body.unionByName(head), "file", "line_no", "line")
    return out.select("file", F.col("year").cast("long"), F.col("month").cast("long"), F.round("value", 3).alias("value"), "problem")


@query("s08_registry_lines", "", """
    select c_custkey as source_no, n_name || ' east' as place, 'AC' || c_custkey || '-' || c_nationkey as code, 'row' as kind
    from customer join nation on n_nationkey = c_nationkey where c_mktsegment <> 'MACHINERY'
    union all select null, null, cast(count(*) as varchar), 'failed' from customer where c_mktsegment = 'MACHINERY'""")
def _(t):
    rows = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    good = F.concat_ws(" ", F.lit(" "), "c_custkey", "n_name", F.lit("  east  AC "), "c_custkey", F.lit("-"), "c_nationkey")
    bad = F.concat(F.lit(" "), F.col("c_custkey"), F.lit(" AC"))
    lines = rows.select(F.when(F.col("c_mktsegment") == "MACHINERY", bad).otherwise(good).alias("line"))
    parsed, failed = R.parse_registry(lines, "line")
    summary = failed.agg(F.lit(None).cast("long").alias("source_no"), F.lit(None).cast("string").alias("place"),
                         F.count("*").cast("string").alias("code"), F.lit("failed").alias("kind"))
    return parsed.withColumn("kind", F.lit("row")).unionByName(summary)


@query("s09_range_scan", "sensor", """
    with r as (select *, row_number() over (partition by device_id order by recorded_at desc, event_id desc) as n,
            count(*) over (partition by device_id) as c
        from sensor where recorded_at between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-20 00:00:00')
    select device_id, event_id, soil, c > 25 as truncated from r where n <= 25""")
def _(t):
    start, stop = F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    twice = t.sensor.unionByName(t.sensor)
    return R.newest_per_device(twice, start, stop, 25).select("device_id", "event_id", "soil", "truncated")


@query("s10_recover_quality", "sensor", """
    select event_id, valid, cast(age_sec as double) as age_sec, sig1 <> 'signup' as quality_metadata_available
    from (select event_id, sig1, case when sig1 <> 'signup' then valid end as valid, case when sig1 <> 'signup' then age_sec end as age_sec from sensor)""")
def _(t):
    known = F.col("sig1") != "signup"
    raw = F.when(known, F.to_json(F.struct("valid", F.col("age_sec").alias("age")))).otherwise(F.lit("{}"))
    column = F.when((F.col("sig1") != "click") & known, F.col("valid"))
    rows = t.sensor.select("event_id", raw.alias("payload"), column.alias("valid"))
    out = R.recover_quality(rows, "payload", {"valid": ("$.valid", "boolean"), "age_sec": ("$.age", "double")})
    return out.drop("payload")


@query("s11_write_once", "", """
    select *, true as refused_second_write from (select c_nationkey as nation, cast(count(*) as bigint) as customers from customer group by c_nationkey)""")
def _(t):
    path = scratch(t)
    counts = t.customer.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    S.write_once(counts, path)
    try:
        S.write_once(counts, path)
        refused = False
    except Exception as error:
        refused = "PATH_ALREADY_EXISTS" in str(error)
    return t.spark.read.parquet(path).withColumn("refused_second_write", F.lit(refused))


@query("s12_keyed_upsert", "log", """
    select record_id, version, case when version = 0 or role = 'assistant' then v + 1000 else v end as v
    from (select record_id, version, owner as role, v from log)
    union all select record_id + 1000000, version, v from log where version = 0""")
def _(t):
    target = t.log.select("record_id", "version", "v")
    changed = t.log.where((F.col("version") == 0) | (F.col("owner") == "assistant"))
    updates = changed.select("record_id", "version", (F.col("v") + 1000).alias("v")).unionByName(
        t.log.where("version = 0").select((F.col("record_id") + 1000000).alias("record_id"), "version", "v"))
    path = scratch(t)
    target.write.partitionBy("version").parquet(path)
    S.upsert_table(t.spark, path, updates, ["record_id", "version"], "version")
    return t.spark.read.parquet(path).select("record_id", F.col("version").cast("long").alias("version"), "v")


@query("s13_manifest")
def _(t):
    now = S.file_digests(t.spark, t.folder, "*.parquet")
    edited = now.where("name <> 'region.parquet'").withColumn(
        "sha256", F.when(F.col("name") == "nation.parquet", F.lit("0" * 64)).otherwise(F.col("sha256")))
    extra = now.limit(1).select(F.lit("absent.parquet").alias("name"), F.lit("1" * 64).alias("sha256"))
    return S.verify_manifest(t.spark, t.folder, edited.unionByName(extra), "*.parquet")


@query("s14_retention", "sensor", """
    select device_id, cast(count(*) filter (recorded_at >= timestamp '2024-01-16 00:00:00') as bigint) as kept,
        cast(count(*) filter (recorded_at < timestamp '2024-01-16 00:00:00') as bigint) as removed from sensor group by device_id""")
def _(t):
    kept, _ = S.retention(t.sensor, "recorded_at", 15, "2024-01-31 00:00:00")
    left = kept.groupBy("device_id").agg(F.count("*").alias("kept"))
    total = t.sensor.groupBy("device_id").agg(F.count("*").alias("n"))
    return total.join(left, "device_id", "left").select(
        "device_id", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("n") - F.coalesce("kept", F.lit(0))).alias("removed"))


@query("s14_retention_preview", "sensor", """
    select cast(count(*) filter (recorded_at >= timestamp '2024-01-16 00:00:00') as bigint) as kept,
        cast(count(*) filter (recorded_at < timestamp '2024-01-16 00:00:00') as bigint) as removed from sensor""")
def _(t):
    return S.retention(t.sensor, "recorded_at", 15, "2024-01-31 00:00:00")[1]


@query("s15_export_inventory", "vint", """
    select field, cast(count(*) as bigint) as rows, strftime(min(v), '%Y-%m-%d %H:%M:%S') as first, strftime(max(v), '%Y-%m-%d %H:%M:%S') as last,
        cast(count(v) as bigint) as present, cast(8 as bigint) as columns
    from (select 'issued' as field, issued as v from vint union all select 'received', received from vint
          union all select 'valid', case when rain_mm > 0 then valid end from vint) group by field""")
def _(t):
    rows = t.vint.withColumn("valid", F.when(F.col("rain_mm") > 0, F.col("valid")))
    tall, _ = R.export_inventory(rows, ["issued", "received", "valid"], "source")
    return tall.withColumn("columns", F.col("columns").cast("long"))
