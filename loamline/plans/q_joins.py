"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamline.operators import joins as J
from loamline.operators import windows as W
from loamline.operators.features import district_evidence, month_union
from loamline.plans.q_windows import EPISODES, GAP, day, ints, series, ts
from loamline.plans.registry import query


def nations(t):
    return t.nation.select(F.col("n_nationkey").alias("province"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))


@query("j01_checked_join", "year", """
    select cast(province as bigint) as province, cast(year_ce as bigint) as year_ce, n_name as name, round(production, 6) as production
    from year join nation on n_nationkey = province""")
def _(t):
    out = J.checked_join(t.year, nations(t), ["province"], "inner", "m:1")
    return out.select(*ints("province", "year_ce"), "name", F.round("production", 6).alias("production"))


@query("j02_left_with_flag", "year month", """
    select cast(y.province as bigint) as province, cast(y.year_ce as bigint) as year_ce, round(m.tonnes, 6) as january, m.tonnes is not null as january_known
    from year y left join month m on m.province = y.province and m.year_ce = y.year_ce and m.month = 1 and m.tonnes > 800""")
def _(t):
    january = t.month.where("month = 1 and tonnes > 800").select("province", "year_ce", F.col("tonnes").alias("january"))
    out = J.left_with_flag(t.year, january, ["province", "year_ce"], "january_known")
    return out.select(*ints("province", "year_ce"), F.round("january", 6).alias("january"), "january_known")


@query("j03_lookup_report", "", """
    select cast(o_custkey as bigint) as custkey, cast(count(*) as bigint) as rows, 'unmatched' as kind from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0) group by o_custkey
    union all select null, cast(count(*) as bigint), 'matched' from orders join customer on o_custkey = c_custkey where c_acctbal > 0""")
def _(t):
    lookup = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("custkey"), "c_name")
    matched, unmatched = J.lookup_or_report(t.orders.select(F.col("o_custkey").alias("custkey")), lookup, ["custkey"])
    total = matched.agg(F.lit(None).cast("long").alias("custkey"), F.count("*").alias("rows"), F.lit("matched").alias("kind"))
    return unmatched.withColumn("kind", F.lit("unmatched")).unionByName(total)


@query("j04_entity_period_grid", "year", """
    select cast(province as bigint) as province, cast(p as bigint) as period from (select distinct province from year) cross join generate_series(1990, 2001) g(p)""")
def _(t):
    return J.grid(t.year.select("province").distinct(), "period", F.lit(1990), F.lit(2001)).select(*ints("province", "period"))


@query("j05_key_union", "month", """
    with a as (select province, year_ce, month, tonnes from month where month <= 7), b as (select province, year_ce, month, tonnes from month where month >= 5)
    select cast(coalesce(a.province, b.province) as bigint) as province, cast(coalesce(a.year_ce, b.year_ce) as bigint) as year_ce, cast(coalesce(a.month, b.month) as bigint) as month,
        round(a.tonnes, 6) as weather, round(b.tonnes, 6) as harvest, round(p.tonnes, 6) as lag_weather
    from a full join b on a.province = b.province and a.year_ce = b.year_ce and a.month = b.month
    left join a p on p.province = coalesce(a.province, b.province) and p.year_ce * 12 + p.month = coalesce(a.year_ce, b.year_ce) * 12 + coalesce(a.month, b.month) - 1""")
def _(t):
    a = t.month.where("month <= 7").select("province", "year_ce", "month", F.col("tonnes").alias("weather"))
    b = t.month.where("month >= 5").select("province", "year_ce", "month", F.col("tonnes").alias("harvest"))
    out = month_union(a, b, ["province"], "year_ce", "month", ["weather"])
    return out.select(*ints("province", "year_ce", "month"), *[F.round(c, 6).alias(c) for c in ("weather", "harvest", "lag_weather")])


@query("j06_previous_period", "year", """
    select cast(a.province as bigint) as province, cast(a.year_ce as bigint) as year_ce, round(a.yield_v - b.yield_v, 6) as change
    from year a join year b on a.province = b.province and b.year_ce = a.year_ce - 1""")
def _(t):
    out = J.prev_period_join(t.year, ["province"], "year_ce", ["yield_v"])
    return out.select(*ints("province", "year_ce"), F.round(F.col("yield_v") - F.col("previous_yield_v"), 6).alias("change"))


@query("j07_season_pairs", "year", """
    with r as (select province, year_ce, cast(round(area * 10) as bigint) as kg, cast(10 * (province % 3 + 1) as bigint) as ha, case when year_ce % 3 = 0 then 'a' else 'b' end as cultivar, province <> 5 or year_ce <> 1997 as complete from year)
    select cast(c.province as bigint) as province, cast(c.year_ce as bigint) as year_ce, cast(case when c.kg * p.ha > p.kg * c.ha then 1 when c.kg * p.ha < p.kg * c.ha then 0 end as bigint) as increase_label,
        c.cultivar <> p.cultivar as cultivar_changed from r c join r p on c.province = p.province and p.year_ce = c.year_ce - 1 where c.complete and p.complete""")
def _(t):
    rows = t.year.select(
        F.col("province").cast("string").alias("orchard"), F.lit("main").alias("season"), F.col("year_ce").alias("harvest_year"),
        (F.round("area") * 10).cast("decimal(19,6)").alias("harvested_kg"), (10 * (F.col("province") % 3 + 1)).cast("decimal(19,6)").alias("bearing_area"),
        F.when(F.col("year_ce") % 3 == 0, "a").otherwise("b").alias("cultivar"),
        F.when((F.col("province") == 5) & (F.col("year_ce") == 1997), "draft").otherwise("complete").alias("status"))
    out = J.season_pairs(rows)
    return out.select(F.col("orchard").cast("long").alias("province"), F.col("harvest_year").cast("long").alias("year_ce"),
                      F.col("increase_label").cast("long").alias("increase_label"), "cultivar_changed")


ASOF = """
    with d as (select province, start_date, count(*) as n, min(doc_id) as doc_id, min(state) as state from ord group by all),
    l as (select doc_id as id, province, end_date, max_start from (select o.doc_id, o.province, o.end_date, (select max(d.start_date) from d where d.province = o.province and d.start_date {op} o.end_date) as max_start from ord o))
    select l.id, case when max_start is null then 'none' when d.n > 1 then 'ambiguous' when date_diff('day', max_start, end_date) > 1 then 'stale' else 'ok' end as status,
        case when d.n = 1 and date_diff('day', max_start, end_date) <= 1 then cast(max_start as varchar) end as document_day,
        case when d.n = 1 and date_diff('day', max_start, end_date) <= 1 then d.doc_id end as document_id
    from l left join d on d.province = l.province and d.start_date = l.max_start"""


def _asof(t, strict):
    left = t.ord.select("province", F.col("doc_id").alias("id"), "end_date")
    right = t.ord.select("province", "start_date", "doc_id")
    out = J.asof_join(left, right, ["province"], "end_date", "start_date", 86400, strict, ["doc_id"], slice_seconds=90 * 86400)
    return out.select("id", F.col("asof_status").alias("status"), F.col("asof_start_date").cast("string").alias("document_day"),
                      F.col("asof_doc_id").alias("document_id"))


@query("j08_asof_strict", "ord", ASOF.format(op="<"))
def _(t):
    return _asof(t, True)


@query("j08_asof_inclusive", "ord", ASOF.format(op="<="))
def _(t):
    return _asof(t, False)


@query("j08_asof_global", "ord sensor", """
    with d as (select start_date + interval 9125 day as pub, count(*) as n, max(state) as state from ord group by all)
    select event_id, case when m is null then 'none' when d.n > 1 then 'ambiguous' else 'ok' end as status from (select s.event_id, (select max(pub) from d where pub < s.recorded_at) as m from sensor s)
    left join d on d.pub = m""")
def _(t):
    docs = t.ord.select(F.date_add("start_date", 9125).cast("timestamp_ntz").alias("pub"), "state")
    left = t.sensor.select("event_id", "recorded_at")
    out = J.asof_join(left, docs, [], "recorded_at", "pub", 100 * 365 * 86400, True, ["state"])
    return out.select("event_id", F.col("asof_status").alias("status"))


@query("j09_vintage_asof", "vint", """
    with o as (select distinct location, valid - interval 1 hour as origin from vint),
    r as (select o.location, o.origin, v.issued, v.source, v.issue_id, v.valid, greatest(v.issued, v.received) as av, v.rain_mm, v.temp_c
        from o join vint v on v.location = o.location and v.valid > o.origin and v.valid <= o.origin + interval 3 hour
            and greatest(v.issued, v.received) <= o.origin and greatest(v.issued, v.received) >= o.origin - interval 24 hour),
    b as (select location, origin, issued, source, count(*) n, count(distinct valid) h, max(rain_mm) rain, max(temp_c) temp, max(av) av from r group by all),
    k as (select *, row_number() over (partition by location, origin order by issued desc, source) as rn from b where n = 3 and h = 3)
    select o.location, strftime(o.origin, '%Y-%m-%d %H:%M:%S') as origin, strftime(k.issued, '%Y-%m-%d %H:%M:%S') as issued, k.source, k.rain as rain_max, k.temp as temp_max,
        strftime(k.av, '%Y-%m-%d %H:%M:%S') as available from o left join k on k.location = o.location and k.origin = o.origin and k.rn = 1""")
def _(t):
    origins = t.vint.select("location", (F.col("valid") - F.expr("interval 1 hour")).alias("origin")).distinct()
    out = J.vintage_asof(origins, t.vint, ["location"], "origin", 3, 24, {"rain_max": F.max("rain_mm"), "temp_max": F.max("temp_c")}, ["rain_mm", "temp_c"])
    return out.select("location", ts("origin").alias("origin"), ts("issued").alias("issued"), "source", "rain_max", "temp_max",
                      ts("forecast_available").alias("available"))


@query("j10_interval_exposure", "ord", """
    with w as (select province, y, make_date(cast(y as int), 3, 1) as a, make_date(cast(y as int), 6, 1) as b from (select distinct province, year(start_date) as y from ord)),
    x as (select w.province, w.y, date_diff('day', a, b) as len, greatest(0, date_diff('day', greatest(a, start_date), least(b, end_date + 1))) as ov, v from w left join ord o on o.province = w.province and o.start_date < w.b and o.end_date >= w.a)
    select cast(province as bigint) as province, cast(y as bigint) as year, cast(coalesce(sum(ov), 0) as bigint) as overlap_days, round(100.0 * coalesce(sum(ov), 0) / max(len), 4) as coverage_pct,
        round(case when 100.0 * sum(ov) / max(len) >= 50 then sum(ov * v) / sum(ov) end, 4) as mean_value from x group by province, y""")
def _(t):
    w = t.ord.select("province", F.year("start_date").alias("year")).distinct().withColumns(
        {"a": F.make_date("year", F.lit(3), F.lit(1)), "b": F.make_date("year", F.lit(6), F.lit(1))})
    out = J.interval_exposure(w, t.ord, ["province"], ["year"], "a", "b", "v", "start_date", "end_date")
    return out.select(*ints("province", "year", "overlap_days"), F.round("coverage_pct", 4).alias("coverage_pct"), F.round("mean_value", 4).alias("mean_value"))


@query("j11_band_around_peak", "sensor", EPISODES + """
    select e.device_id, strftime(peak_at, '%Y-%m-%d %H:%M:%S') as peak_at, cast(count(s.event_id) as bigint) as rows, round(max(s.temp_c), 4) as max_temp,
        coalesce(bool_or(s.sig1 = 'error'), false) as error_near from e left join sensor s on s.device_id = e.device_id and s.recorded_at between peak_at - interval 3 hour and peak_at + interval 3 hour
    group by e.device_id, peak_at""")
def _(t):
    peaks = W.episodes(t.sensor, series(t), "soil", 50, GAP).select("device_id", "peak_at").distinct()
    out = J.around(peaks, t.sensor.select("device_id", "recorded_at", "temp_c", "sig1"), ["device_id"], "peak_at", "recorded_at", 3 * 3600, 3 * 3600, {
        "rows": F.count("*"), "max_temp": F.max("fact_temp_c"), "error_near": F.bool_or(F.col("fact_sig1") == "error")})
    return out.select("device_id", ts("peak_at").alias("peak_at"), "rows", F.round("max_temp", 4).alias("max_temp"), "error_near")


@query("j12_first_crossing", "sensor", """
    with l as (select *, coalesce(date_diff('microsecond', lag(recorded_at) over (partition by device_id order by recorded_at, event_id), recorded_at) > 43200000000, false) as gap from sensor),
    g as (select *, sum(case when gap then 1 else 0 end) over (partition by device_id order by recorded_at, event_id rows unbounded preceding) as gaps from l),
    p as (select * from g where soil >= 150), c as (select p.event_id, min(f.recorded_at) as first_at from p join g f on f.device_id = p.device_id and f.soil <= 20 and f.recorded_at > p.recorded_at and f.recorded_at <= p.recorded_at + interval 48 hour group by all)
    select p.event_id, strftime(c.first_at, '%Y-%m-%d %H:%M:%S') as crossed_at, round(date_diff('microsecond', p.recorded_at, c.first_at) / 3.6e9, 6) as hours_to_crossing, f.gaps > p.gaps as path_has_gap
    from p left join c on c.event_id = p.event_id left join g f on f.device_id = p.device_id and f.recorded_at = c.first_at""")
def _(t):
    s = series(t)
    out = J.first_after(t.sensor, s, F.col("soil") >= 150, F.col("soil") <= 20, 720 * 60, 48 * 3600)
    return out.select("event_id", ts("crossed_at").alias("crossed_at"), F.round("hours_to_crossing", 6).alias("hours_to_crossing"), "path_has_gap")


@query("j13_fixed_offsets", "sensor", """
    with h as (select device_id, date_trunc('hour', recorded_at) as hour_at, round(avg(soil), 6) as v from sensor group by all)
    select e.device_id, strftime(e.hour_at, '%Y-%m-%d %H:%M:%S') as hour_at, """ + ", ".join(
    f"max(case when f.hour_at = e.hour_at + interval {h} hour then f.v end) as v_{h}h" for h in (1, 2, 3, 6, 12, 24, 48)) + """
    from h e left join h f on f.device_id = e.device_id and f.hour_at > e.hour_at and f.hour_at <= e.hour_at + interval 48 hour where e.v >= 100 group by all""")
def _(t):
    hourly = t.sensor.groupBy("device_id", F.date_trunc("hour", "recorded_at").alias("hour_at")).agg(F.round(F.avg("soil"), 6).alias("v"))
    out = J.at_offsets(hourly.where("v >= 100").select("device_id", "hour_at"), hourly, ["device_id"], "hour_at", "v", [1, 2, 3, 6, 12, 24, 48])
    return out.withColumn("hour_at", ts("hour_at"))


@query("j14_missing_slots", "sensor", """
    with h as (select distinct device_id, date_trunc('hour', recorded_at) as s from sensor), b as (select device_id, min(s) lo, max(s) hi from h group by all),
    g as (select device_id, unnest(generate_series(lo, hi, interval 6 hour)) as s from b),
    m as (select device_id, count(*) as missing from g anti join h using (device_id, s) group by all), o as (select h.device_id, count(*) as off_grid from h anti join g using (device_id, s) group by all)
    select b.device_id, cast(coalesce(missing, 0) as bigint) as missing, cast(coalesce(off_grid, 0) as bigint) as off_grid from b left join m using (device_id) left join o using (device_id)""")
def _(t):
    hours = t.sensor.select("device_id", F.date_trunc("hour", "recorded_at").alias("slot_at")).distinct()
    missing, off = J.missing_slots(hours, ["device_id"], "slot_at", 6 * 3600)
    out = t.sensor.select("device_id").distinct()
    out = out.join(missing.groupBy("device_id").agg(F.count("*").alias("missing")), "device_id", "left")
    out = out.join(off.groupBy("device_id").agg(F.count("*").alias("off_grid")), "device_id", "left")
    return out.select("device_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("missing", "off_grid")])


@query("j14_keep_flagged_runs", "sensor", """
    with l as (select *, lag(sig1) over w as p1, lag(recorded_at) over w as pt from sensor window w as (partition by device_id order by recorded_at, event_id)),
    r as (select *, sum(case when sig1 = p1 and epoch_us(recorded_at) - epoch_us(pt) <= 43200000000 then 0 else 1 end) over (partition by device_id order by recorded_at, event_id rows unbounded preceding) as run from l)
    select event_id from r qualify date_diff('microsecond', min(recorded_at) over (partition by device_id, run), max(recorded_at) over (partition by device_id, run)) / 6e7 >= 360""")
def _(t):
    s = series(t)
    flagged = W.flatline_offline(t.sensor, s, ["sig1"], 360, GAP)
    runs = W.run_table(flagged, s).select("device_id", "run_start")
    return J.keep_flagged(flagged, runs, ["device_id", "run_start"]).select("event_id")


@query("j15_foreign_keys", "", """
    select cast(o_custkey as bigint) as custkey, cast(count(*) as bigint) as orphans from orders where o_custkey not in (select c_custkey from customer where c_mktsegment <> 'BUILDING') group by o_custkey""")
def _(t):
    child = t.orders.select(F.col("o_custkey").alias("custkey"))
    parent = t.customer.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("custkey"))
    return J.fk_check(child, parent, ["custkey"])


@query("j21_district_evidence", "part_area", """
    with d as (select province, sum(area) as bearing, sum(n) * 12.0 as production, string_agg(distinct code, ';' order by code) as codes from part_area group by all),
    s as (select s_nationkey as province, min(s_suppkey) as point from supplier where s_acctbal > 5000 group by all)
    select cast(d.province as bigint) as province, point as point_id, round(production * 1000 / bearing, 6) as calculated, abs(production * 1000 / bearing - (1140 + d.province)) > 20 as precision_warning, codes
    from d left join s on s.province = d.province""")
def _(t):
    documented = t.part_area.groupBy("province").agg(F.sum("area").alias("bearing"), (F.sum("n") * 12.0).alias("production")).withColumn(
        "reported", F.lit(1140) + F.col("province"))
    points = t.supplier.where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("province")).agg(F.min("s_suppkey").alias("point_id"))
    units = t.part_area.select("province", "code")
    out = district_evidence(documented, points, units, ["province"], "code", tol=20)
    return out.select(F.col("province").cast("long"), "point_id", F.round("calculated", 6).alias("calculated"), "precision_warning", F.col("units").alias("codes"))


@query("j22_period_report", "month ord", """
    with ph as (select * from (values ('flower', 1), ('flower', 2), ('fruit', 2), ('fruit', 3), ('fruit', 4), ('harvest', 5), ('harvest', 6)) p(phase, m)),
    e as (select province, year(start_date) as y, month(start_date) as m, count(*) as events from ord where state = '1-URGENT' group by all)
    select cast(a.province as bigint) as province, cast(a.year_ce as bigint) as year_ce, cast(a.month as bigint) as month, round(a.tonnes, 6) as tonnes,
        (select string_agg(phase, ',' order by phase) from ph where ph.m = a.month) as phases, cast(coalesce(e.events, 0) as bigint) as events,
        cast(count(*) over (partition by a.year_ce, a.month) as bigint) as entities, round(avg(a.tonnes) over (partition by a.year_ce, a.month), 6) as all_tonnes
    from month a left join e on e.province = a.province and e.y = a.year_ce and e.m = a.month""")
def _(t):
    phases = t.spark.createDataFrame([("flower", [1, 2]), ("fruit", [2, 3, 4]), ("harvest", [5, 6])], "phase string, months array<int>")
    events = t.ord.where("state = '1-URGENT'").select("province", F.col("start_date").alias("day"))
    out = J.period_report(t.month, phases, events, "province", "year_ce", "month")
    return out.select(*ints("province", "year_ce", "month"), F.round("tonnes", 6).alias("tonnes"), "phases", *ints("events", "entities"),
                      F.round("all_tonnes", 6).alias("all_tonnes"))


@query("j23_compare_entities", "daily", """
    select cast(a.day as varchar) as day, round(a.t_max, 6) as value_a, round(b.t_max, 6) as value_b, round(b.t_max - a.t_max, 6) as difference
    from daily a left join daily b on b.province = 3 and b.day = a.day where a.province = 1""")
def _(t):
    out = J.compare_entities(t.daily, "province", "day", "t_max", 1, 3)
    return out.select(day("day"), *[F.round(c, 6).alias(c) for c in ("value_a", "value_b", "difference")])
