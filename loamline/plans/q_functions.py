"""Scalar function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamline.functions import arrays as A
from loamline.functions import climate as C
from loamline.functions import dates as D
from loamline.functions import text as X
from loamline.operators import joins as J
from loamline.plans.registry import query
from loamline.session import cut_lineage


def rnd(c, n: int = 6):
    return F.round(c, n)


@query("f01_vpd", "sensor", """
    select event_id, round(case when temp_c between -10 and 60 and rh between 0 and 100 then
        0.6108 * exp(17.27 * temp_c / (temp_c + 237.3)) * (1 - rh / 100) end, 6) as vpd_kpa from sensor""")
def _(t):
    return t.sensor.select("event_id", rnd(C.vpd("temp_c", "rh")).alias("vpd_kpa"))


@query("f02_daily_vpd", "daily", """
    select province, cast(day as varchar) as day,
        round(case when t_min <= t_max and t_min between -10 and 60 and t_max between -10 and 60 and rh between 0 and 100
            then (0.6108 * exp(17.27 * t_min / (t_min + 237.3)) + 0.6108 * exp(17.27 * t_max / (t_max + 237.3))) / 2
                 * (1 - rh / 100) end, 6) as vpd_kpa,
        case when t_min is null or t_max is null or rh is null then 'missing' when t_min > t_max then 'reversed_temperature'
             when not (t_min between -10 and 60 and t_max between -10 and 60 and rh between 0 and 100) then 'out_of_range'
        end as issue from daily""")
def _(t):
    return t.daily.select(
        "province", F.col("day").cast("string").alias("day"), rnd(C.daily_vpd("t_min", "t_max", "rh")).alias("vpd_kpa"),
        C.daily_vpd_issue("t_min", "t_max", "rh").alias("issue"))


@query("f03_et0", "daily", """
    with base as (select *, 0.6108 * exp(17.27 * t_min / (t_min + 237.3)) as e0,
        0.6108 * exp(17.27 * t_max / (t_max + 237.3)) as e1, (t_min + t_max) / 2 as tm, least(rh, 100) as h,
        least(solar, 40) as rn, 0.000665 * 101.3 as g from daily),
    parts as (select *, (e0 + e1) / 2 * (1 - h / 100) as vd,
        4098 * 0.6108 * exp(17.27 * tm / (tm + 237.3)) / power(tm + 237.3, 2) as d from base)
    select province, cast(day as varchar) as day, round(case when t_max >= t_min and rn >= -20 then greatest(0.0,
        (0.408 * d * rn + g * 900 / (tm + 273) * 2.0 * vd) / (d + g * (1 + 0.34 * 2.0))) end, 6) as et0_mm from parts""")
def _(t):
    value = C.et0("t_min", "t_max", F.least("rh", F.lit(100.0)), F.lit(2.0), F.least("solar", F.lit(40.0)), F.lit(101.3))
    return t.daily.select("province", F.col("day").cast("string").alias("day"), rnd(value).alias("et0_mm"))


@query("f04_cyclic_time", "sensor", """
    select event_id, round(sin(2 * pi() * hour(recorded_at + interval 7 hour) / 24), 6) as hour_sin,
        round(cos(2 * pi() * hour(recorded_at + interval 7 hour) / 24), 6) as hour_cos,
        round(sin(2 * pi() * dayofyear(recorded_at + interval 7 hour) / 365.25), 6) as doy_sin,
        round(cos(2 * pi() * dayofyear(recorded_at + interval 7 hour) / 365.25), 6) as doy_cos from sensor""")
def _(t):
    local = D.to_local("recorded_at", "Asia/Bangkok")
    hs, hc = C.cyclic(F.hour(local), 24)
    ds, dc = C.cyclic(F.dayofyear(local), 365.25)
    return t.sensor.select("event_id", rnd(hs).alias("hour_sin"), rnd(hc).alias("hour_cos"),
                           rnd(ds).alias("doy_sin"), rnd(dc).alias("doy_cos"))


@query("f05_thai_dates", "", """
    select o_orderkey as doc_id, cast(cast(o_orderdate as date) as varchar) as parsed,
        cast(year(o_orderdate) as bigint) as year_ce from orders""")
def _(t):
    day, month, year = F.dayofmonth("o_orderdate"), F.month("o_orderdate"), F.year("o_orderdate")
    be = D.ce_to_be(year)
    short = F.element_at(F.array(*[F.lit(m) for m in D.THAI_MONTHS_SHORT]), month)
    full = F.element_at(F.array(*[F.lit(m) for m in D.THAI_MONTHS_FULL]), month)
    form = F.col("o_orderkey") % 4
    text = (
        F.when(form == 0, F.concat_ws("-", day, short, F.substring(be.cast("string"), 3, 2)))
        .when(form == 1, F.concat_ws(" ", day, full, be))
        .when(form == 2, F.concat_ws("/", day, month, year))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")))
    return t.orders.select(F.col("o_orderkey").alias("doc_id"), D.thai_date(text).cast("string").alias("parsed"),
                           D.be_to_ce(be).cast("long").alias("year_ce"))


@query("f06_excel_serial", "", """
    select event_id, strftime(ts, '%Y-%m-%d %H:%M') as at, cast(true as boolean) as close from events""")
def _(t):
    serial = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86_400_000_000.0) + 25569
    return t.events.select(
        "event_id", F.date_format(D.excel_serial(serial), "yyyy-MM-dd HH:mm").alias("at"),
        (D.serial_error_seconds(serial, "ts") < 1).alias("close"))


@query("f07_season_bounds", "month", """
    with k as (select *, make_date(cast(year_ce as int), cast(month as int), 1) as c from month)
    select cast(province as bigint) as province, cast(year_ce as bigint) as year_ce, cast(month as bigint) as month,
        cast(cast(c - interval 1 month as date) as varchar) as season_start,
        cast(cast(c + interval 2 month - interval 1 day as date) as varchar) as season_end,
        cast(year(c - interval 2 month) as bigint) as key_year,
        cast(month(c - interval 2 month) as bigint) as key_month from k""")
def _(t):
    start, end = D.season_bounds("year_ce", "month")
    ky, km = D.completed_key(F.make_date("year_ce", "month", F.lit(15)))
    return t.month.select(
        *[F.col(c).cast("long").alias(c) for c in ("province", "year_ce", "month")],
        start.cast("string").alias("season_start"), end.cast("string").alias("season_end"),
        ky.cast("long").alias("key_year"), km.cast("long").alias("key_month"))


@query("f08_great_circle", "pts", """
    select point_id, round(2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(13.0 - lat) / 2), 2)
        + cos(radians(lat)) * cos(radians(13.0)) * pow(sin(radians(101.0 - lon) / 2), 2)))), 6) as km from pts""")
def _(t):
    return t.pts.select("point_id", rnd(C.haversine_km("lat", "lon", F.lit(13.0), F.lit(101.0))).alias("km"))


@query("f09_slope_percent", "pix", """
    with z as (select vec_id, px, pi() * 6371008.8 / (180 * 3600) as dy,
        pi() * 6371008.8 / (180 * 3600) * cos(radians(cast(vec_id % 60 as double))) as dx from pix)
    select vec_id, round(100 * sqrt(pow((px[3] + 2 * px[6] + px[9] - px[1] - 2 * px[4] - px[7]) / (8 * dx), 2)
        + pow((px[7] + 2 * px[8] + px[9] - px[1] - 2 * px[2] - px[3]) / (8 * dy), 2)), 4) as slope_pct from z""")
def _(t):
    lat = (F.col("vec_id") % 60).cast("double")
    return t.pix.select("vec_id", rnd(C.slope_pct("px", lat), 4).alias("slope_pct"))


@query("f10_clip_close", "daily", """
    select province, cast(day as varchar) as day, round(least(greatest(t_max, 26.0), 30.0), 6) as clipped,
        round(greatest(rain_mm - 50, 0.0), 6) as excess, abs(t_max - t_min - 6) <= 2 as near from daily""")
def _(t):
    return t.daily.select(
        "province", F.col("day").cast("string").alias("day"), rnd(C.clip("t_max", 26.0, 30.0)).alias("clipped"),
        rnd(C.non_negative(F.col("rain_mm") - 50)).alias("excess"),
        C.close(F.col("t_max") - F.col("t_min"), F.lit(6.0), 2.0).alias("near"))


@query("f11_one_hot", "sensor", """
    select event_id, case when sig1 = 'click' then 1.0::double else 0.0::double end as is_click,
        case when sig1 = 'error' then 1.0::double else 0.0::double end as is_error,
        case when sig1 = 'view' then 1.0::double else 0.0::double end as is_view from sensor""")
def _(t):
    return t.sensor.select("event_id", *C.one_hot("sig1", ["click", "error", "view"], "is_"))


@query("f12_pixel_quality", "pix", """
    with cells as (select vec_id, unnest(px) as v, generate_subscripts(px, 1) as i from pix),
    marked as (select *, case when i % 5 = 0 then 1 else 0 end as r, 2048 + (abs(v) % 4) * 16 + case when i % 7 = 0 then 1024 else 0 end
        + (i % 4) * 64 as q from cells),
    good as (select *, v between -2000 and 10000 and r = 0 and (q & 3) = 0 and ((q >> 11) & 7) = 1 and ((q >> 6) & 3) <> 3
        and (q & (256 + 1024 + 16384 + 32768)) = 0 as ok from marked)
    select vec_id, cast(count(*) filter (ok) as bigint) as good_pixels, round(100.0 * count(*) filter (ok) / count(*), 4) as good_pct,
        round(case when 100.0 * count(*) filter (ok) / count(*) >= 20 then avg(v * 0.0001::double) filter (ok) end, 9) as mean_value,
        round(case when 100.0 * count(*) filter (ok) / count(*) >= 20 then quantile_cont(v * 0.0001::double, 0.1) filter (ok) end, 9) as p10
    from good group by vec_id""")
def _(t):
    i = F.sequence(F.lit(1), F.size("px"))
    rel = F.transform(i, lambda k: F.when(k % 5 == 0, 1).otherwise(0))
    qa = F.transform(
        F.arrays_zip(F.col("px").alias("v"), i.alias("i")),
        lambda z: 2048 + (F.abs(z["v"]) % 4) * 16 + F.when(z["i"] % 7 == 0, 1024).otherwise(0) + (z["i"] % 4) * 64)
    bands = t.pix.select("vec_id", "px", A.good_pixels("px", rel, qa).alias("mask"))
    pct, mean, p10 = A.patch_stats("px", "mask", 0.0001)
    return bands.select("vec_id", F.size(F.filter("mask", lambda m: m)).cast("long").alias("good_pixels"),
                        rnd(pct, 4).alias("good_pct"), rnd(mean, 9).alias("mean_value"), rnd(p10, 9).alias("p10"))


@query("f13_issue_dates", "year", """
    select cast(province as bigint) as province, cast(year_ce as bigint) as year_ce, cast(lead as bigint) as lead,
        cast(cast(make_date(cast(year_ce as int), case when province % 2 = 0 then 5 else 7 end, 15)
             - lead * interval 1 day as date) as varchar) as issue
    from year cross join (values (0), (60)) l(lead)""")
def _(t):
    anchor = F.when(F.col("province") % 2 == 0, "05-15").otherwise("07-15")
    panel = t.year.select("province", "year_ce", F.explode(F.array(F.lit(0), F.lit(60))).alias("lead"))
    return panel.select(F.col("province").cast("long"), F.col("year_ce").cast("long"), F.col("lead").cast("long"),
                        D.issue_date(anchor, "year_ce", "lead").cast("string").alias("issue"))


@query("f14_month_days_bloom", "month", """
    with m as (select *, make_date(cast(year_ce as int), cast(month as int), 1) as a,
        last_day(make_date(cast(year_ce as int), cast(month as int), 1)) as b from month)
    select cast(province as bigint) as province, cast(year_ce as bigint) as year_ce, cast(month as bigint) as month,
        cast(date_diff('day', a, b) + 1 as bigint) as days, cast(a - 140 as varchar) as bloom_start,
        cast(b - 100 as varchar) as bloom_end from m""")
def _(t):
    start, end = D.bloom_range("year_ce", "month", 100, 140)
    return t.month.select(
        *[F.col(c).cast("long").alias(c) for c in ("province", "year_ce", "month")],
        F.size(D.month_days("year_ce", "month")).cast("long").alias("days"),
        start.cast("string").alias("bloom_start"), end.cast("string").alias("bloom_end"))


@query("f15_stable_ids", "pts", """
    select point_id, 'pt-' || substr(sha256('{"c0":"' || province || '","c1":"' || point_id || '"}'), 1, 20) as stable_id from pts""")
def _(t):
    return t.pts.select("point_id", X.stable_id("pt-", "province", "point_id").alias("stable_id"))


@query("f16_bulletin_text", "ord", """
    select doc_id, cast(start_date as varchar) as issued,
        case doc_id % 3 when 0 then 'El Niño' when 1 then 'La Niña' else 'ENSO-neutral' end as state,
        cast(1 as bigint) as mentions, cast(50 + doc_id % 20 as double) as low,
        case when doc_id % 2 = 0 then cast(70 + doc_id % 20 as double) else cast(50 + doc_id % 20 as double) end as high,
        doc_id % 5 = 0 as approximate from ord""")
def _(t):
    k = F.col("doc_id")
    phase = F.when(k % 3 == 0, "El Niño").when(k % 3 == 1, "La Niña").otherwise("ENSO-neutral")
    low = (50 + k % 20).cast("string")
    share = F.when(k % 2 == 0, F.concat(low, F.lit("-"), (70 + k % 20).cast("string"))).otherwise(low)
    text = F.concat(
        F.lit("Diagnostic discussion issued by the centre "), F.date_format("start_date", "d MMMM yyyy"),
        F.lit(". Overall, the coupled system was consistent with "), phase,
        F.lit(" conditions. The outlook has a "), F.when(k % 5 == 0, "about ").otherwise(""), share,
        F.lit("% chance of a change. Skill was 30% last year."))
    # The bulletins are made once and read by each extraction.
    parsed = cut_lineage(t.ord.select(k, text.alias("text")))
    m = F.col("mentions")
    both = parsed.join(X.observed_states(parsed, ["doc_id"], "text"), "doc_id", "left").join(X.probability_mentions(parsed, ["doc_id"], "text"), "doc_id", "left")
    return both.select(
        "doc_id", X.bulletin_issue_date("text").cast("string").alias("issued"), "state", F.coalesce(F.size(m), F.lit(0)).cast("long").alias("mentions"),
        m[0]["low"].alias("low"), m[0]["high"].alias("high"), m[0]["approximate"].alias("approximate"))


@query("f17_direction_label", "year", """
    select cast(a.province as bigint) as province, cast(a.year_ce as bigint) as year_ce,
        cast(case when a.yield_v > b.yield_v then 1 when a.yield_v < b.yield_v then 0 end as bigint) as label,
        cast(case when a.production - b.production > 0 then 1 when a.production - b.production < 0 then 0
             else 1 end as bigint) as sign_label
    from year a join year b on a.province = b.province and a.year_ce = b.year_ce + 1""")
def _(t):
    pairs = J.prev_period_join(t.year, ["province"], "year_ce", ["yield_v", "production"])
    return pairs.select(
        F.col("province").cast("long"), F.col("year_ce").cast("long"),
        C.direction("yield_v", "previous_yield_v").cast("long").alias("label"),
        C.sign_with_fallback(F.col("production") - F.col("previous_production"), F.lit(1)).cast("long").alias("sign_label"))


@query("f18_reconstruct_target", "year", """
    select cast(a.province as bigint) as province, cast(a.year_ce as bigint) as year_ce, arm,
        round(greatest(0.0, case when arm = 'delta' then a.yield_v - 2 * b.yield_v + b.yield_v else a.yield_v - b.yield_v end), 4) as value
    from year a join year b on a.province = b.province and a.year_ce = b.year_ce + 1 cross join (values ('level'), ('delta')) m(arm)""")
def _(t):
    pairs = J.prev_period_join(t.year, ["province"], "year_ce", ["yield_v"]).withColumn(
        "arm", F.explode(F.array(F.lit("level"), F.lit("delta"))))
    raw = F.when(F.col("arm") == "delta", F.col("yield_v") - 2 * F.col("previous_yield_v")).otherwise(
        F.col("yield_v") - F.col("previous_yield_v"))
    return pairs.select(F.col("province").cast("long"), F.col("year_ce").cast("long"), "arm",
                        rnd(C.reconstruct(raw, "previous_yield_v", "arm"), 4).alias("value"))


@query("f19_adjusted_age", "daily", """
    with z as (select province, day, greatest(-1, least(1, (t_max - 30) / 4)) as heat,
        greatest(-1, least(1, (rain_mm / 100 - solar / 40) / 2)) as wet, greatest(-1, least(1, (rh - 55) / 5)) as idx from daily)
    select province, cast(day as varchar) as day, kind,
        cast(case when kind = 'fixed' then 120 else greatest(110, least(160, 120 + 5 * round_even(10 * case kind
            when 'enso' then -idx when 'heat' then -heat when 'wet' then wet when 'local' then (wet - heat) / 2
            else (wet - heat - idx) / 3 end / 5, 0))) end as bigint) as age
    from z cross join (values ('fixed'), ('enso'), ('heat'), ('wet'), ('local'), ('enso_local')) k(kind)""")
def _(t):
    kinds = F.array(*[F.lit(k) for k in ("fixed", "enso", "heat", "wet", "local", "enso_local")])
    age = C.adjusted_age((F.col("t_max") - 30) / 4, F.col("rain_mm") / 100, F.col("solar") / 40, (F.col("rh") - 55) / 5,
                         "kind", F.lit(120), F.lit(10))
    return t.daily.withColumn("kind", F.explode(kinds)).select(
        "province", F.col("day").cast("string").alias("day"), "kind", age.cast("long").alias("age"))


@query("f20_stage_overlap", "ord month", """
    with e as (select distinct province, start_date as event_day from ord),
    c as (select e.province, e.event_day, m.year_ce, m.month, age,
            unnest(generate_series(make_date(cast(m.year_ce as int), cast(m.month as int), 1), last_day(make_date(cast(m.year_ce as int), cast(m.month as int), 1)), interval 1 day)) as h
        from e join month m on e.province = m.province and m.year_ce between year(e.event_day) and year(e.event_day) + 1
        cross join (values (120), (130), (140), (150)) a(age)),
    s as (select *, date_diff('day', cast(h as date), event_day) + age as since from c),
    p as (select province, year(event_day) as event_year, event_day, year_ce, month, age,
        100.0 * count(*) filter (since < -90) / count(*) as before_window, 100.0 * count(*) filter (since >= -90 and since < 0) / count(*) as pre_bloom_90d,
        100.0 * count(*) filter (since >= 0 and since < 30) / count(*) as fruit_0_29d, 100.0 * count(*) filter (since >= 30 and since < 60) / count(*) as fruit_30_59d,
        100.0 * count(*) filter (since >= 60 and since < 90) / count(*) as fruit_60_89d, 100.0 * count(*) filter (since >= 90 and since < age) / count(*) as fruit_90_to_harvest,
        100.0 * count(*) filter (since >= age) / count(*) as on_or_after_harvest from s group by all)
    select cast(province as bigint) as province, cast(event_year as bigint) as event_year, cast(year_ce as bigint) as year_ce, cast(month as bigint) as month, cast(age as bigint) as age,
        cast(count(*) as bigint) as events, round(avg(before_window), 6) as before_window, round(avg(pre_bloom_90d), 6) as pre_bloom_90d, round(avg(fruit_0_29d), 6) as fruit_0_29d,
        round(avg(fruit_30_59d), 6) as fruit_30_59d, round(avg(fruit_60_89d), 6) as fruit_60_89d, round(avg(fruit_90_to_harvest), 6) as fruit_90_to_harvest, round(avg(on_or_after_harvest), 6) as on_or_after_harvest
    from p group by all""")
def _(t):
    events = t.ord.select("province", F.col("start_date").alias("event_day")).distinct()
    out = J.stage_overlap(events, t.month, "province", "event_day", "year_ce", "month", [120, 130, 140, 150])
    keys = [F.col("province").cast("long").alias("province"), F.year("event_day").cast("long").alias("event_year"),
            *[F.col(c).cast("long").alias(c) for c in ("year_ce", "month", "age")]]
    return out.groupBy(*keys).agg(F.count("*").alias("events"), *[F.round(F.avg(c), 6).alias(c) for c in J.STAGE_NAMES])


@query("f21_interactions", "year", """
    select cast(province as bigint) as province, cast(year_ce as bigint) as year_ce,
        round(production * n_regionkey, 6) as production_x_region_key, round(yield_v * n_regionkey, 6) as yield_v_x_region_key
    from year join (select n_nationkey, n_regionkey from nation) on n_nationkey = province""")
def _(t):
    site = t.nation.select(F.col("n_nationkey").alias("province"), F.col("n_regionkey").alias("region_key"))
    both = t.year.join(site, "province")
    pairs = C.interactions([("production", "region_key"), ("yield_v", "region_key")])
    out = both.select("province", "year_ce", *pairs)
    return out.select(F.col("province").cast("long"), F.col("year_ce").cast("long"),
                      *[rnd(c).alias(c) for c in out.columns[2:]])


@query("f22_local_day", "sensor", """
    select event_id, strftime(recorded_at + interval 7 hour, '%Y-%m-%d %H:%M:%S') as local_at,
        cast(cast(recorded_at + interval 7 hour as date) as varchar) as local_day from sensor""")
def _(t):
    return t.sensor.select(
        "event_id", F.date_format(D.to_local("recorded_at", "Asia/Bangkok"), "yyyy-MM-dd HH:mm:ss").alias("local_at"),
        D.local_day("recorded_at", "Asia/Bangkok").cast("string").alias("local_day"))
