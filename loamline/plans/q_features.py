"""Feature-builder queries. Each oracle enumerates every (cohort, day) cell."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamline.functions.climate import daily_vpd
from loamline.operators import aggregates as A
from loamline.operators import features as B

from loamline.operators import windows as W
from loamline.plans.q_windows import DRY, day, ints, ts
from loamline.plans.registry import query

AGES = [120, 130, 140, 150]
MEASURES = {"rain": ("rain_mm", "sum"), "t_max": ("t_max", "mean"), "solar": ("solar", "mean"), "t_min": ("t_min", "mean"), "rh": ("rh", "mean")}


def r6(*names):
    return [F.round(c, 6).alias(c) for c in names]


def regional_harvest(t):
    region = t.nation.select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("province"))
    rows = t.month.withColumnRenamed("province", "nation").join(region, "nation")
    return rows.groupBy("province", "year_ce", "month").agg(F.sum("tonnes").alias("tonnes"))


def seasons(t):
    """Season of each region-year, from the peak month of the years up to 1998."""
    harvest = regional_harvest(t)
    season = A.training_seasons(harvest, ["province"], "year_ce", "month", "tonnes", 1998)
    keys = harvest.select("province", F.col("year_ce").alias("year")).distinct().join(season, "province")
    return B.season_days(keys, "year", "season_start")


KEYS = """
    with h as (select n_regionkey as province, year_ce, month, sum(tonnes) as tonnes from month join nation on n_nationkey = province group by all),
    pk as (select province, arg_max(month, struct_pack(t := t, m := -month)) as peak from (select province, month, sum(tonnes) as t from h where year_ce <= 1998 group by all) group by province),
    k as (select distinct h.province, h.year_ce as year, cast(greatest(1, least(10, peak - 1)) as int) as s from h join pk on pk.province = h.province),
    sd as (select province, year, make_date(cast(year as int), s, 1) as h0, cast(make_date(cast(year as int), s, 1) + interval 3 month - interval 1 day as date) as h1 from k),
    hd as (select province, year, cast(unnest(generate_series(h0, h1, interval 1 day)) as date) as h, date_diff('day', h0, h1) + 1 as cohorts, h0 from sd)
"""
STAGES = """
    , st as (select age, stage, a, case when b is null then age else b end as b from (values ({ages})) g(age) cross join (values ('pre_bloom_90d', -90, 0), ('fruit_0_29d', 0, 30), ('fruit_30_59d', 30, 60), ('fruit_60_89d', 60, 90), ('fruit_90_to_harvest', 90, null)) w(stage, a, b)),
    c as (select province, year, cohorts, age, stage, h, cast(h - age + cast(unnest(range(a, b)) as int) as date) as day, b - a as len from hd cross join st)
"""


def stages(*ages):
    return KEYS + STAGES.format(ages="), (".join(str(a) for a in ages))


@query("b01_stage_exposure", "month daily", stages(*AGES) + """
    select c.province, cast(year as bigint) as year, cast(age as bigint) as age, stage, round(case when count(d.day) = count(*) then sum(rain_mm) / max(cohorts) end, 6) as rain, round(case when count(d.day) = count(*) then avg(t_max) end, 6) as t_max,
        round(100.0 * count(d.day) / count(*), 6) as coverage_pct from c left join daily d on d.province = c.province and d.day = c.day group by all""")
def _(t):
    out = B.stage_exposure(seasons(t), t.daily, ["province"], ["province", "year"], AGES, {k: MEASURES[k] for k in ("rain", "t_max")})
    return out.select("province", *ints("year", "age"), "stage", *r6("rain", "t_max"), F.round("rain_coverage_pct", 6).alias("coverage_pct"))


@query("b02_vpd_window", "month daily_full", KEYS + """
    , c as (select province, year, cohorts, h, cast(h - 120 + cast(unnest(range(-90, 0)) as int) as date) as day from hd),
    v as (select *, case when t_min <= t_max and t_max <= 60 and rh <= 100 then (0.6108 * exp(17.27 * t_min / (t_min + 237.3)) + 0.6108 * exp(17.27 * t_max / (t_max + 237.3))) / 2 * (1 - rh / 100) end as vpd from daily_full)
    select c.province, cast(year as bigint) as year, round(case when count(vpd) = count(*) then avg(vpd) end, 6) as vpd_mean, round(case when count(vpd) = count(*) then quantile_cont(vpd, 0.9) end, 6) as vpd_p90
    from c left join v on v.province = c.province and v.day = c.day group by all""")
def _(t):
    rows = t.daily_full.withColumn("vpd", daily_vpd("t_min", "t_max", "rh"))
    out = B.stage_exposure(seasons(t), rows, ["province"], ["province", "year"], [120], {"vpd_mean": ("vpd", "mean"), "vpd_p90": ("vpd", "p90")}, {"pre_bloom": (-90, 0)})
    return out.select("province", *ints("year"), *r6("vpd_mean", "vpd_p90"))


@query("b03_stage_table", "month daily_full", stages(*AGES) + """
    , e as (select c.province, year, age, stage, case when count(d.day) = count(*) then sum(rain_mm) / max(cohorts) end as rain, case when count(d.day) = count(*) then avg(t_max) end as t_max, case when count(d.day) = count(*) then avg(solar) end as solar,
        case when count(d.day) = count(*) then avg(t_min) end as t_min, case when count(d.day) = count(*) then avg(rh) end as rh from c left join daily_full d on d.province = c.province and d.day = c.day group by all)
    select province, cast(year as bigint) as year, cast(age as bigint) as age, """ + ", ".join(
    f"round(max(case when stage = '{s}' then {f} end), 6) as {s}_{f}" for s in B.STAGE_WINDOWS for f in MEASURES) + " from e group by all")
def _(t):
    exposure = B.stage_exposure(seasons(t), t.daily_full, ["province"], ["province", "year"], AGES, MEASURES)
    out = B.stage_table(exposure, ["province", "year"], list(B.STAGE_WINDOWS), list(MEASURES))
    return out.select("province", *ints("year", "age"), *r6(*[f"{s}_{f}" for s in B.STAGE_WINDOWS for f in MEASURES]))


BACKCAST = """
    with h as (select n_regionkey as province, year_ce, month, sum(tonnes) as tonnes from month join nation on n_nationkey = province group by all),
    w as (select province, year_ce, s, sum(tonnes) as t from h join generate_series(1, 10) g(s) on month between s and s + 2 group by all), mn as (select province, year_ce, arg_max(s, struct_pack(t := t, m := -s)) as main from w group by all),
    hd as (select province, year_ce, month, tonnes, cast(unnest(generate_series(make_date(cast(year_ce as int), cast(month as int), 1), last_day(make_date(cast(year_ce as int), cast(month as int), 1)), interval 1 day)) as date) as h from h),
    st as (select age, stage, a, case when b is null then age else b end as b from (values (120), (150)) g(age) cross join (values ('pre_bloom_90d', -90, 0), ('fruit_0_29d', 0, 30), ('fruit_full', 0, null)) w(stage, a, b)),
    c as (select province, year_ce, month, tonnes, age, stage, h, cast(h - age + cast(unnest(range(a, b)) as int) as date) as day from hd cross join st),
    e as (select c.province, year_ce, month, tonnes, age, stage, case when count(d.day) = count(*) then sum(rain_mm) / count(distinct h) end as rain from c left join daily_full d on d.province = c.province and d.day = c.day group by all),
    m as (select e.province, e.year_ce, e.month, e.tonnes, age, main, max(case when stage = 'pre_bloom_90d' then rain end) as pre, max(case when stage = 'fruit_0_29d' then rain end) as early, max(case when stage = 'fruit_full' then rain end) as whole from e join mn on mn.province = e.province and mn.year_ce = e.year_ce group by all)
"""


def _backcast(t):
    annual = t.year.join(t.nation.select(F.col("n_nationkey").alias("province"), F.col("n_regionkey").alias("region")), "province").groupBy(
        F.col("region").alias("province"), "year_ce").agg(F.sum("production").alias("production"), F.sum("area").alias("bearing"))
    return B.backcast(regional_harvest(t), annual, t.daily_full, "province", "year_ce", "month", "tonnes", [120, 150], {"rain": ("rain_mm", "sum")}, "production", "bearing")


@query("b04_backcast_monthly", "month daily_full", BACKCAST + """
    select province, cast(year_ce as bigint) as year_ce, cast(month as bigint) as month, cast(age as bigint) as age, round(100 * tonnes / sum(tonnes) over (partition by province, year_ce, age), 6) as share_pct, month between main and main + 2 as in_main,
        cast(make_date(cast(year_ce as int), cast(month as int), 1) - cast(age as int) as varchar) as bloom_start, round(pre, 6) as pre_bloom_rain, round(early, 6) as early_rain, round(whole, 6) as full_rain from m""")
def _(t):
    out, _ = _backcast(t)
    return out.select("province", *ints("year_ce", "month", "age"), *r6("share_pct"), "in_main", day("bloom_start"), F.round("pre_bloom_90d_rain", 6).alias("pre_bloom_rain"),
                      F.round("fruit_0_29d_rain", 6).alias("early_rain"), F.round("fruit_full_rain", 6).alias("full_rain"))


@query("b04_backcast_annual", "month daily_full year", BACKCAST + """
    , an as (select n_regionkey as province, year_ce, sum(production) as production, sum(area) as bearing from year join nation on n_nationkey = province group by all),
    sc as (select *, sum(tonnes) over (partition by province, year_ce, age) as reported, 'all_reported' as scope from m union all select *, sum(tonnes) over (partition by province, year_ce, age), 'main_peak3' from m qualify month between main and main + 2)
    select sc.province, cast(sc.year_ce as bigint) as year_ce, cast(age as bigint) as age, scope, cast(count(*) as bigint) as selected_months, round(sum(tonnes), 6) as selected_tonnes, round(100 * sum(tonnes) / max(reported), 6) as selected_share_pct,
        round(max(production) * 1000 / max(bearing), 5) as annual_yield, round(100 * max(reported) / max(production), 6) as monthly_to_annual_pct, round(case when count(pre) = count(*) then sum(tonnes * pre) / sum(tonnes) end, 6) as pre_bloom_rain, round(case when count(whole) = count(*) then sum(tonnes * whole) / sum(tonnes) end, 6) as full_rain
    from sc left join an on an.province = sc.province and an.year_ce = sc.year_ce group by sc.province, sc.year_ce, age, scope""")
def _(t):
    _, out = _backcast(t)
    return out.select("province", *ints("year_ce", "age"), "scope", "selected_months", *r6("selected_tonnes", "selected_share_pct"), F.round("annual_yield", 5).alias("annual_yield"),
                      *r6("monthly_to_annual_pct"), F.round("pre_bloom_90d_rain", 6).alias("pre_bloom_rain"), F.round("fruit_full_rain", 6).alias("full_rain"))


COHORT_RUNS = """
    , w as (select province, year, h, o, cast(h - 120 + cast(o as int) as date) as day from (select *, unnest(range({a}, {b})) as o from hd)),
    v as (select w.*, rain_mm as r, t_max as x from w left join daily_full d on d.province = w.province and d.day = w.day),
    ok as (select province, year, count(r) = count(*) as isfull from v group by all)
"""


def longest(name, condition, a, b):
    return f""", {name}_i as (select province, year, h, o - row_number() over (partition by province, year, h order by o) as g from v where {condition} and o >= {a} and o < {b}),
    {name}_c as (select province, year, h, max(n) as k from (select province, year, h, g, count(*) as n from {name}_i group by all) group by all),
    {name} as (select hd.province, hd.year, hd.h, coalesce(k, 0) as k from hd left join {name}_c c on c.province = hd.province and c.year = hd.year and c.h = hd.h)"""


@query("b05_weather_shocks", "month daily_full", KEYS + COHORT_RUNS.format(a=-90, b=120) + longest("dry", "r < 40", -90, 0) + longest("early", "r < 40", 0, 30) + longest("hot", "x > 30", 0, 30) + """
    , s as (select province, year, h, o, sum(r) over (partition by province, year, h order by o rows between 2 preceding and current row) as s3, sum(r) over (partition by province, year, h order by o rows between 6 preceding and current row) as s7 from v where o >= 0),
    m as (select province, year, h, max(s3) filter (o >= 2) as m3, max(s7) filter (o >= 6) as m7 from s group by all), q as (select province, year, h, count(*) filter (x > 30) as d30, count(*) filter (x > 31) as d31 from v where o >= 0 and o < 30 group by all)
    select m.province, cast(m.year as bigint) as year, round(case when isfull then avg(dry.k) end, 6) as pre_bloom_dry_run, round(case when isfull then avg(early.k) end, 6) as early_dry_run, round(case when isfull then avg(d30) end, 6) as early_hot30_days,
        round(case when isfull then avg(d31) end, 6) as early_hot31_days, round(case when isfull then avg(hot.k) end, 6) as early_hot30_run, round(case when isfull then avg(m3) end, 6) as fruit_rx3, round(case when isfull then avg(m7) end, 6) as fruit_rx7
    from m join dry using (province, year, h) join early using (province, year, h) join hot using (province, year, h) join q using (province, year, h) join ok using (province, year) group by m.province, m.year, isfull""")
def _(t):
    out = B.shock_features(seasons(t), t.daily_full, ["province"], ["province", "year"], 120, dry_mm=40, hot=(30, 31))
    return out.select("province", *ints("year"), *r6(*out.columns[2:]))


@query("b06_critical_window", "month daily_full", KEYS + COHORT_RUNS.format(a=23, b=51) + longest("dry", "r < 60", 30, 51) + longest("hot", "x > 30", 30, 51) + """
    , g as (select *, max(r) over (partition by province, year, h order by o rows between 7 preceding and 1 preceding) as before7 from v),
    q as (select province, year, h, count(*) filter (x > 30) as hot_days, count(*) filter (before7 < 60 and r >= 60) as surge from g where o >= 30 group by all)
    select q.province, cast(q.year as bigint) as year, round(case when isfull then avg(dry.k) end, 6) as dry_run, round(case when isfull then avg(hot_days) end, 6) as hot_days, round(case when isfull then avg(hot.k) end, 6) as hot_run,
        round(case when isfull then avg(surge) end, 6) as rain_after_dry, round(case when isfull then avg(hot_days * dry.k) end, 6) as heat_x_dry from q join dry using (province, year, h) join hot using (province, year, h) join ok using (province, year) group by q.province, q.year, isfull""")
def _(t):
    out = B.critical_features(seasons(t), t.daily_full, ["province"], ["province", "year"], 120, dry_mm=60, wet_mm=60, hot=30)
    return out.select("province", *ints("year"), *r6(*out.columns[2:]))


TRIGGERED = KEYS + """
    , tr as (select province, day from (""" + DRY.strip() + """ select province, day from c where crossing and ahead <= 170)),
    se as (select province, year, make_date(cast(year - 1 as int), 12, 1) as a, h1 - 140 as b from sd),
    ts as (select se.province, se.year, tr.day as trig from se join tr on tr.province = se.province and tr.day > se.a and tr.day <= se.b),
    bl as (select hd.province, hd.year, hd.h, hd.cohorts, h - 120 as nominal, arg_min(trig + 50, struct_pack(g := abs(date_diff('day', trig + 50, h - 120)), b := trig + 50)) filter (abs(date_diff('day', trig + 50, h - 120)) <= 30) as hit
        from hd left join ts on ts.province = hd.province and ts.year = hd.year group by all),
    bb as (select *, coalesce(hit, nominal) as bloom from bl)
"""


def _triggered(t):
    s = seasons(t)
    found = W.dry_triggers(t.daily_full, ["province"], "day", "rain_mm", 40, 15, 170, 31)
    search = s.select("province", "year", F.make_date(F.col("year") - 1, F.lit(12), F.lit(1)).alias("start"), F.date_sub("_h1", 140).alias("end")).where(F.col("end") >= F.col("start"))
    searched = W.trigger_search(found, search, ["province"], "day")
    return B.trigger_windows(s, searched, ["province", "year"], 120)


@query("b07_trigger_windows", "month daily_full", TRIGGERED + """
    select province, cast(year as bigint) as year, cast(count(hit) as bigint) as trigger_cohorts, cast(count(*) as bigint) as cohorts, round(avg(date_diff('day', nominal, bloom)), 6) as mean_shift_days,
        case when count(hit) = 0 then 'not_found' when count(hit) = count(*) then 'all_cohorts' else 'partial_fallback' end as trigger_status, cast(min(bloom) as varchar) as bloom_start, cast(max(bloom) as varchar) as bloom_end from bb group by all""")
def _(t):
    out = _triggered(t)
    return out.select("province", *ints("year", "trigger_cohorts", "cohorts"), *r6("mean_shift_days"), "trigger_status", day("bloom_start"), day("bloom_end"))


@query("b07_trigger_exposure", "month daily_full", TRIGGERED + """
    , c as (select province, year, cohorts, stage, cast(bloom + cast(unnest(range(a, b)) as int) as date) as day from bb cross join (values ('pre_bloom_90d', -90, 0), ('fruit_0_29d', 0, 30), ('fruit_30_59d', 30, 60), ('fruit_60_89d', 60, 90), ('fruit_90_to_harvest', 90, 120)) w(stage, a, b))
    select c.province, cast(year as bigint) as year, stage, round(case when count(d.day) = count(*) then sum(rain_mm) / max(cohorts) end, 6) as rain, round(case when count(d.day) = count(*) then avg(t_max) end, 6) as t_max
    from c left join daily_full d on d.province = c.province and d.day = c.day group by all""")
def _(t):
    out = B.bloom_exposure(_triggered(t), t.daily_full, ["province"], ["province", "year"], 120, {k: MEASURES[k] for k in ("rain", "t_max")})
    return out.select("province", *ints("year"), "stage", *r6("rain", "t_max"))


ISSUE = stages(120) + """
    , d as (select *, strftime(day, '%m-%d') as mmdd, year(day) as y from daily_full),
    n0 as (select k.province, k.year, d.mmdd, case when count(*) >= 2 then avg(rain_mm) end as rain_mm, case when count(*) >= 2 then avg(t_max) end as t_max from k join d on d.province = k.province and d.y between k.year - 3 and k.year - 1 where mmdd <> '02-29' group by all),
    n as (select * from n0 union all select province, year, '02-29', case when count(rain_mm) = 2 then sum(rain_mm) / 2 end, case when count(t_max) = 2 then sum(t_max) / 2 end from n0 where mmdd in ('02-28', '03-01') group by all),
    x as (select c.*, c.day <= sd.h0 - 67 as observed, case when c.day <= sd.h0 - 67 then d.rain_mm else n.rain_mm end as rain_mm, case when c.day <= sd.h0 - 67 then d.t_max else n.t_max end as t_max, sd.h0
        from c join sd on sd.province = c.province and sd.year = c.year left join d on d.province = c.province and d.day = c.day left join n on n.province = c.province and n.year = c.year and n.mmdd = strftime(c.day, '%m-%d'))
"""


def _issue_cells(t):
    return B.issue_cells(seasons(t), t.daily_full, ["province"], ["province", "year"], "year", 120, 60, ["rain_mm", "t_max"], 7, 3, 2)


@query("b08_issue_features", "month daily_full", ISSUE + """
    , f as (select province, year, h0, case when count(rain_mm) filter (stage = 'pre_bloom_90d') = count(*) filter (stage = 'pre_bloom_90d') then sum(rain_mm) filter (stage = 'pre_bloom_90d') / max(cohorts) end as pre_rain,
        case when count(t_max) filter (stage = 'fruit_90_to_harvest') = count(*) filter (stage = 'fruit_90_to_harvest') then avg(t_max) filter (stage = 'fruit_90_to_harvest') end as late_t_max,
        case when count(t_max) filter (stage = 'fruit_60_89d') = count(*) filter (stage = 'fruit_60_89d') then quantile_cont(t_max, 0.9) filter (stage = 'fruit_60_89d') end as mid_p90,
        count(*) filter (stage = 'fruit_60_89d' and observed) / count(*) filter (stage = 'fruit_60_89d') as mid_observed from x group by all)
    select province, cast(year as bigint) as year, cast(h0 - 60 as varchar) as issue, round(pre_rain, 6) as pre_rain, round(late_t_max, 6) as late_t_max, round(mid_p90, 6) as mid_p90, round(mid_observed, 6) as mid_observed,
        case when pre_rain is null or late_t_max is null or mid_p90 is null then 'missing_weather' else 'ok' end as status from f""")
def _(t):
    out = B.issue_features(_issue_cells(t), ["province", "year"], {
        "pre_rain": ("pre_bloom_90d", "rain_mm", "sum"), "late_t_max": ("fruit_90_to_harvest", "t_max", "mean"), "mid_p90": ("fruit_60_89d", "t_max", "p90")})
    return out.select("province", *ints("year"), day("issue"), *r6("pre_rain", "late_t_max", "mid_p90"), F.round("mid_p90_observed", 6).alias("mid_observed"), "status")


@query("b09_feature_lineage", "month daily_full", ISSUE + """
    select x.province, cast(x.year as bigint) as year, stage, cast(count(distinct case when observed then x.day end) as bigint) as observed_dates, cast(count(*) filter (observed) as bigint) as observed_cells, cast(count(*) filter (not observed) as bigint) as climatology_cells,
        cast(max(case when observed then x.day end) as varchar) as last_observed from x group by all""")
def _(t):
    out = B.feature_lineage(_issue_cells(t), t.daily_full, ["province"], ["province", "year"], "year", "t_max", 3)
    return out.select("province", *ints("year"), "stage", F.size("observed_dates").cast("long").alias("observed_dates"), "observed_cells", "climatology_cells",
                      F.array_max("observed_dates").cast("string").alias("last_observed"))


@query("b09_lineage_digests")
def _(t):
    return B.feature_lineage(_issue_cells(t), t.daily_full, ["province"], ["province", "year"], "year", "t_max", 3).select(
        "province", *ints("year"), "stage", F.size("normal_dates").cast("long").alias("normal_dates"), "observed_values_sha256", "normal_values_sha256")


@query("b10_lag_month_panel", "daily month", """
    with w as (select province, cast(year(day) * 12 + month(day) - 1 as bigint) as m, avg(t_max) as t, count(*) as n from daily group by all), h as (select n_regionkey as province, cast(year_ce * 12 + month - 1 as bigint) as m, sum(tonnes) as tonnes from month join nation on n_nationkey = province where month <> 7 group by all),
    k as (select province, m from w union select province, m from h),
    j as (select k.province, k.m, h.tonnes, p.t as lag_t, p.n as lag_n, day(last_day(make_date(cast((k.m - 1) // 12 as int), cast((k.m - 1) % 12 + 1 as int), 1))) as expected from k left join h on h.province = k.province and h.m = k.m left join w p on p.province = k.province and p.m = k.m - 1)
    select cast(province as bigint) as province, m // 12 as year_ce, m % 12 + 1 as month, round(tonnes, 6) as tonnes, round(lag_t, 6) as lag_t_max, cast(lag_n as bigint) as lag_t_max_days, cast(expected as bigint) as lag_expected_days,
        concat_ws(';', case when tonnes is null then 'no_target_record' end, case when lag_n is null or lag_n <> expected then 'incomplete_lag_daily_coverage' end, case when lag_t is null then 'missing_lag_feature' end) as exclusion_reason,
        tonnes is not null and lag_n is not null and lag_n = expected as eligible from j""")
def _(t):
    weather = A.monthly_climate(t.daily, ["province"], "day", ["t_max"]).select(
        "province", F.col("year").alias("year_ce"), "month", F.col("t_max_mean").alias("t_max"), "t_max_days")
    out = B.lag_month_panel(weather, regional_harvest(t).where("month <> 7"), ["province"], "year_ce", "month", ["t_max"], "tonnes")
    return out.select(*ints("province", "year_ce", "month"), *r6("tonnes", "lag_t_max"), *ints("lag_t_max_days", "lag_expected_days"), "exclusion_reason", "eligible")


@query("b11_pre_anchor_windows", "daily month", KEYS + """
    , m as (select province, cast(year(day) * 12 + month(day) - 1 as bigint) as m, sum(t_max) as t, sum(rain_mm) as r, count(*) as n, max(day(last_day(day))) as d from daily group by all),
    a as (select k.province, k.year, k.s, w, x from k cross join generate_series(1, 6) g(x) cross join generate_series(1, 6) f(w) where x <= w)
    select a.province, cast(year as bigint) as year, cast(w as bigint) as months, round(case when count(*) filter (n = d) = w then sum(t) / sum(d) end, 6) as t_max, round(case when count(*) filter (n = d) = w then sum(r) end, 6) as rain_mm
    from a left join m on m.province = a.province and m.m = year * 12 + s - 1 - x group by a.province, year, w""")
def _(t):
    anchors = seasons(t).select("province", "year", "season_start")
    wide = B.pre_anchor_windows(t.daily, anchors, ["province"], "year", "season_start", ["t_max"], ["rain_mm"])
    tall = wide.select("province", "year", F.explode(F.array(*[
        F.struct(F.lit(k).alias("months"), F.col(f"w{k}_t_max").alias("t_max"), F.col(f"w{k}_rain_mm").alias("rain_mm")) for k in range(1, 7)])).alias("w"))
    return tall.select("province", "year", "w.*").select("province", *ints("year", "months"), *r6("t_max", "rain_mm"))


@query("b12_interval_stage_features", "month ord", KEYS + """
    , iv as (select province % 5 as province, start_date as a, end_date as b, v from ord where end_date >= start_date), dd as (select province, cast(unnest(generate_series(a, b, interval 1 day)) as date) as day, v from iv), dn as (select province, day, count(*) as n, sum(v) as v from dd group by all),
    c as (select province, year, 'pre_bloom' as stage, cast(h - 120 + cast(unnest(range(-90, 0)) as int) as date) as day from hd union all select province, year, 'fruit', cast(h - 120 + cast(unnest(range(0, 120)) as int) as date) from hd)
    select c.province, cast(year as bigint) as year, stage, round(100.0 * coalesce(sum(n), 0) / count(*), 6) as coverage_pct, round(case when 100.0 * sum(n) / count(*) >= 50 then sum(dn.v) / sum(n) end, 4) as mean_value
    from c left join dn on dn.province = c.province and dn.day = c.day group by all""")
def _(t):
    intervals = t.ord.select((F.col("province") % 5).cast("int").alias("province"), "start_date", "end_date", "v")
    out = B.interval_features(seasons(t), intervals, ["province"], ["province", "year"], 120, "v", "start_date", "end_date")
    return out.select("province", *ints("year"), "stage", *r6("coverage_pct"), F.round("mean_value", 4).alias("mean_value"))


@query("b12_interval_year", "ord", """
    with iv as (select province, start_date as a, end_date as b, v, year(start_date) as y from ord), w as (select distinct province, y from iv),
    x as (select w.province, w.y, greatest(0, date_diff('day', greatest(a, make_date(cast(w.y as int), 1, 1)), least(b + 1, make_date(cast(w.y + 1 as int), 1, 1)))) as ov, v, date_diff('day', make_date(cast(w.y as int), 1, 1), make_date(cast(w.y + 1 as int), 1, 1)) as len from w join iv on iv.province = w.province and iv.b >= iv.a),
    p as (select province, y, quantile_cont(v, 0.1) as p10 from iv group by all)
    select cast(x.province as bigint) as province, cast(x.y as bigint) as year, round(100.0 * sum(ov) / max(len), 6) as coverage_pct, round(case when 100.0 * sum(ov) / max(len) >= 50 then sum(ov * v) / sum(ov) end, 4) as mean_value,
        round(case when 100.0 * sum(ov) / max(len) >= 50 then max(p10) end, 4) as p10 from x join p on p.province = x.province and p.y = x.y group by x.province, x.y""")
def _(t):
    out = B.interval_year(t.ord, ["province"], "v", "start_date", "end_date")
    return out.select(*ints("province", "year"), *r6("coverage_pct"), F.round("mean_value", 4).alias("mean_value"), F.round("p10", 4).alias("p10"))


CONTEXT = KEYS + """
    , ix as (select year_ce as ky, month as km, avg(tonnes) / 1000 as idx from month group by all),
    c as (select province, year, cohorts, cast(h - 120 + cast(unnest(range(0, 120)) as int) as date) as day from hd),
    x as (select c.province, c.year, case when count(d.day) = count(*) then sum(rain_mm) / max(cohorts) end as rain, case when count(d.day) = count(*) then avg(t_max) end as t_max, case when count(d.day) = count(*) then avg(solar) end as solar, case when count(idx) = count(*) then avg(idx) end as idx
        from c left join daily_full d on d.province = c.province and d.day = c.day left join ix on ix.ky = year(date_trunc('month', c.day) - interval 2 month) and ix.km = month(date_trunc('month', c.day) - interval 2 month) group by all)
"""


def _context(t):
    index = t.month.groupBy(F.col("year_ce").alias("key_year"), F.col("month").alias("key_month")).agg((F.avg("tonnes") / 1000).alias("index_value"))
    return B.climate_context(seasons(t), t.daily_full, index, ["province"], ["province", "year"], {k: MEASURES[k] for k in ("rain", "t_max", "solar")})


@query("b13_climate_context", "month daily_full", CONTEXT + "select province, cast(year as bigint) as year, round(rain, 6) as rain, round(t_max, 6) as t_max, round(solar, 6) as solar, round(idx, 6) as reference_index from x")
def _(t):
    return _context(t).select("province", *ints("year"), *r6("rain", "t_max", "solar", "reference_index"))


@query("b14_pick_age", "month daily_full", stages(*AGES) + """
    , e as (select c.province, c.year, age, case when count(d.day) = count(*) then sum(rain_mm) / max(cohorts) end as rain from c left join daily_full d on d.province = c.province and d.day = c.day where stage = 'pre_bloom_90d' group by all)
    select k.province, cast(k.year as bigint) as year, cast(120 + 10 * (k.year % 4) as bigint) as age, round(rain, 6) as rain from k left join e on e.province = k.province and e.year = k.year and e.age = 120 + 10 * (k.year % 4)""")
def _(t):
    bank = B.stage_exposure(seasons(t), t.daily_full, ["province"], ["province", "year"], AGES, {"rain": MEASURES["rain"]}, {"pre_bloom_90d": (-90, 0)})
    ages = seasons(t).select("province", "year", (120 + 10 * (F.col("year") % 4)).cast("int").alias("age"))
    return B.pick_age(bank, ages, ["province", "year"]).select("province", *ints("year", "age"), *r6("rain"))


@query("b15_state_features", "ord year", """
    with d as (select province, start_date, count(*) as n, min(state) as state from ord group by all), f as (select province, year_ce, make_date(cast(year_ce as int), 3, 1) + cast(province as int) as issue, make_date(cast(year_ce as int), 3, 20) as cutoff from year),
    m as (select f.*, (select max(start_date) from d where d.province = f.province and start_date < least(issue, cutoff)) as p from f), s as (select m.*, d.state, case when p is null then 'none' when d.n > 1 then 'ambiguous' when date_diff('day', p, least(issue, cutoff)) > 5 then 'stale' else 'ok' end as asof_status from m left join d on d.start_date = p and d.province = m.province)
    select cast(province as bigint) as province, cast(year_ce as bigint) as year_ce, asof_status, case when asof_status = 'ok' then cast(p as varchar) end as document_day, case when asof_status = 'ok' then (state = '1-URGENT')::int::double end as urgent, case when asof_status = 'ok' then (state = '5-LOW')::int::double end as low from s""")
def _(t):
    folds = t.year.select("province", "year_ce", F.date_add(F.make_date("year_ce", F.lit(3), F.lit(1)), F.col("province").cast("int")).alias("issue"), F.make_date("year_ce", F.lit(3), F.lit(20)).alias("cutoff"))
    docs = t.ord.select(F.col("province").cast(folds.schema["province"].dataType).alias("province"), "start_date", "state")
    out = B.state_features(folds, docs, "issue", "cutoff", "start_date", "state", ["1-URGENT", "5-LOW"], 5, ["province"])
    return out.select(*ints("province", "year_ce"), "asof_status", day("document_day"), F.col("state_1-URGENT").alias("urgent"), F.col("state_5-LOW").alias("low"))


@query("b16_soil_panel", "vint", """
    with h as (select location, valid as hour, avg(temp_c) as soil from vint group by all), i as (select *, cast(epoch(hour) / 3600 as bigint) as n from h),
    g as (select *, case when count(*) over (partition by location order by n range between 3 preceding and current row) = 4 then soil - max(soil) over (partition by location order by n range between 3 preceding and 3 preceding) end as d3,
        case when count(*) over (partition by location order by n range between current row and 3 following) = 4 then max(soil) over (partition by location order by n range between 3 following and 3 following) end as target from i),
    r as (select g.location, g.hour, v.issued, v.source, max(v.rain_mm) as rain, count(*) as k, count(distinct v.valid) as u from g join vint v on v.location = g.location and v.valid > g.hour and v.valid <= g.hour + interval 3 hour and greatest(v.issued, v.received) between g.hour - interval 24 hour and g.hour group by all),
    b as (select *, row_number() over (partition by location, hour order by issued desc, source) as rn from r where k = 3 and u = 3)
    select g.location, strftime(g.hour, '%Y-%m-%d %H:%M:%S') as hour, round(g.soil, 6) as soil, round(d3, 6) as soil_delta_3h, round(target, 6) as target_soil, strftime(g.hour + interval 3 hour, '%Y-%m-%d %H:%M:%S') as target_time,
        round(sin(2 * pi() * hour(g.hour + interval 7 hour) / 24), 6) as hour_sin, strftime(b.issued, '%Y-%m-%d %H:%M:%S') as issued, b.source, b.rain as rain_max from g left join b on b.location = g.location and b.hour = g.hour and b.rn = 1""")
def _(t):
    hourly = t.vint.groupBy("location", F.col("valid").alias("hour")).agg(F.avg("temp_c").alias("soil"))
    out = B.soil_panel(hourly, t.vint, ["location"], "hour", "soil", 3, {"rain_max": F.max("rain_mm")}, ["rain_mm"], 24, "Asia/Bangkok")
    return out.select("location", ts("hour").alias("hour"), *r6("soil", "soil_delta_3h", "target_soil"), ts("target_time").alias("target_time"), *r6("hour_sin"),
                      ts("issued").alias("issued"), "source", "rain_max")


@query("b17_sensor_training", "sensor", """
    select event_id, soil, round(sin(2 * pi() * (hour(recorded_at + interval 7 hour) + minute(recorded_at + interval 7 hour) / 60) / 24), 6) as hour_sin, round(cos(2 * pi() * dayofyear(recorded_at + interval 7 hour) / 365.25), 6) as doy_cos
    from sensor where sig1 <> 'error'""")
def _(t):
    rows = t.sensor.withColumn("device_id", F.when(F.col("sig1") != "error", F.col("device_id")))
    out = B.sensor_training(rows.unionByName(rows), "event_id", ["recorded_at"], ["event_id", "device_id", "recorded_at"], "recorded_at", "Asia/Bangkok")
    return out.select("event_id", "soil", *r6("hour_sin", "doy_cos"))


FOLDS = """
    with f as (select o as outer_year, y as fold_year, 'inner' as fold_stage from (values (1998), (1999), (2000)) a(o), generate_series(o - 2, o - 1) g(y) union all select o, o, 'outer' from (values (1998), (1999), (2000)) a(o)),
    r as (select f.*, province, year_ce, yield_v, case when year_ce < fold_year then 'train' else 'evaluation' end as role from f join year on year_ce <= fold_year union all select f.*, province, year_ce, null, 'forecast' from f join year on year_ce = fold_year)
"""


def folds(t):
    return B.nested_folds(t.year.select("province", "year_ce", "yield_v"), "year_ce", "yield_v", [1998, 1999, 2000], 2)


@query("b18_nested_folds", "year", FOLDS + """
    select cast(outer_year as bigint) as outer_year, cast(fold_year as bigint) as fold_year, fold_stage, role, cast(province as bigint) as province, cast(year_ce as bigint) as year_ce, round(yield_v, 6) as target from r""")
def _(t):
    return folds(t).select(*ints("outer_year", "fold_year"), "fold_stage", "role", *ints("province", "year_ce"), F.round("yield_v", 6).alias("target"))


@query("b18_fold_completeness", "year", FOLDS + """
    select cast(outer_year as bigint) as outer_year, cast(fold_year as bigint) as fold_year, fold_stage, role, cast(count(*) as bigint) as rows, cast(case when role = 'train' then 25 * (fold_year - 1995) else 25 end as bigint) as expected_rows,
        count(*) = case when role = 'train' then 25 * (fold_year - 1995) else 25 end as complete from r group by outer_year, fold_year, fold_stage, role""")
def _(t):
    out = B.fold_completeness(folds(t), "year_ce", 25, 1995)
    return out.select(*ints("outer_year", "fold_year"), "fold_stage", "role", *ints("rows", "expected_rows"), "complete")


@query("b19_target_pairs", "year", FOLDS + """
    select cast(outer_year as bigint) as outer_year, cast(fold_year as bigint) as fold_year, fold_stage, role, cast(r.province as bigint) as province, cast(r.year_ce as bigint) as year_ce, round(case when p.yield_v is not null then r.yield_v end, 6) as current, round(p.yield_v, 6) as prior, round(r.yield_v - p.yield_v, 6) as delta
    from r left join year p on p.province = r.province and p.year_ce = r.year_ce - 1 where role <> 'forecast'""")
def _(t):
    out = B.target_pairs(folds(t), t.year, ["province"], "year_ce", "yield_v")
    return out.select(*ints("outer_year", "fold_year"), "fold_stage", "role", *ints("province", "year_ce"), *r6("current", "prior", "delta"))


@query("b20_registry_aggregates", "", """
    with r as (select c_nationkey as nation, c_mktsegment as district, y, case when c_custkey % 11 = 0 then 0.0 else round(abs(c_acctbal), 2) + case when y = 2023 then 1 else 0 end end as area, c_custkey from customer cross join (values (2021), (2022), (2023)) v(y))
    select nation, district, cast(y as bigint) as year, cast(count(*) as bigint) as records, round(sum(area), 4) as area, cast(count(*) filter (area = 0) as bigint) as zero_area, y < 2023 as repeated_year from r group by all""")
def _(t):
    year = F.explode(F.array(F.lit(2021), F.lit(2022), F.lit(2023)))
    rows = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("district"), year.alias("year"), "c_custkey", "c_acctbal")
    rows = rows.withColumn("area", F.when(F.col("c_custkey") % 11 == 0, 0.0).otherwise(F.round(F.abs("c_acctbal"), 2) + F.when(F.col("year") == 2023, 1).otherwise(0)))
    out = B.registry_aggregates(rows, ["nation"], "district", "year", "area", ["district", "c_custkey", "area"])
    return out.select("nation", "district", *ints("year"), "records", F.round("area", 4).alias("area"), "zero_area", "repeated_year")
