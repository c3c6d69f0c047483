"""Run, episode, lag, rank, top-k and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamline.operators import aggregates as A
from loamline.operators import windows as W
from loamline.operators.quality import mask_range
from loamline.operators.scan import Series, balanced
from loamline.plans.registry import query

GAP = 12 * 3600
STALE_MINUTES = 360


def ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def ints(*names):
    return [F.col(c).cast("long").alias(c) for c in names]


def day(c):
    return F.col(c).cast("string").alias(c)


def series(t, df=None):
    return balanced(t.sensor if df is None else df, Series(("device_id",), "recorded_at", ("event_id",)))


def signed(t):
    """Readings whose second signature column has nulls."""
    return t.sensor.withColumn("sig2", F.when(F.col("valid"), F.col("sig2")))


@query("e01_gap_delta", "sensor", """
    with l as (select *, lag(soil) over w as was, date_diff('microsecond', lag(recorded_at) over w, recorded_at) / 1e6 / 60 as gap
        from sensor window w as (partition by device_id order by recorded_at, event_id))
    select event_id, round(gap, 9) as gap_minutes, round(case when gap <= 720 then soil - was end, 7) as delta from l""")
def _(t):
    out = W.gap_delta(t.sensor, series(t), "soil", GAP)
    return out.select("event_id", F.round("gap_minutes", 9).alias("gap_minutes"), F.round("delta", 7).alias("delta"))


RUNS = """
    with s as (select event_id, device_id, recorded_at, sig1, case when valid then sig2 end as sig2 from sensor),
    l as (select *, lag(sig1) over w as p1, lag(sig2) over w as p2, lag(recorded_at) over w as pt from s
        window w as (partition by device_id order by recorded_at, event_id)),
    b as (select *, sig1 is not null and sig2 is not null as complete, case when sig1 = p1 and sig2 = p2 {gap} then 0 else 1 end as brk from l),
    r as (select *, sum(brk) over (partition by device_id order by recorded_at, event_id rows unbounded preceding) as run from b),
    m as (select *, min(recorded_at) over (partition by device_id, run) as run_start, max(recorded_at) over (partition by device_id, run) as run_end from r)
"""
NEAR = "and epoch_us(recorded_at) - epoch_us(pt) <= 43200000000"


@query("e02_stale_runs", "sensor", RUNS.format(gap="") + """
    select event_id, round(case when complete then date_diff('microsecond', run_start, recorded_at) / 1e6 / 60 end, 9) as stale_minutes,
        complete and date_diff('microsecond', run_start, recorded_at) / 6e7 >= 360 as stale from m""")
def _(t):
    out = W.stale_runs(signed(t), series(t), ["sig1", "sig2"], STALE_MINUTES)
    return out.select("event_id", F.round("stale_minutes", 9).alias("stale_minutes"), "stale")


@query("e03_flatline_offline", "sensor", RUNS.format(gap=NEAR) + """
    select event_id, complete and date_diff('microsecond', run_start, run_end) / 6e7 >= 360 as flatline_offline from m""")
def _(t):
    out = W.flatline_offline(signed(t), series(t), ["sig1", "sig2"], STALE_MINUTES, GAP)
    return out.select("event_id", "flatline_offline")


@query("e03_flatline_runs", "sensor", RUNS.format(gap=NEAR) + """
    select device_id, strftime(run_start, '%Y-%m-%d %H:%M:%S') as run_start, strftime(run_end, '%Y-%m-%d %H:%M:%S') as run_end, cast(count(*) as bigint) as rows
    from m where complete and date_diff('microsecond', run_start, run_end) / 6e7 >= 360 group by all""")
def _(t):
    s = series(t)
    out = W.run_table(W.flatline_offline(signed(t), s, ["sig1", "sig2"], STALE_MINUTES, GAP), s)
    return out.select("device_id", ts("run_start").alias("run_start"), ts("run_end").alias("run_end"), "rows")


@query("e04_flatline_online", "sensor", RUNS.format(gap=NEAR) + """
    select event_id, complete and date_diff('microsecond', run_start, recorded_at) / 6e7 >= 360 as flatline_online from m""")
def _(t):
    return W.flatline_online(signed(t), series(t), ["sig1", "sig2"], STALE_MINUTES, GAP).select("event_id", "flatline_online")


@query("e05_full_path_lag_lead", "sensor", """
    with h as (select device_id % 5 as site, cast(floor(epoch(recorded_at) / 3600) as bigint) as h, avg(soil) as v from sensor group by all),
    n as (select *, case when v > 15 then v end as x from h)
    select cast(site as bigint) as site, h as hour, round(case when count(x) over (partition by site order by h range between 3 preceding and current row) = 4
            then x - max(x) over (partition by site order by h range between 3 preceding and 3 preceding) end, 7) as delta_3h,
        round(case when count(x) over (partition by site order by h range between current row and 6 following) = 7
            then max(x) over (partition by site order by h range between 6 following and 6 following) end, 7) as target_6h from n""")
def _(t):
    rows = t.sensor.withColumn("site", F.col("device_id") % 5)
    hourly = rows.groupBy("site", F.date_trunc("hour", "recorded_at").alias("hour_at")).agg(F.avg("soil").alias("v"))
    hourly = hourly.withColumn("x", F.when(F.col("v") > 15, F.col("v")))
    out = W.lag_delta_full(hourly, ["site"], "hour_at", "x", 3, "delta_3h")
    out = W.lead_target_full(out, ["site"], "hour_at", "x", 6, "target_6h")
    return out.select("site", F.floor(F.unix_seconds(F.col("hour_at").cast("timestamp")) / 3600).alias("hour"),
                      F.round("delta_3h", 7).alias("delta_3h"), F.round("target_6h", 7).alias("target_6h"))


@query("e06_pct_change", "year", """
    select cast(province as bigint) as province, cast(year_ce as bigint) as year_ce,
        round(100 * (yield_v / lag(yield_v) over (partition by province order by year_ce) - 1), 7) as pct_change from year""")
def _(t):
    out = W.pct_change(t.year, ["province"], "year_ce", "yield_v")
    return out.select(*ints("province", "year_ce"), F.round("pct_change", 7).alias("pct_change"))


@query("e07_rank_and_select", "year", """
    with l as (select y.*, n_regionkey as region from year y join nation on n_nationkey = province where year_ce = (select max(year_ce) from year)),
    r as (select *, row_number() over (order by production desc, province) as national_rank, row_number() over (partition by region order by production desc, province) as regional_rank from l)
    select cast(province as bigint) as province, cast(region as bigint) as region, cast(national_rank as bigint) as national_rank, cast(regional_rank as bigint) as regional_rank,
        case when national_rank <= 12 and regional_rank <= 3 then 'national_and_regional' when national_rank <= 12 then 'national' else 'regional' end as selection_reason
    from r where national_rank <= 12 or regional_rank <= 3""")
def _(t):
    newest = t.year.agg(F.max("year_ce").alias("year_ce"))
    latest = t.year.join(F.broadcast(newest), "year_ce").join(
        t.nation.select(F.col("n_nationkey").alias("province"), F.col("n_regionkey").alias("region")), "province")
    out = W.rank_select_regions(latest, "region", "production", ["province"])
    return out.select(*ints("province", "region", "national_rank", "regional_rank"), "selection_reason")


@query("e08_trailing_mean", "month", """
    select cast(province as bigint) as province, cast(year_ce * 12 + month as bigint) as period, round(case when count(tonnes) over w = 5 then avg(tonnes) over w end, 7) as trailing_mean
    from month window w as (partition by province order by year_ce * 12 + month rows between 5 preceding and 1 preceding)""")
def _(t):
    rows = t.month.withColumn("period", F.col("year_ce") * 12 + F.col("month"))
    out = W.trailing_mean(rows, ["province"], "period", "tonnes")
    return out.select(*ints("province", "period"), F.round("trailing_mean", 7).alias("trailing_mean"))


@query("e09_sliding_sums", "daily", """
    with d as (select *, year(day) as y, date_diff('day', date '1970-01-01', day) as n from daily),
    r as (select *, case when count(rain_mm) over a = 3 then sum(rain_mm) over a end as s3, case when count(rain_mm) over b = 7 then sum(rain_mm) over b end as s7 from d
        window a as (partition by province, y order by n range between 2 preceding and current row), b as (partition by province, y order by n range between 6 preceding and current row))
    select cast(province as bigint) as province, cast(y as bigint) as year, round(max(s3), 7) as rx3, round(max(s7), 7) as rx7 from r group by all""")
def _(t):
    rows = t.daily.withColumn("year", F.year("day"))
    a = W.rx_k(rows, ["province"], ["year"], "day", "rain_mm", 3)
    b = W.rx_k(rows, ["province"], ["year"], "day", "rain_mm", 7)
    return a.join(b, ["province", "year"]).select(*ints("province", "year"), F.round("rx3", 7).alias("rx3"), F.round("rx7", 7).alias("rx7"))


@query("e10_longest_run", "daily", """
    with d as (select province, year(day) as y, date_diff('day', date '1970-01-01', day) as n, rain_mm < 20 as ok from daily),
    i as (select *, n - row_number() over (partition by province, y order by n) as g from d where ok), c as (select province, y, g, count(*) as k from i group by all)
    select cast(d.province as bigint) as province, cast(d.y as bigint) as year, cast(coalesce(max(c.k), 0) as bigint) as dry_run
    from (select distinct province, y from d) d left join c on c.province = d.province and c.y = d.y group by all""")
def _(t):
    rows = t.daily.withColumn("year", F.year("day"))
    return W.longest_run(rows, ["province", "year"], "day", F.col("rain_mm") < 20, "dry_run").select(*ints("province", "year", "dry_run"))


DRY = """
    with n as (select *, date_diff('day', date '1970-01-01', day) as n from daily_full),
    m as (select *, case when count(rain_mm) over (partition by province order by n range between 14 preceding and current row) = 15
        then avg(rain_mm) over (partition by province order by n range between 14 preceding and current row) < 40 end as dry,
        max(rain_mm) over (partition by province order by n range between current row and 30 following) as ahead from n),
    c as (select *, coalesce(dry and not lag(dry) over (partition by province order by n), false) as crossing from m)
"""


@query("e11_dry_triggers", "daily_full", DRY + """
    select province, cast(day as varchar) as day, dry, crossing and ahead <= 170 as trigger, crossing and ahead > 170 as rejected from c""")
def _(t):
    out = W.dry_triggers(t.daily_full, ["province"], "day", "rain_mm", 40, 15, 170, 31)
    return out.select("province", day("day"), "dry", "trigger", "rejected")


@query("e11_trigger_search", "daily_full", DRY + """
    , s as (select province, y, make_date(cast(y as int), 2, 1) as a, make_date(cast(y as int), 7, 31) as b from (select distinct province, year(day) as y from daily_full where year(day) < 2002))
    select s.province, cast(y as bigint) as year, coalesce(string_agg(cast(case when crossing and ahead <= 170 and day > a then day end as varchar), ',' order by day), '') as triggers,
        cast(count(*) filter (crossing and ahead > 170 and day > a) as bigint) as rejected_rain_reset, coalesce(bool_or(dry and day = a), false) as left_censored,
        cast(date_diff('day', a, b) + 1 - count(dry) as bigint) as incomplete_days
    from s left join c on c.province = s.province and c.day between a and b group by s.province, y, a, b""")
def _(t):
    found = W.dry_triggers(t.daily_full, ["province"], "day", "rain_mm", 40, 15, 170, 31)
    searches = t.daily_full.select("province", F.year("day").alias("year")).distinct().select(
        "province", "year", F.make_date("year", F.lit(2), F.lit(1)).alias("start"), F.make_date("year", F.lit(7), F.lit(31)).alias("end"))
    out = W.trigger_search(found, searches, ["province"], "day")
    listed = F.array_join(F.transform("triggers", lambda d: d.cast("string")), ",")
    return out.select("province", *ints("year"), listed.alias("triggers"), "rejected_rain_reset", "left_censored", "incomplete_days")


@query("e12_rain_after_dry", "daily", """
    select province, cast(day as varchar) as day, case when count(rain_mm) over w = 7 then max(rain_mm) over w < 60 and rain_mm >= 80 end as rain_after_dry
    from (select *, date_diff('day', date '1970-01-01', day) as n from daily) window w as (partition by province order by n range between 7 preceding and 1 preceding)""")
def _(t):
    return W.rain_after_dry(t.daily, ["province"], "day", "rain_mm", 80, 60).select("province", day("day"), "rain_after_dry")


@query("e13_regime_streak", "month", """
    with a as (select province, year_ce * 12 + month as n, (tonnes - avg(tonnes) over (partition by province)) / 400 as x from month),
    r as (select *, case when x >= 0.5 then 'warm' when x <= -0.5 then 'cold' else 'neutral' end as regime from a),
    i as (select *, case when regime = lag(regime) over (partition by province order by n) then 0 else 1 end as nw from r),
    j as (select *, sum(nw) over (partition by province order by n rows unbounded preceding) as g from i),
    k as (select *, case when regime = 'neutral' then 0 else row_number() over (partition by province, g order by n) end as streak, lag(n) over (partition by province order by n) as pn from j)
    select cast(province as bigint) as province, cast(n as bigint) as season, regime, cast(streak as bigint) as streak, case when regime = 'neutral' then 'neutral' when streak < 3 then 'not_yet_persistent'
        else 'persistent_' || regime end as phase, coalesce(n - pn = 1, true) as sequence_ok from k""")
def _(t):
    mean = t.month.groupBy("province").agg(F.avg("tonnes").alias("m"))
    rows = t.month.join(mean, "province").select(
        "province", (F.col("year_ce") * 12 + F.col("month")).alias("season"), ((F.col("tonnes") - F.col("m")) / 400).alias("x"))
    out = W.regime_streak(rows, ["province"], "season", "x", persistent=3)
    return out.select(*ints("province", "season"), "regime", *ints("streak"), "phase", "sequence_ok")


EPISODES = """
    with l as (select *, soil >= 50 as high, lag(soil >= 50) over w as ph, lag(recorded_at) over w as pt from sensor window w as (partition by device_id order by recorded_at, event_id)),
    b as (select *, case when high and not coalesce(ph and epoch_us(recorded_at) - epoch_us(pt) <= 43200000000, false) then 1 else 0 end as st from l),
    g as (select *, sum(st) over (partition by device_id order by recorded_at, event_id rows unbounded preceding) as ep from b),
    e as (select device_id, ep, min(recorded_at) as start_at, max(recorded_at) as end_at, count(*) as rows, max(soil) as peak_value,
        arg_max(recorded_at, struct_pack(v := soil, t := -epoch_us(recorded_at), k := -event_id)) as peak_at, arg_max(event_id, struct_pack(v := soil, t := -epoch_us(recorded_at), k := -event_id)) as peak_id
        from g where high group by device_id, ep)
"""


@query("e14_episodes", "sensor", EPISODES + """
    select device_id, strftime(start_at, '%Y-%m-%d %H:%M:%S') as start_at, strftime(end_at, '%Y-%m-%d %H:%M:%S') as end_at, cast(rows as bigint) as rows,
        strftime(peak_at, '%Y-%m-%d %H:%M:%S') as peak_at, peak_value from e""")
def _(t):
    out = W.episodes(t.sensor, series(t), "soil", 50, GAP)
    return out.select("device_id", ts("start_at").alias("start_at"), ts("end_at").alias("end_at"), "rows", ts("peak_at").alias("peak_at"), "peak_value")


@query("e15_prior_interval", "month", """
    with e as (select province, year_ce, month, tonnes - 800 as err from month), m as (select province, year_ce, max(abs(err)) as mx from e group by all),
    p as (select e.province, e.year_ce, e.month, list_sort(list(m.mx)) as past from e left join m on m.province = e.province and m.year_ce between e.year_ce - 5 and e.year_ce - 1 group by all)
    select cast(province as bigint) as province, cast(year_ce as bigint) as year_ce, cast(month as bigint) as month,
        round(case when len(list_filter(past, lambda x: x is not null)) >= 5 then past[cast(ceil(6 * 0.8) as int)] end, 7) as radius from p""")
def _(t):
    out = W.prior_interval(t.month.withColumn("err", F.col("tonnes") - 800), ["province"], "year_ce", "err")
    return out.select(*ints("province", "year_ce", "month"), F.round("radius", 7).alias("radius"))


@query("e16_dedupe_last", "sensor", "select event_id, device_id, soil + 1000 as soil from sensor")
def _(t):
    copies = t.sensor.select("event_id", "device_id", "soil", F.lit(0).alias("seq")).unionByName(
        t.sensor.select("event_id", "device_id", (F.col("soil") + 1000).alias("soil"), F.lit(1).alias("seq")))
    return W.dedupe_last(copies, ["event_id"], ["seq"]).select("event_id", "device_id", "soil")


@query("e17_choice_switches", "ord", """
    with c as (select province, year(start_date) as y, max(state) filter (v > 100000) as best, count(*) % 3 as choice from ord group by all),
    l as (select *, lag(choice) over (partition by province order by y) as was from c)
    select cast(province as bigint) as province, cast(count(*) filter (was is not null and was <> choice) as bigint) as switches from l group by province""")
def _(t):
    yearly = t.ord.groupBy("province", F.year("start_date").alias("y")).agg((F.count("*") % 3).alias("choice"))
    return W.switches(yearly, ["province"], "y", "choice").select(F.col("province").cast("long"), "switches")


@query("e18_train_zscore", "year", """
    with r as (select province, avg(yield_v) m, stddev_pop(yield_v) s, count(*) n from year where year_ce <= 1998 group by province)
    select cast(province as bigint) as province, cast(year_ce as bigint) as year_ce, round(case when n >= 4 then (yield_v - m) / case when s = 0 then 1 else s end end, 6) as z from year join r using (province)""")
def _(t):
    out = W.train_zscore(t.year, ["province"], "year_ce", ["yield_v"], 1998)
    return out.select(*ints("province", "year_ce"), F.round("z_yield_v", 6).alias("z"))


@query("e19_train_anomaly", "year", """
    with r as (select province, avg(yield_v) m, avg(production) p from year where year_ce <= 1998 group by province)
    select cast(province as bigint) as province, cast(year_ce as bigint) as year_ce, round(yield_v - m, 7) as anomaly, round(100 * (production / p - 1), 7) as anomaly_pct from year join r using (province)""")
def _(t):
    out = W.train_anomaly(t.year, ["province"], "year_ce", ["yield_v"], ["production"], 1998)
    return out.select(*ints("province", "year_ce"), F.round("anomaly_yield_v", 7).alias("anomaly"), F.round("anomaly_pct_production", 7).alias("anomaly_pct"))


@query("k01_stable_sort", "sensor", "select device_id, event_id, soil from sensor")
def _(t):
    return W.stable_sort(t.sensor, "device_id", "recorded_at", "event_id").select("device_id", "event_id", "soil")


@query("k02_topk_per_group", "month", """
    with r as (select *, row_number() over (partition by province order by abs(tonnes - 800) desc, year_ce, month) as rank from month)
    select cast(province as bigint) as province, cast(year_ce as bigint) as year_ce, cast(month as bigint) as month, cast(rank as bigint) as rank from r where rank <= 5""")
def _(t):
    out = W.topk(t.month, ["province"], [F.desc(F.abs(F.col("tonnes") - 800)), F.col("year_ce"), F.col("month")], 5)
    return out.select(*ints("province", "year_ce", "month", "rank"))


@query("k03_argmin_config", "month", """
    with s as (select province, month as config, round(avg(abs(tonnes - 800)) / 50) as score from month group by all),
    r as (select *, row_number() over (partition by province order by score, config) as n from s)
    select cast(province as bigint) as province, cast(config as bigint) as config, score from r where n = 1""")
def _(t):
    scores = t.month.groupBy("province", F.col("month").alias("config")).agg(F.round(F.avg(F.abs(F.col("tonnes") - 800)) / 50).alias("score"))
    return W.argmin_config(scores, ["province"], "score", "config").select(*ints("province", "config"), "score")


@query("k04_near_best", "month", """
    with s as (select province, month as config, round(avg(tonnes) / 1000, 3) as score, round(stddev_pop(tonnes), 1) as spread, month % 3 as features, month % 2 as complexity from month group by all),
    b as (select *, max(score) over (partition by province) as best from s),
    r as (select *, row_number() over (partition by province order by spread, features, complexity, config) as n from b where score >= best - 0.1 - 1e-12)
    select cast(province as bigint) as province, cast(config as bigint) as config, score, spread from r where n = 1""")
def _(t):
    scores = t.month.groupBy("province", F.col("month").alias("config")).agg(
        F.round(F.avg("tonnes") / 1000, 3).alias("score"), F.round(F.stddev_pop("tonnes"), 1).alias("spread")).withColumns(
        {"features": F.col("config") % 3, "complexity": F.col("config") % 2})
    out = W.rank_select(scores, ["province"], "score", "spread", "features", "complexity", "config", 0.1)
    return out.select(*ints("province", "config"), "score", "spread")


@query("k05_latest_per_key", "log", """
    with r as (select *, row_number() over (partition by record_id order by version desc) as n from log where v > 100)
    select record_id, cast(version as bigint) as version, owner, v from r where n = 1""")
def _(t):
    out = W.latest_per_key(t.log, ["record_id"], ["version"], F.col("v") > 100)
    return out.select("record_id", F.col("version").cast("long").alias("version"), "owner", "v")


@query("k06_last_valid", "sensor", """
    with r as (select *, row_number() over (partition by device_id order by recorded_at desc, event_id desc) as n from sensor
        where valid and age_sec between 0 and 3600 and recorded_at <= timestamp '2024-01-25 00:00:00')
    select device_id, event_id, soil from r where n = 1""")
def _(t):
    out = W.last_valid(t.sensor, ["device_id"], "recorded_at", "event_id", F.col("valid"), "age_sec", ["soil", "temp_c"],
                       F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"))
    return out.select("device_id", "event_id", "soil")


@query("u01_concat", "year", """
    select cast(province as bigint) as province, cast(year_ce as bigint) as year_ce, round(production, 6) as v from year
    union all select cast(province as bigint), cast(year_ce as bigint), cast(area as double) from year""")
def _(t):
    a = t.year.select(*ints("province", "year_ce"), F.col("production").alias("v"))
    return W.concat(a, t.year.select(F.col("area").cast("double").alias("v"), *ints("year_ce", "province"))).withColumn("v", F.round("v", 6))


@query("u02_missing_periods", "month", """
    with e as (select province, y, m from (select distinct province from month) cross join generate_series(1995, 2001) a(y) cross join generate_series(1, 12) b(m))
    select cast(e.province as bigint) as province, cast(y as bigint) as year_ce, cast(m as bigint) as month from e
    where not exists (select 1 from month x where x.province = e.province and x.year_ce = y and x.month = m)""")
def _(t):
    want = t.month.select("province").distinct().withColumn("year_ce", F.explode(F.sequence(F.lit(1995), F.lit(2001)))).withColumn(
        "month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return W.missing_from(want, t.month, ["province", "year_ce", "month"]).select(*ints("province", "year_ce", "month"))


@query("u03_common_keys", "year month", """
    select cast(province as bigint) as province, cast(year_ce as bigint) as year_ce from year where year_ce > 1997
    intersect select cast(province as bigint), cast(year_ce as bigint) from month where tonnes > 900""")
def _(t):
    return W.common_keys(t.year.where("year_ce > 1997").select(*ints("province", "year_ce")),
                         t.month.where("tonnes > 900").select(*ints("province", "year_ce")), ["province", "year_ce"])


@query("u04_distinct_union", "", """
    select distinct c_nationkey as nation, c_mktsegment as segment from customer union select s_nationkey, 'SUPPLIER' from supplier""")
def _(t):
    return W.distinct_rows(t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")),
                           t.supplier.select(F.col("s_nationkey").alias("nation"), F.lit("SUPPLIER").alias("segment")))


@query("flagship_device_day_risk", "sensor", """
    with r0 as (select * replace (case when soil between 0 and 100 then soil end as soil) from sensor),
    l as (select *, lag(sig1) over w as p1, lag(sig2) over w as p2, lag(recorded_at) over w as pt from r0 window w as (partition by device_id order by recorded_at, event_id)),
    b as (select *, case when sig1 = p1 and sig2 = p2 and epoch_us(recorded_at) - epoch_us(pt) <= 43200000000 then 0 else 1 end as brk from l),
    r as (select *, sum(brk) over (partition by device_id order by recorded_at, event_id rows unbounded preceding) as run from b),
    m as (select *, date_diff('microsecond', min(recorded_at) over (partition by device_id, run), recorded_at) / 6e7 >= 360 as stuck from r),
    h as (select device_id, to_timestamp(ceil(epoch_us(recorded_at) / 3600000000) * 3600) as hour, avg(case when not stuck then soil end) as soil, avg(case when not stuck then rh end) as rh from m group by all)
    select device_id, strftime(cast(hour as timestamp), '%Y-%m-%d') as day, cast(count(soil) as bigint) as hours, round(avg(soil), 7) as mean_soil,
        cast(count(*) filter (soil >= 43.5 and rh >= 75) as bigint) as alerts,
        case when count(*) filter (soil >= 43.5 and rh >= 75) >= 0.5 * count(soil) then 'high' when count(*) filter (soil >= 43.5 and rh >= 75) >= 0.2 * count(soil) then 'medium' else 'low' end as risk_level
    from h group by all having count(soil) > 0""")
def _(t):
    rows = W.flatline_online(mask_range(t.sensor, {"soil": (0.0, 100.0)}), series(t), ["sig1", "sig2"], STALE_MINUTES, GAP)
    fresh = rows.withColumns({c: F.when(~F.col("flatline_online"), F.col(c)) for c in ("soil", "rh")})
    hourly = A.hourly_mean(fresh, ["device_id"], "recorded_at", ["soil", "rh"], min_n=1)
    alert = (F.col("soil") >= 43.5) & (F.col("rh") >= 75)
    out = hourly.groupBy("device_id", F.to_date("hour").alias("day")).agg(
        F.count("soil").alias("hours"), F.avg("soil").alias("mean_soil"), F.count_if(alert).alias("alerts")).where("hours > 0")
    level = F.when(F.col("alerts") >= 0.5 * F.col("hours"), "high").when(F.col("alerts") >= 0.2 * F.col("hours"), "medium").otherwise("low")
    return out.select("device_id", day("day"), "hours", F.round("mean_soil", 7).alias("mean_soil"), "alerts", level.alias("risk_level"))
