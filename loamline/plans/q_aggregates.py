"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamline.operators import aggregates as A

from loamline.plans.q_windows import day, ints, series, ts
from loamline.plans.registry import query


def r6(*names):
    return [F.round(c, 6).alias(c) for c in names]


def errors(t):
    """Predictions for the annual panel: last year's yield and a flat guess against the actual value."""
    was = t.year.select("province", (F.col("year_ce") + 1).alias("year_ce"), F.col("yield_v").alias("predicted"))
    a = t.year.select("province", "year_ce", F.col("yield_v").alias("actual")).join(was, ["province", "year_ce"]).withColumn("model", F.lit("previous"))
    b = t.year.where("year_ce > 1995").select("province", "year_ce", F.col("yield_v").alias("actual"), F.lit(250000.0).alias("predicted"), F.lit("flat").alias("model"))
    return a.unionByName(b)


ERRORS = """
    e as (select a.province, a.year_ce, a.yield_v as actual, b.yield_v as predicted, 'previous' as model from year a join year b on a.province = b.province and b.year_ce = a.year_ce - 1
        union all select province, year_ce, yield_v, 250000.0, 'flat' from year where year_ce > 1995)
"""


@query("a01_monthly_climate", "daily", """
    select province, cast(year(day) as bigint) as year, cast(month(day) as bigint) as month, round(avg(t_max), 6) as t_max_mean, round(sum(rain_mm), 6) as rain_mm_sum,
        round(max(t_min), 6) as t_min_max, round(min(t_min), 6) as t_min_min, cast(count(t_max) as bigint) as t_max_days, cast(count(rain_mm) as bigint) as rain_mm_days,
        cast(max(day(last_day(day))) as bigint) as expected_days from daily group by all""")
def _(t):
    out = A.monthly_climate(t.daily, ["province"], "day", ["t_max"], ["rain_mm"], ["t_min"])
    return out.select("province", *ints("year", "month"), *r6("t_max_mean", "rain_mm_sum", "t_min_max", "t_min_min"), "t_max_days", "rain_mm_days", *ints("expected_days"))


@query("a02_annual_climate", "daily", """
    select province, cast(year(day) as bigint) as year, round(avg(t_max), 6) as t_max_mean, round(sum(rain_mm), 6) as rain_mm_sum, cast(count(t_max) as bigint) as t_max_days, cast(count(rain_mm) as bigint) as rain_mm_days
    from daily group by all""")
def _(t):
    out = A.annual_climate(t.daily, ["province"], "day", ["t_max"], ["rain_mm"])
    return out.select("province", *ints("year"), *r6("t_max_mean", "rain_mm_sum"), "t_max_days", "rain_mm_days")


@query("a03_annual_from_months", "month", """
    with m as (select *, day(last_day(make_date(cast(year_ce as int), cast(month as int), 1))) as d, case when tonnes > 500 then tonnes end as x from month)
    select cast(province as bigint) as province, cast(year_ce as bigint) as year_ce, round(case when count(tonnes) = 12 then sum(tonnes * d) / sum(d) end, 6) as mean, round(case when count(x) = 12 then sum(x) end, 6) as total,
        cast(count(*) filter (x is not null) as bigint) as complete_months from m group by all""")
def _(t):
    rows = t.month.select("province", "year_ce", "month", F.col("tonnes").alias("mean"), F.when(F.col("tonnes") > 500, F.col("tonnes")).alias("total"))
    out = A.annual_from_months(rows, ["province"], "year_ce", "month", ["mean"], ["total"])
    return out.select(*ints("province", "year_ce"), *r6("mean", "total"), "complete_months")


@query("a04_weighted_mean_covered", "part_area", """
    with w as (select *, area / sum(area) over (partition by province) as w, case when province % 2 = 0 or code <> 'PROMO' then cast(n as double) end as v from part_area)
    select cast(province as bigint) as province, round(coalesce(sum(w) filter (v is not null), 0), 6) as coverage, round(case when abs(sum(w) filter (v is not null) - 1) <= 1e-7 then sum(v * w) / sum(w) filter (v is not null) end, 6) as mean
    from w group by province""")
def _(t):
    rows = A.share_of_total(t.part_area, ["province"], "area", "w").withColumn(
        "v", F.when((F.col("province") % 2 == 0) | (F.col("code") != "PROMO"), F.col("n").cast("double")))
    out = A.weighted_mean_covered(rows, ["province"], "v", "w")
    return out.select(*ints("province"), *r6("coverage", "mean"))


@query("a05_ratio_of_sums", "year", """
    select n_regionkey as region, cast(year_ce as bigint) as year_ce, round(sum(case when area > 90 then production end) * 1000 / sum(case when area > 90 then area end), 6) as ratio,
        cast(count(*) filter (area > 90) as bigint) as observed, cast(count(*) as bigint) as members from year join nation on n_nationkey = province group by all""")
def _(t):
    rows = t.year.join(t.nation.select(F.col("n_nationkey").alias("province"), F.col("n_regionkey").alias("region")), "province").withColumn(
        "production", F.when(F.col("area") > 90, F.col("production")))
    out = A.ratio_of_sums(rows, ["region", "year_ce"], "production", "area")
    return out.select("region", *ints("year_ce"), *r6("ratio"), "observed", "members")


@query("a06_share_and_peak", "month", """
    with s as (select *, tonnes / sum(tonnes) over (partition by province, year_ce) as share from month)
    select cast(province as bigint) as province, cast(year_ce as bigint) as year_ce, cast(arg_max(month, struct_pack(t := tonnes, m := -month)) as bigint) as month, round(max(share), 9) as share from s group by all""")
def _(t):
    shares = A.share_of_total(t.month, ["province", "year_ce"], "tonnes")
    out = A.peak_of_group(shares, ["province", "year_ce"], "tonnes", ["month"])
    return out.select(*ints("province", "year_ce", "month"), F.round("share", 9).alias("share"))


@query("a07_climatology_anomaly", "month", """
    with c as (select province, month, avg(tonnes) as normal, count(*) as k from month where year_ce between 1995 and 1998 and tonnes > 300 group by all)
    select cast(m.province as bigint) as province, cast(year_ce as bigint) as year_ce, cast(m.month as bigint) as month, round(normal, 9) as normal, cast(k as bigint) as normal_years, round(tonnes - normal, 9) as anomaly
    from month m left join c on c.province = m.province and c.month = m.month""")
def _(t):
    out = A.climatology_anomaly(t.month, ["province"], "year_ce", "month", "tonnes", 1995, 1998, F.col("tonnes") > 300)
    return out.select(*ints("province", "year_ce", "month"), F.round("normal", 9).alias("normal"), "normal_years", F.round("anomaly", 9).alias("anomaly"))


@query("a08_calendar_normals", "daily", """
    with k as (select distinct province, year(day) as y from daily), d as (select *, strftime(day, '%m-%d') as mmdd, year(day) as y from daily),
    s as (select k.province, k.y, d.mmdd, case when count(*) >= 3 then avg(t_max) end as t_max from k join d on d.province = k.province and d.y between k.y - 4 and k.y - 1 where mmdd <> '02-29' group by all),
    f as (select province, y, '02-29' as mmdd, case when count(t_max) = 2 then sum(t_max) / 2 end as t_max from s where mmdd in ('02-28', '03-01') group by all)
    select province, cast(y as bigint) as year, mmdd, round(t_max, 6) as t_max from (select * from s union all select * from f)""")
def _(t):
    keys = t.daily.select("province", F.year("day").alias("year")).distinct()
    out = A.calendar_normals(t.daily, keys, ["province"], "day", "year", ["t_max"], 4, 3)
    return out.select("province", *ints("year"), "mmdd", *r6("t_max"))


@query("a09_robust_stats", "sensor", """
    with v as (select 'soil' as feature, soil as v from sensor union all select 'temp_c', temp_c from sensor union all select 'flat', 1.0 from sensor),
    q as (select feature, count(*) n, quantile_cont(v, 0.25) q1, quantile_cont(v, 0.5) m, quantile_cont(v, 0.75) q3, count(distinct v) d from v group by feature)
    select feature, cast(n as bigint) as n, round(m, 6) as median, round(quantile_cont(abs(v - m), 0.5), 6) as mad, round(q1, 6) as q1, round(q3, 6) as q3, quantile_cont(abs(v - m), 0.5) > 0 and d > 1 as usable
    from v join q using (feature) group by feature, n, m, q1, q3, d""")
def _(t):
    out = A.robust_stats(t.sensor.withColumn("flat", F.lit(1.0)), ["soil", "temp_c", "flat"])
    return out.select("feature", "n", *r6("median", "mad", "q1", "q3"), "usable")


@query("a10_daily_sensor", "sensor", """
    select device_id, cast(cast(recorded_at as date) as varchar) as day, cast(count(*) as bigint) as rows, min(soil) as min_value, max(soil) as max_value,
        arg_min(soil, struct_pack(t := recorded_at, e := event_id)) as first_value, arg_max(soil, struct_pack(t := recorded_at, e := event_id)) as last_value, cast(count(*) filter (valid) as bigint) as valid_rows,
        cast(count(*) filter (sig2 > 0) as bigint) as sig2_positive_rows, cast(count(sig2) as bigint) as sig2_available_rows from sensor group by all""")
def _(t):
    return A.daily_sensor(t.sensor, ["device_id"], "recorded_at", "event_id", "soil", ["valid"], ["sig2"]).withColumn("day", F.col("day").cast("string"))


@query("a11_environment_risk", "sensor", """
    with s as (select event_id, device_id, recorded_at, soil, rh, temp_c, sig1, case when valid then sig2 end as sig2 from sensor),
    l as (select *, lag(sig1) over w as p1, lag(sig2) over w as p2 from s window w as (partition by device_id order by recorded_at, event_id)),
    r as (select *, sig2 is not null as complete, sum(case when sig1 = p1 and sig2 = p2 then 0 else 1 end) over (partition by device_id order by recorded_at, event_id rows unbounded preceding) as run from l),
    m as (select *, complete and date_diff('microsecond', min(recorded_at) over (partition by device_id, run), recorded_at) / 6e7 >= 360 as stale from r),
    u as (select *, complete and not stale as usable, complete and not stale and (soil >= 43.5)::int + (rh >= 75)::int + (sig2 > 0)::int >= 2 as alert from m),
    d as (select device_id, cast(recorded_at + interval 7 hour as date) as day, count(*) as readings, count(*) filter (usable) as usable, count(*) filter (stale) as stale, avg(soil) as mean_soil, avg(rh) filter (usable) as mean_humidity,
        sum(case when usable then sig2 else 0 end) as rain_sum, avg(temp_c) filter (usable) as mean_light, max(temp_c) filter (usable) as max_light, sum(temp_c) filter (usable) * 0.25 / 1000 as light_exposure, count(*) filter (alert) as alerts from u group by all)
    select device_id, cast(day as varchar) as day, cast(readings as bigint) as readings, cast(usable as bigint) as usable, cast(stale as bigint) as stale, round(mean_soil, 6) as mean_soil, round(mean_humidity, 6) as mean_humidity, cast(rain_sum as double) as rain_sum,
        round(mean_light, 6) as mean_light, max_light, round(light_exposure, 6) as light_exposure, cast(alerts as bigint) as alerts, round(case when usable > 0 then alerts / usable else 0 end, 6) as alert_rate,
        case when usable > 0 and alerts >= 0.5 * usable then 'high' when usable > 0 and alerts >= 0.2 * usable then 'medium' else 'low' end as risk_level from d""")
def _(t):
    rows = t.sensor.withColumn("sig2", F.when(F.col("valid"), F.col("sig2")))
    out = A.environment_risk_daily(rows, series(t), ["sig1", "sig2"], "soil", "rh", "sig2", "temp_c", "Asia/Bangkok", 360)
    return out.select("device_id", day("day"), "readings", "usable", "stale", *r6("mean_soil", "mean_humidity"), F.col("rain_sum").cast("double").alias("rain_sum"),
                      *r6("mean_light"), "max_light", *r6("light_exposure"), "alerts", *r6("alert_rate"), "risk_level")


@query("a12_hourly_mean", "sensor", """
    select device_id % 5 as site, strftime(cast(make_timestamp(cast(ceil(epoch_us(recorded_at) / 3600000000) as bigint) * 3600000000) as timestamp), '%Y-%m-%d %H:%M:%S') as hour,
        round(case when count(soil) >= 3 then avg(soil) end, 6) as soil, cast(count(soil) as bigint) as soil_n from sensor group by all""")
def _(t):
    out = A.hourly_mean(t.sensor.withColumn("site", F.col("device_id") % 5), ["site"], "recorded_at", ["soil"])
    return out.select("site", ts("hour").alias("hour"), *r6("soil"), "soil_n")


@query("a13_history_rollup", "sensor", """
    with h as (select device_id, date_trunc('hour', recorded_at) as h, count(*) n, avg(soil) v, count(soil) c, arg_max(temp_c, struct_pack(t := recorded_at, e := event_id)) l, max(struct_pack(t := recorded_at, e := event_id)) k, max(rh) x from sensor group by all),
    d as (select device_id, cast(h as date) as day, sum(n) as raw_count, avg(v) as m, sum(c) as c, arg_max(l, k) as l, max(x) as x from h group by all),
    g as (select device_id, cast(unnest(generate_series(min(day), max(day), interval 1 day)) as date) as day from d group by device_id)
    select g.device_id, cast(g.day as varchar) as day, cast(coalesce(raw_count, 0) as bigint) as raw_count, round(m, 6) as soil_mean, cast(coalesce(c, 0) as bigint) as soil_count, l as temp_c_last, x as rh_peak from g left join d using (device_id, day)""")
def _(t):
    out = A.history_rollup(t.sensor, ["device_id"], "recorded_at", "event_id", ["soil"], ["temp_c"], ["rh"])
    return out.select("device_id", day("day"), "raw_count", *r6("soil_mean"), "soil_count", "temp_c_last", "rh_peak")


METRICS = "cast(count(*) as bigint) as n, round(avg(abs(predicted - actual)), 4) as mae, round(sqrt(avg((predicted - actual) * (predicted - actual))), 4) as rmse, round(avg(predicted - actual), 4) as bias"


def m4(*names):
    return [F.round(c, 4).alias(c) for c in names]


@query("a14_error_metrics", "year", "with " + ERRORS + f"select model, cast(year_ce as bigint) as year_ce, {METRICS} from e group by all")
def _(t):
    return A.error_metrics(errors(t), ["model", "year_ce"]).select("model", *ints("year_ce"), "n", *m4("mae", "rmse", "bias"))


@query("a15_extended_metrics", "year", "with " + ERRORS + f"""
    , m as (select *, avg(actual) over (partition by model) as mu from e)
    select model, {METRICS}, round(max(abs(predicted - actual)), 4) as max_abs, round(100 * sum(abs(predicted - actual)) / sum(abs(actual)), 6) as wape_pct,
        round(1 - sum(pow(predicted - actual, 2)) / sum(pow(actual - mu, 2)), 6) as r2, round(100 * avg(abs(predicted - actual) / actual), 6) as mape_pct,
        round(quantile_cont(abs(predicted - actual), 0.5), 4) as median_abs, round(quantile_cont(abs(predicted - actual), 0.9), 4) as p90_abs from m group by model""")
def _(t):
    out = A.error_metrics_ext(errors(t), ["model"])
    return out.select("model", "n", *m4("mae", "rmse", "bias", "max_abs"), *r6("wape_pct", "r2", "mape_pct"), *m4("median_abs", "p90_abs"))


@query("a16_metrics_by_grain", "year", "with " + ERRORS + f"""
    select model, cast(province as bigint) as province, cast(year_ce as bigint) as year_ce, {METRICS} from e group by grouping sets ((model), (model, province), (model, year_ce))""")
def _(t):
    out = A.metrics_by(errors(t), [["model"], ["model", "province"], ["model", "year_ce"]], ["model", "province", "year_ce"])
    return out.select("model", *ints("province", "year_ce"), "n", *m4("mae", "rmse", "bias"))


@query("a17_paired_gain", "year", "with " + ERRORS + """
    , g as (select a.model, a.province, abs(b.predicted - b.actual) - abs(a.predicted - a.actual) as gain, abs(a.predicted - a.actual) e, abs(b.predicted - b.actual) eb from e a join e b on a.province = b.province and a.year_ce = b.year_ce and b.model = 'flat' where a.model <> 'flat')
    select cast(province as bigint) as province, model, cast(count(*) as bigint) as n, cast(count(*) filter (gain > 1e-9) as bigint) as wins, cast(count(*) filter (abs(gain) <= 1e-9) as bigint) as ties, cast(count(*) filter (gain < -1e-9) as bigint) as losses,
        round(avg(gain), 4) as mean_gain, round(100 * (1 - avg(e) / avg(eb)), 4) as mae_reduction_pct, round(100 * (1 - sqrt(avg(e * e)) / sqrt(avg(eb * eb))), 4) as rmse_reduction_pct, round(quantile_cont(gain, 0.5), 4) as median_gain from g group by all""")
def _(t):
    out = A.paired_gain(errors(t), ["year_ce"], ["province"], "model", "flat")
    return out.select(*ints("province"), "model", "n", "wins", "ties", "losses", *m4("mean_gain", "mae_reduction_pct", "rmse_reduction_pct", "median_gain"))


@query("a18_class_metrics", "sensor", """
    with p as (select sig1, (soil > 50)::int as a, (temp_c > 27)::int as b from sensor), c as (select sig1, count(*) n, count(*) filter (a=1 and b=1) tp, count(*) filter (a=0 and b=0) tn, count(*) filter (a=0 and b=1) fp, count(*) filter (a=1 and b=0) fn from p group by sig1)
    select sig1, cast(n as bigint) as n, cast(tp as bigint) as tp, cast(tn as bigint) as tn, cast(fp as bigint) as fp, cast(fn as bigint) as fn, round((tp + tn) / n, 6) as accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) as balanced_accuracy,
        round(tp / (tp + fp), 6) as precision1, round(tn / (tn + fn), 6) as precision0, round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 6) as macro_f1 from c""")
def _(t):
    rows = t.sensor.select("sig1", (F.col("soil") > 50).cast("int").alias("a"), (F.col("temp_c") > 27).cast("int").alias("b"))
    out = A.class_metrics(rows, ["sig1"], "a", "b")
    return out.select("sig1", "n", "tp", "tn", "fp", "fn", *r6("accuracy", "balanced_accuracy", "precision1", "precision0", "macro_f1"))


MONTHS = [f"m{m}" for m in range(1, 13)]


@query("a19_pivot_items", "month", """
    select cast(province as bigint) as province, cast(year_ce as bigint) as year_ce, round(max(case when month = 1 then tonnes end), 6) as m1, round(max(case when month = 2 then tonnes end), 6) as m2, round(max(case when month = 3 then tonnes end), 6) as m3, round(max(case when month = 4 then tonnes end), 6) as m4, round(max(case when month = 5 then tonnes end), 6) as m5, round(max(case when month = 6 then tonnes end), 6) as m6, round(max(case when month = 7 then tonnes end), 6) as m7, round(max(case when month = 8 then tonnes end), 6) as m8, round(max(case when month = 9 then tonnes end), 6) as m9, round(max(case when month = 10 then tonnes end), 6) as m10, round(max(case when month = 11 then tonnes end), 6) as m11, round(max(case when month = 12 then tonnes end), 6) as m12 from month group by all""")
def _(t):
    rows = t.month.select("province", "year_ce", F.concat(F.lit("m"), "month").alias("item"), "tonnes")
    out = A.pivot_items(rows, ["province", "year_ce"], "item", "tonnes", MONTHS)
    return out.select(*ints("province", "year_ce"), *r6(*MONTHS))


@query("a20_unpivot_metrics", "", """
    with s as (select c_nationkey as nation, count(*) filter (c_acctbal >= 0) as a, count(*) filter (c_acctbal < 0) as b, count(*) as c, round(sum(c_acctbal) filter (c_acctbal >= 0), 2) as x, round(sum(c_acctbal) filter (c_acctbal < 0), 2) as y, round(sum(c_acctbal), 2) + max(c_nationkey % 2) as z from customer group by all)
    select nation, status, metric, cast(value as double) as value, sums_ok from s cross join lateral (values ('valid', 'count', a, true), ('expired', 'count', b, true), ('all', 'count', c, true), ('valid', 'balance', x, nation % 2 = 0), ('expired', 'balance', y, nation % 2 = 0), ('all', 'balance', z, nation % 2 = 0)) v(status, metric, value, sums_ok)""")
def _(t):
    c = F.col("c_acctbal")
    rows = t.customer.groupBy(F.col("c_nationkey").alias("nation")).agg(
        F.count_if(c >= 0).alias("valid_count"), F.count_if(c < 0).alias("expired_count"), F.count("*").alias("all_count"),
        F.round(F.sum(F.when(c >= 0, c)), 2).alias("valid_balance"), F.round(F.sum(F.when(c < 0, c)), 2).alias("expired_balance"),
        F.round(F.sum(c), 2).alias("all_balance")).withColumn("all_balance", F.col("all_balance") + F.col("nation") % 2)
    return A.unpivot_metrics(rows, ["nation"], ["valid", "expired", "all"], ["count", "balance"], "all", ["valid", "expired"])


REGISTRY_ROWS = """
    with r as (select c_nationkey as nation, c_mktsegment as code, c_custkey as source_row, case when c_custkey % 9 = 0 then null when c_nationkey % 4 = 0 then round(100.0 + c_custkey % 3, 1) else 101.5 end as lon, case when c_custkey % 9 = 0 then null else 13.5 end as lat, case when c_nationkey % 5 = 0 then c_custkey % 2 else 0 end as district from customer),
    g as (select nation, code, count(*) as members, count(distinct lon) as k, count(lon) as c, min(district) <> max(district) as metadata_conflict, arg_min(lon, source_row) as f, min(source_row) as source_row from r group by all)
"""


def registry_rows(t):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return t.customer.select(
        n.alias("nation"), F.col("c_mktsegment").alias("code"), k.alias("source_row"),
        F.when(k % 9 == 0, None).when(n % 4 == 0, 100.0 + k % 3).otherwise(101.5).alias("lon"), F.when(k % 9 != 0, 13.5).alias("lat"),
        F.when(n % 5 == 0, k % 2).otherwise(0).alias("district"))


@query("a21_collapse_registry", "", REGISTRY_ROWS + """
    select nation, code, cast(members as bigint) as members, k > 1 or (c > 0 and c < members) as coordinate_conflict, metadata_conflict, source_row from g""")
def _(t):
    out = A.collapse_registry(registry_rows(t), ["nation", "code"], "lon", "lat", ["district"], ["source_row"])
    return out.select("nation", "code", "members", "coordinate_conflict", "metadata_conflict", "source_row")


@query("a22_exclusion_accounting", "", REGISTRY_ROWS + """
    , e as (select *, case when k > 1 or (c > 0 and c < members) then 'conflict' when c = 0 then 'missing' end as reason from g)
    select nation, cast(sum(members) as bigint) as source_rows, cast(count(*) filter (reason is null) as bigint) as kept, cast(coalesce(sum(members - 1) filter (reason is null), 0) as bigint) as duplicates,
        cast(coalesce(sum(members) filter (reason is not null), 0) as bigint) as excluded, true as adds_up from e group by nation""")
def _(t):
    out = A.collapse_registry(registry_rows(t), ["nation", "code"], "lon", "lat", ["district"], ["source_row"])
    reason = F.when(F.col("coordinate_conflict"), "conflict").when(F.col("lon").isNull(), "missing")
    return A.exclusion_accounting(out.withColumn("reason", reason), ["nation"], "reason", "members")


@query("a23_shared_coordinate", "pts", """
    select point_id, count(*) over (partition by round(lon, 1), round(lat, 1)) > 1 as shared_coordinate from pts""")
def _(t):
    rows = t.pts.select("point_id", F.round("lon", 1).alias("x"), F.round("lat", 1).alias("y"))
    return A.shared_coordinate(rows, "point_id", "x", "y").select("point_id", "shared_coordinate")


@query("a24_hazard_summary", "", """
    with u as (select event_type, user_id, cast(ts as date) as d, count(*) as n, max(case when value > 80 then null when value < 10 then 0 else floor(value) end) as v from events group by all)
    select event_type as hazard, cast(sum(n) as bigint) as source_rows, cast(coalesce(sum(n) filter (n > 1), 0) as bigint) as quarantined_rows, cast(count(v) filter (n = 1) as bigint) as known_units,
        cast(count(*) filter (n = 1 and v is null) as bigint) as blank_units, cast(count(*) filter (n = 1 and v = 0) as bigint) as zero_units, cast(count(*) filter (n = 1 and v > 0) as bigint) as positive_units, cast(sum(v) filter (n = 1) as double) as known_sum from u group by event_type""")
def _(t):
    v = F.when(F.col("value") > 80, None).when(F.col("value") < 10, 0).otherwise(F.floor("value"))
    rows = t.events.select(F.col("event_type").alias("hazard"), F.concat_ws("-", "user_id", F.to_date("ts")).alias("village"), v.alias("v"))
    return A.hazard_summary(rows, ["hazard"], "village", "v").withColumn("known_sum", F.col("known_sum").cast("double"))


@query("a25_weighted_summary", "month", """
    select cast(province as bigint) as province, cast(year_ce as bigint) as year_ce, round(sum(tonnes), 6) as total_weight, round(sum(tonnes * month) / sum(tonnes), 6) as timing,
        round(case when count(case when tonnes > 400 then tonnes end) = count(*) then sum(tonnes * tonnes) / sum(tonnes) end, 6) as size from month group by all""")
def _(t):
    rows = t.month.select("province", "year_ce", "tonnes", F.col("month").cast("double").alias("timing"), F.when(F.col("tonnes") > 400, F.col("tonnes")).alias("size"))
    out = A.weighted_summary(rows, ["province", "year_ce"], "tonnes", ["timing", "size"])
    return out.select(*ints("province", "year_ce"), *r6("total_weight", "timing", "size"))


@query("a26_correlation", "year", "select cast(province as bigint) as province, round(corr(production, area), 6) as r from year group by all")
def _(t):
    return t.year.groupBy("province").agg(F.corr("production", "area").alias("r")).select(*ints("province"), *r6("r"))


@query("a27_training_seasons", "month", """
    with s as (select province, month, sum(tonnes) as t from month where year_ce <= 1998 group by all), p as (select province, arg_max(month, struct_pack(t := t, m := -month)) as peak from s group by province)
    select cast(province as bigint) as province, cast(peak as bigint) as peak_month, cast(greatest(1, least(10, peak - 1)) as bigint) as season_start from p""")
def _(t):
    return A.training_seasons(t.month, ["province"], "year_ce", "month", "tonnes", 1998).select(*ints("province", "peak_month", "season_start"))


@query("a28_peak_window", "month", """
    with w as (select province, year_ce, s, sum(tonnes) as t from month join generate_series(1, 10) g(s) on month between s and s + 2 group by all)
    select cast(province as bigint) as province, cast(year_ce as bigint) as year_ce, cast(arg_max(s, struct_pack(t := t, m := -s)) as bigint) as start_month, round(max(t), 6) as window_total from w group by all""")
def _(t):
    out = A.peak_window(t.month, ["province", "year_ce"], "month", "tonnes")
    return out.select(*ints("province", "year_ce", "start_month"), *r6("window_total"))


@query("a29_coverage", "daily", """
    with c as (select province, day, 'rain_mm' as parameter, rain_mm < 100 as ok from daily union all select province, day, 't_max', t_max > 30 from daily)
    select province, parameter, cast(min(day) filter (ok) as varchar) as first_valid, cast(max(day) filter (ok) as varchar) as last_valid, cast(count(*) filter (ok) as bigint) as valid_days, cast(count(*) filter (not ok) as bigint) as missing_days from c group by all""")
def _(t):
    rows = t.daily.select("province", "day", F.when(F.col("rain_mm") < 100, F.col("rain_mm")).alias("rain_mm"), F.when(F.col("t_max") > 30, F.col("t_max")).alias("t_max"))
    out = A.coverage(rows, ["province"], "day", ["rain_mm", "t_max"])
    return out.select("province", "parameter", day("first_valid"), day("last_valid"), "valid_days", "missing_days")


@query("a30_collect_attributes", "", """
    select p_brand as brand, string_agg(distinct p_type, ' / ' order by p_type) as types, string_agg(distinct p_name, ' / ' order by p_name) as names from part group by p_brand""")
def _(t):
    rows = t.part.select(F.col("p_brand").alias("brand"), F.concat(F.lit(" "), "p_type").alias("types"), F.col("p_name").alias("names"))
    return A.collect_attrs(rows, ["brand"], ["types", "names"])


@query("a31_composition", "part_area", """
    with p as (select province, code, sum(area) as area from part_area where cls <> 'Brand#1' group by all), w as (select province, sum(area) as whole from part_area group by all),
    b as (select * from p union all select w.province, 'UNCOVERED', whole - coalesce((select sum(area) from p where p.province = w.province), 0) from w)
    select cast(b.province as bigint) as province, code, cast(b.area as double) as area, round(100.0 * b.area / whole, 6) as share_pct from b join w on w.province = b.province""")
def _(t):
    whole = t.part_area.groupBy("province").agg(F.sum("area").cast("double").alias("whole"))
    parts = t.part_area.where("cls <> 'Brand#1'").withColumn("area", F.col("area").cast("double"))
    out = A.composition(parts, ["province"], "code", "area", whole, "whole")
    return out.select(*ints("province"), "code", "area", *r6("share_pct"))


@query("a32_fixed_share_allocation", "year", """
    with y as (select year.*, n_regionkey as region from year join nation on n_nationkey = province), s as (select region, province, year_ce, production / sum(production) over (partition by region, year_ce) as s from y where year_ce in (1996, 1998)),
    w as (select region, province, sum(s) / 2 as weight from s group by all), tot as (select region, year_ce, sum(production) as total from y where year_ce not in (1996, 1998) group by all)
    select tot.region, cast(province as bigint) as province, cast(year_ce as bigint) as year_ce, round(weight, 9) as weight, round(case when tot.region = 2 and year_ce = 1999 then null else total * weight end, 6) as allocated,
        case when tot.region = 2 and year_ce = 1999 then null else true end as conserved from tot join w on w.region = tot.region""")
def _(t):
    rows = t.year.join(t.nation.select(F.col("n_nationkey").alias("province"), F.col("n_regionkey").alias("region")), "province")
    totals = rows.groupBy("region", "year_ce").agg(F.sum("production").alias("total"))
    blocked = rows.where("region = 2 and year_ce = 1999").select("region", "year_ce")
    out = A.fixed_share_allocate(rows, totals, ["region"], "province", "year_ce", "production", "total", [1996, 1998], blocked)
    return out.select("region", *ints("province", "year_ce"), F.round("weight", 9).alias("weight"), *r6("allocated"), "conserved")


@query("a33_regime_years", "month", """
    with r as (select province, year_ce, case when tonnes > 1000 then 'warm' when tonnes < 700 then 'cold' else 'neutral' end as g from month)
    select cast(province as bigint) as province, cast(year_ce as bigint) as year_ce, cast(count(*) as bigint) as seasons, cast(count(*) filter (g = 'warm') as bigint) as warm_seasons, cast(count(*) filter (g = 'cold') as bigint) as cold_seasons,
        cast(count(*) filter (g = 'neutral') as bigint) as neutral_seasons, string_agg(distinct g, ',' order by g) as regimes, count(*) = 12 as complete_year from r group by all""")
def _(t):
    regime = F.when(F.col("tonnes") > 1000, "warm").when(F.col("tonnes") < 700, "cold").otherwise("neutral")
    out = A.regime_year(t.month.withColumn("regime", regime), ["province"], "year_ce", "regime")
    return out.select(*ints("province", "year_ce"), "seasons", "warm_seasons", "cold_seasons", "neutral_seasons", "regimes", "complete_year")


@query("a34_bounding_box", "pts", """
    select cast(province as bigint) as province, min(lon) as min_x, min(lat) as min_y, max(lon) as max_x, max(lat) as max_y, round(avg(lon), 6) as centre_x, round(avg(lat), 6) as centre_y from pts group by all""")
def _(t):
    return A.bbox(t.pts, ["province"]).select(*ints("province"), "min_x", "min_y", "max_x", "max_y", *r6("centre_x", "centre_y"))


@query("a35_group_digest")
def _(t):
    return A.digest_group(t.sensor, ["device_id"], ["event_id", "soil", "temp_c"])


@query("a35_distinct_profiles", "", """
    select cast(count(*) as bigint) as entities, cast(rows as bigint) as rows from (select p_brand, p_size, string_agg(p_type, ',' order by p_type) as s, count(*) as rows from part group by all) group by s, rows""")
def _(t):
    return A.distinct_profiles(t.part, ["p_brand", "p_size"], ["p_type"]).select("entities", "rows")


@query("a36_gram_statistics", "year", """
    select cast(province as bigint) as province, cast(count(*) as bigint) as n, cast(sum(year_ce) as bigint) as s_0, round(sum(production), 5) as s_1, round(sum(yield_v), 4) as s_2, cast(sum(year_ce * year_ce) as bigint) as p_0_0, round(sum(year_ce * production), 3) as p_0_1, round(sum(production * production) / 1e6, 6) as p_1_1 from year group by all""")
def _(t):
    out = A.gram(t.year.withColumn("year_ce", F.col("year_ce").cast("long")), ["year_ce", "production"], "yield_v", ["province"])
    return out.select(*ints("province"), "n", "s_0", F.round("s_1", 5).alias("s_1"), F.round("s_2", 4).alias("s_2"), "p_0_0", F.round("p_0_1", 3).alias("p_0_1"), F.round(F.col("p_1_1") / 1e6, 6).alias("p_1_1"))


@query("a37_readiness", "part_area", """
    with m as (select province, sum(area) filter (code = 'PROMO') as pure, sum(area) filter (code = 'LARGE') as mixed, sum(area) * 0.3 as planted from part_area group by all)
    select cast(province as bigint) as province, round(100 * pure / planted, 6) as pure_pct, round(100 * (pure + mixed) / planted, 6) as all_pct, round((planted - pure) / mixed, 6) as mixed_fraction, (planted - pure) / mixed between 0 and 1 as match_possible from m""")
def _(t):
    mapped = t.part_area.groupBy("province").agg(F.sum(F.when(F.col("code") == "PROMO", F.col("area"))).alias("pure"), F.sum(F.when(F.col("code") == "LARGE", F.col("area"))).alias("mixed"))
    source = t.part_area.groupBy("province").agg((F.sum("area") * 0.3).alias("planted"))
    out = A.readiness(source, mapped, "province", "planted", "pure", "mixed")
    return out.select(*ints("province"), *r6("pure_pct", "all_pct", "mixed_fraction"), "match_possible")


@query("a38_climate_profile", "year", """
    select cast(province as bigint) as province, round(avg(production), 6) as production_mean, round(avg(yield_v), 4) as yield_v_mean, cast(count(*) filter (area > 90) as bigint) as complete_years from year group by all""")
def _(t):
    out = A.climate_profile(t.year, ["province"], ["production", "yield_v"], F.col("area") > 90)
    return out.select(*ints("province"), *r6("production_mean"), *m4("yield_v_mean"), "complete_years")


@query("a39_horizon_sums", "vint", """
    with o as (select *, date_diff('hour', issued, valid) as o, case when rain_mm < 7 then rain_mm end as r from vint)
    select issue_id, """ + ", ".join(f"cast(count(r) filter (o <= {n}) as bigint) as valid_{n}h, cast(count(*) filter (o <= {n} and r > 0) as bigint) as wet_{n}h, case when count(r) filter (o <= {n}) = {n} then sum(r) filter (o <= {n}) end as sum_{n}h" for n in (2, 4, 6)) + " from o group by issue_id")
def _(t):
    rows = t.vint.withColumn("r", F.when(F.col("rain_mm") < 7, F.col("rain_mm")))
    return A.horizon_sums(rows, ["issue_id"], "issued", "valid", "r", [2, 4, 6])


@query("a39_week_overview", "daily", """
    select province, cast(date_trunc('week', day)::date as varchar) as week, cast(count(*) as bigint) as days, cast(count(case when rain_mm < 150 then rain_mm end) as bigint) as valid_days,
        cast(case when count(case when rain_mm < 150 then rain_mm end) > 0 then count(*) filter (rain_mm > 0 and rain_mm < 150) end as bigint) as rain_days,
        round(case when count(*) = 7 and count(case when rain_mm < 150 then rain_mm end) = 7 then sum(rain_mm) end, 6) as total_rain from daily group by all""")
def _(t):
    rows = t.daily.select("province", F.date_trunc("week", "day").cast("date").cast("string").alias("week"), "day", F.when(F.col("rain_mm") < 150, F.col("rain_mm")).alias("rain"))
    out = A.week_overview(rows, ["province", "week"], "day", "rain")
    return out.select("province", "week", "days", "valid_days", "rain_days", *r6("total_rain"))


@query("a40_season_profile", "month year", """
    with s as (select *, 100 * tonnes / sum(tonnes) over (partition by province, year_ce) as pct from month), g as (select province, year_ce, arg_max(month, struct_pack(p := pct, m := -month)) as peak_month, max(pct) as peak, coalesce(string_agg(cast(month as varchar), ',' order by month) filter (pct >= 10), '') as material, count(*) as k, sum(tonnes) as total from s group by all)
    select cast(g.province as bigint) as province, cast(g.year_ce as bigint) as year_ce, cast(peak_month as bigint) as peak_month, round(peak, 6) as peak_share_pct, material as material_months, cast(k as bigint) as reported_months, coalesce(abs(total - y.production) < 1, false) as reconciled
    from g left join year y on y.province = g.province and y.year_ce = g.year_ce""")
def _(t):
    out = A.season_profile(t.month, t.year, ["province", "year_ce"], "month", "tonnes", "production")
    return out.select(*ints("province", "year_ce", "peak_month"), *r6("peak_share_pct"), "material_months", "reported_months", "reconciled")


@query("a41_status_counts", "ord", """
    select cast(province as bigint) as province, state, cast(count(*) as bigint) as rows, round(100.0 * count(*) / sum(count(*)) over (partition by province), 2) as pct from ord group by province, state""")
def _(t):
    return A.status_summary(t.ord, ["province"], "state").withColumn("province", F.col("province").cast("long"))
