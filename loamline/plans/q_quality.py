"""Screening and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamline.functions import text as X
from loamline.operators import joins as J
from loamline.operators import quality as Q
from loamline.operators.scan import Series, balanced
from loamline.plans.registry import query

GAP = 12 * 3600
RANGES = {"soil": (0.0, 100.0), "temp_c": (16.0, 38.0), "rh": (None, 98.0)}


def day(c):
    return F.col(c).cast("string").alias(c)


def joined(c):
    return F.array_join(c, ",")


def stamp(text):
    return F.lit(text).cast("timestamp_ntz")


def sensor_series(t):
    return balanced(t.sensor, Series(("device_id",), "recorded_at", ("event_id",)))


@query("p01_clean_frame", "sensor", """
    select event_id, case when sig1 <> 'error' then soil end as soil, case when sig1 <> 'click' then temp_c end as temp_c from sensor""")
def _(t):
    raw = t.sensor.select(
        F.col("event_id").alias(" event_id "),
        F.when(F.col("sig1") == "error", float("inf")).otherwise(F.col("soil")).alias("soil "),
        F.when(F.col("sig1") == "click", float("nan")).otherwise(F.col("temp_c")).alias(" temp_c"))
    return Q.clean_frame(raw)


@query("p02_lenient_number", "", """
    select event_id, case event_id % 5 when 0 then null when 1 then null else value end as number from events""")
def _(t):
    k = F.col("event_id") % 5
    text = (F.when(k == 0, F.concat("event_type", F.col("value"))).when(k == 1, "Infinity")
            .when(k == 2, F.concat(F.lit(" "), F.col("value"))).otherwise(F.col("value").cast("string")))
    return t.events.select("event_id", X.to_number(text).alias("number"))


@query("p03_strict_number", "", """
    select o_orderkey, case when o_orderstatus = 'P' then null else round(o_totalprice, 2) end as number,
        case when o_orderstatus = 'P' then 'blank' end as issue from orders""")
def _(t):
    text = F.when(F.col("o_orderstatus") == "P", "  ").otherwise(F.format_number("o_totalprice", 2))
    return t.orders.select("o_orderkey", X.strict_number(text).alias("number"), X.number_issue(text).alias("issue"))


@query("p04_offset_timestamps", "", """
    select event_id, case when event_id % 3 = 0 then null when event_id % 3 = 1 then strftime(ts, '%Y-%m-%d %H:%M:%S')
        else strftime(ts - interval 7 hour, '%Y-%m-%d %H:%M:%S') end as at from events""")
def _(t):
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("event_id") % 3 == 0, base).when(F.col("event_id") % 3 == 1, F.concat(base, F.lit("Z"))).otherwise(
        F.concat(base, F.lit("+07:00")))
    return t.events.select("event_id", F.date_format(X.parse_instant(text), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("p05_range_flags", "sensor", """
    select event_id, soil not between 0 and 100 or temp_c not between 16 and 38 or rh > 98 as invalid_range,
        concat_ws(',', case when soil not between 0 and 100 then 'soil' end, case when temp_c not between 16 and 38 then 'temp_c' end,
            case when rh > 98 then 'rh' end) as invalid_range_columns from sensor""")
def _(t):
    return Q.range_flags(t.sensor, RANGES).select("event_id", "invalid_range", "invalid_range_columns")


@query("p06_mask_range", "sensor", """
    select event_id, case when soil between 0 and 100 then soil end as soil, case when temp_c between 16 and 38 then temp_c end as temp_c,
        case when rh <= 98 then rh end as rh from sensor""")
def _(t):
    return Q.mask_range(t.sensor, RANGES).select("event_id", *RANGES)


@query("p07_quality_gate", "sensor", """
    select event_id, case when valid and age_sec <= 3600 then soil end as soil,
        case when valid and age_sec <= 3600 then temp_c end as temp_c from sensor""")
def _(t):
    return Q.quality_gate(t.sensor, "valid", "age_sec", ["soil", "temp_c"]).select("event_id", "soil", "temp_c")


@query("p08_clean_view", "sensor", """
    select event_id from sensor where coalesce(case when sig1 <> 'click' then valid end, true) and soil < 100""")
def _(t):
    rows = t.sensor.select("event_id", F.when(F.col("sig1") != "click", F.col("valid")).alias("soil_valid"),
                           (F.col("soil") < 100).alias("weather_valid"))
    return Q.clean_view(rows, ["soil_valid", "weather_valid"]).select("event_id")


@query("p09_duplicate_keys", "", """
    select l_orderkey, l_linenumber, cast(count(*) as bigint) as rows from lineitem group by all having count(*) > 1""")
def _(t):
    return Q.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("p10_key_coverage", "year", """
    with g as (select province, y from (select distinct province from year) cross join generate_series(1994, 1999) s(y))
    select cast(coalesce(g.province, y.province) as bigint) as province, cast(coalesce(g.y, y.year_ce) as bigint) as year_ce,
        case when y.province is null then 'missing' else 'extra' end as status
    from g full join year y on g.province = y.province and g.y = y.year_ce where g.province is null or y.province is null""")
def _(t):
    want = J.grid(t.year.select("province").distinct(), "year_ce", F.lit(1994), F.lit(1999))
    out = Q.key_coverage(t.year, want, ["province", "year_ce"])
    return out.select(F.col("province").cast("long"), F.col("year_ce").cast("long"), "status")


@query("p11_table_profile", "sensor", """
    with s as (select sig1, case when soil > 100 then null else cast(floor(soil) as bigint) end as soil, case when valid then temp_c end as temp_c from sensor),
    d as (select cast(sum(n - 1) as bigint) as duplicate_rows from (select count(*) n from s group by sig1, soil, temp_c)),
    r as (select count(*) as n, count(soil) a, count(temp_c) b, count(sig1) c from s)
    select column_name, cast(r.n as bigint) as rows, round(100.0 * (r.n - k) / r.n, 3) as missing_pct, duplicate_rows
    from r cross join d cross join lateral (values ('soil', a), ('temp_c', b), ('sig1', c)) v(column_name, k)""")
def _(t):
    rows = t.sensor.select("sig1", F.when(F.col("soil") <= 100, F.floor("soil")).alias("soil"),
                           F.when(F.col("valid"), F.col("temp_c")).alias("temp_c"))
    return Q.profile(rows)


@query("p12_sensor_profile", "sensor", """
    with s as (select *, epoch_us(recorded_at) / 1e6 - lag(epoch_us(recorded_at) / 1e6) over (partition by device_id order by recorded_at, event_id) as step from sensor)
    select device_id, cast(count(*) as bigint) as rows, strftime(min(recorded_at), '%Y-%m-%d %H:%M:%S') as first_at,
        strftime(max(recorded_at), '%Y-%m-%d %H:%M:%S') as last_at, cast(count(*) filter (step > 43200) as bigint) as gaps,
        round(quantile_cont(step, 0.5), 3) as median_interval_s, cast(count(*) - count(distinct event_id) as bigint) as duplicate_ids
    from s group by device_id""")
def _(t):
    out = Q.sensor_profile(t.sensor, sensor_series(t), "event_id", GAP)
    return out.select("device_id", "rows", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss").alias("first_at"),
                      F.date_format("last_at", "yyyy-MM-dd HH:mm:ss").alias("last_at"), "gaps",
                      F.round("median_interval_s", 3).alias("median_interval_s"), "duplicate_ids")


@query("p13_record_rules", "ord", """
    select doc_id, concat_ws(',', case when v > 400000 then 'weight_limit' end, case when state not in ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') then 'unknown_state' end,
        case when end_date < start_date then 'date_order' end, case when year(end_date) <> year(start_date) then 'outside_year' end,
        case when state = '1-URGENT' and (v < 50000 or start_date < date '1995-06-01') then 'incomplete' end) as violations from ord""")
def _(t):
    rules = {
        "weight_limit": F.col("v") > 400000,
        "unknown_state": ~F.col("state").isin("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"),
        "date_order": F.col("end_date") < F.col("start_date"),
        "outside_year": F.year("end_date") != F.year("start_date"),
        "incomplete": (F.col("state") == "1-URGENT") & ((F.col("v") < 50000) | (F.col("start_date") < "1995-06-01")),
    }
    return Q.validate_rules(t.ord, rules).select("doc_id", joined("violations").alias("violations"))


@query("p14_source_review", "year", """
    with s as (select province, year_ce, production, cast(area as double) as bearing,
            case when province = 3 then area - 1.0 else area + 10.0 end as planted,
            production * 1000 / area + case when province % 5 = 0 then 2 else 0 end as reported,
            case when year_ce = 1998 and province = 7 then 3 else 4 end as items, province = 9 as bad_unit, province = 11 and year_ce = 1997 as bad_crop from year),
    f as (select s.*, b.province is not null as known, b.production as op, b.area as oa,
            p.production as pp, cast(p.area as double) as pa
        from s left join year b on b.province = s.province and b.year_ce = s.year_ce and b.year_ce < 1999
        left join year p on p.province = s.province and p.year_ce = s.year_ce - 1 and p.year_ce < 1999),
    g as (select *, case when items = 3 then null else reported end as rep from f)
    select cast(province as bigint) as province, cast(year_ce as bigint) as year_ce,
        array_to_string(list_sort(list_filter([
            case when items <> 4 then 'duplicate_or_missing_items' end, case when bad_crop then 'crop_year_mismatch' end,
            case when abs(production * 1000 / bearing - rep) > 1 then 'yield_arithmetic_difference' end,
            case when bearing > planted then 'bearing_exceeds_standing_area' end, case when bad_unit then 'unit_production' end,
            case when rep is null then 'missing_or_negative_reported' end,
            case when abs(production / pp - 1) > 0.2 then 'large_change_production' end, case when abs(bearing / pa - 1) > 0.2 then 'large_change_bearing' end,
            case when abs(planted / (pa + 10) - 1) > 0.2 then 'large_change_planted' end,
            case when abs(rep / (pp * 1000 / pa) - 1) > 0.2 then 'large_change_reported' end,
            case when known and (items = 3 or province = 3 or province % 5 = 0) then 'historical_revision' end], lambda x: x is not null)), ',') as flags,
        not known and items = 4 and not bad_crop and coalesce(abs(production * 1000 / bearing - rep), 9) <= 1 and bearing <= planted and not bad_unit
            and not coalesce(abs(production / pp - 1) > 0.2 or abs(bearing / pa - 1) > 0.2 or abs(planted / (pa + 10) - 1) > 0.2
                or abs(rep / (pp * 1000 / pa) - 1) > 0.2, false) as accepted
    from g""")
def _(t):
    area = F.col("area").cast("double")
    exact = F.col("production") * 1000 / area
    base = t.year.select("province", "year_ce", "production", area.alias("bearing"), (area + 10).alias("planted"),
                         exact.alias("reported"))
    now = base.withColumns({
        "planted": F.when(F.col("province") == 3, F.col("bearing") - 1).otherwise(F.col("planted")),
        "reported": F.when(F.col("province") % 5 == 0, F.col("reported") + 2).otherwise(F.col("reported"))})
    units = {"production": "tonne", "bearing": "rai", "planted": "rai", "reported": "kg_per_rai"}
    tall = now.select("province", "year_ce", F.explode(F.array(*[
        F.struct(F.lit(i).alias("item"), F.lit(u).alias("unit"), F.col(i).alias("data")) for i, u in units.items()])).alias("m"))
    tall = tall.select("province", "year_ce", "m.*").withColumn(
        "crop_year", F.col("year_ce") + 543 - F.when((F.col("province") == 11) & (F.col("year_ce") == 1997), 1).otherwise(0))
    tall = tall.withColumn("unit", F.when((F.col("province") == 9) & (F.col("item") == "production"), "kg").otherwise(F.col("unit")))
    tall = tall.where(~((F.col("province") == 7) & (F.col("year_ce") == 1998) & (F.col("item") == "reported")))
    out = Q.review_update(tall, base.where("year_ce < 1999"), {i: (i, u) for i, u in units.items()}, "province", "year_ce",
                          ("production", "bearing", "planted", "reported"), jump=0.2)
    return out.select(F.col("province").cast("long"), F.col("year_ce").cast("long"), joined("flags").alias("flags"), "accepted")


AVAILABILITY_SQL = """
    with d as (select location, issue_id, source, valid, issued, received, case when issue_id % 4 = 0 then 'unverified' else 'verified_available' end as status,
            case when issue_id % 9 = 0 then null else received end as published, case when issue_id % 6 = 0 then 'v2' else 'v1' end as actual,
            case issue_id % 3 when 0 then 'feature' when 1 then 'issue_rule' else 'evaluation_target' end as role from vint)
    select issue_id, strftime(valid, '%Y-%m-%d %H:%M:%S') as valid, case when actual <> 'v1' then 'version_mismatch' else '' end as errors,
        case when role = 'evaluation_target' then 'later_evaluation_reference' else concat_ws(',',
            case when status <> 'verified_available' then 'status_not_verified' end, case when published is null then 'missing_publication' end,
            case when published > valid - interval 3 hour then 'published_after_cutoff' end,
            case when actual <> 'v1' or published is distinct from received then 'evidence_mismatch' end,
            case when role = 'issue_rule' and received > valid - interval 3 hour then 'rule_created_after_cutoff' end) end as warnings,
        actual = 'v1' as allowed from d"""


@query("p15_availability_check", "vint", AVAILABILITY_SQL)
def _(t):
    k = F.col("issue_id")
    role = F.when(k % 3 == 0, "feature").when(k % 3 == 1, "issue_rule").otherwise("evaluation_target")
    rows = t.vint.select(
        "issue_id", "valid", role.alias("role"), role.alias("used_role"), F.lit("v1").alias("source_version"),
        F.when(k % 6 == 0, "v2").otherwise("v1").alias("actual_version"),
        F.when(k % 4 == 0, "unverified").otherwise("verified_available").alias("status"),
        F.when(k % 9 != 0, F.col("received")).alias("published"), F.lit("v1").alias("evidence_version"),
        F.col("received").alias("evidence_published"), F.col("received").alias("created"),
        (F.col("valid") - F.expr("interval 3 hours")).alias("cutoff"))
    out = Q.availability_check(rows, "cutoff")
    return out.select("issue_id", F.date_format("valid", "yyyy-MM-dd HH:mm:ss").alias("valid"), joined("errors").alias("errors"),
                      joined("warnings").alias("warnings"), "allowed")


@query("p16_preflight", "year", """
    with e as (select province as entity, cast(4 + min(month_id) % 3 as int) as m from (select province, year_ce as month_id from year) group by province),
    u as (select y.year, l.lead, e.entity, cast(make_date(cast(y.year as int), e.m + cast(e.entity % 2 as int), 10) - l.lead * interval 1 day as date) as issue
        from (select distinct year_ce as year from year) y cross join (values (0), (60)) l(lead) cross join e),
    c as (select *, min(issue) over (partition by year, lead) as fit_cutoff from u)
    select cast(year as bigint) as year, cast(lead as bigint) as lead, cast(entity as bigint) as entity, feature, dependency,
        cast(issue as varchar) as issue, cast(case when role = 'training_label' then fit_cutoff else issue end as varchar) as cutoff
    from c cross join (values ('rain', 'daily', 'feature'), ('rain', 'normals', 'feature'), ('lag', 'annual', 'training_label')) f(feature, dependency, role)""")
def _(t):
    anchors = t.year.groupBy(F.col("province").alias("entity")).agg((4 + F.min("year_ce") % 3).alias("m")).select(
        "entity", (F.col("m") + F.col("entity") % 2).cast("int").alias("anchor_month"), F.lit(10).alias("anchor_day"))
    entities = t.year.select(F.col("province").alias("entity"), F.col("year_ce").alias("year")).join(anchors, "entity")
    out = Q.preflight(entities, [0, 60], [
        ("rain", "daily", "feature"), ("rain", "normals", "feature"), ("lag", "annual", "training_label")])
    return out.select(*[F.col(c).cast("long").alias(c) for c in ("year", "lead", "entity")], "feature", "dependency", day("issue"), day("cutoff"))


@query("p17_lineage_check", "ord", """
    with r as (select *, start_date as issue, case when doc_id % 4 = 0 then 'lag' else 'rain' end as feature, date_diff('day', start_date, end_date) as span from ord)
    select doc_id, concat_ws(',', case when feature = 'lag' and doc_id % 8 = 0 then 'lag_source' end,
        case when feature = 'rain' and doc_id % 5 = 0 then 'observed_after_cutoff' end,
        case when feature = 'rain' and doc_id % 7 = 0 then 'normal_outside_window' end,
        case when feature = 'rain' and doc_id % 3 = 0 then 'cells_incomplete' end,
        case when feature = 'rain' and doc_id % 3 = 0 then 'fraction_mismatch' end) as violations from r""")
def _(t):
    k, s = F.col("doc_id"), F.col("start_date")
    rows = t.ord.select(
        "doc_id", F.when(k % 4 == 0, "lag").otherwise("rain").alias("feature"), F.col("province").alias("entity"),
        F.year("start_date").alias("year"), s.alias("issue"), s.alias("cutoff"), F.col("province").alias("source_entity"),
        (F.year("start_date") - F.when(k % 8 == 0, 2).otherwise(1)).alias("source_year"),
        F.array(F.date_sub("start_date", 30), F.date_sub("start_date", F.when(k % 5 == 0, 2).otherwise(7))).alias("observed_dates"),
        F.array(F.add_months("start_date", F.when(k % 7 == 0, -12 * 11).otherwise(-12))).alias("normal_dates"),
        F.when(k % 3 == 0, 50).otherwise(60).alias("observed_cells"), F.lit(30).alias("climatology_cells"),
        F.lit(9).alias("cohort_days"), F.lit(10).alias("window_days"), F.lit(60 / 90).alias("observed_fraction"),
        F.lit(30 / 90).alias("climatology_fraction"))
    return Q.lineage_check(rows).select("doc_id", joined("violations").alias("violations"))


@query("p18_reconcile", "month year", """
    with d as (select province, year_ce, sum(tonnes) as a from month group by all)
    select cast(coalesce(d.province, y.province) as bigint) as province, cast(coalesce(d.year_ce, y.year_ce) as bigint) as year_ce,
        round(a, 6) as detail_value, round(production + case when y.province = 4 then 1 else 0 end, 6) as stored_value,
        coalesce(y.province <> 4, false) as ok from d full join year y on d.province = y.province and d.year_ce = y.year_ce""")
def _(t):
    stored = t.year.select("province", "year_ce", (F.col("production") + F.when(F.col("province") == 4, 1).otherwise(0)).alias("tonnes"))
    out = Q.reconcile(t.month, stored, ["province", "year_ce"], "tonnes")
    return out.select(F.col("province").cast("long"), F.col("year_ce").cast("long"), F.round("detail_value", 6).alias("detail_value"),
                      F.round("stored_value", 6).alias("stored_value"), "ok")


@query("p19_ratio_consistency", "year", """
    with r as (select province, year_ce, round(production) as p, cast(area as double) as a, round(yield_v) + case when year_ce % 2 = 0 then 3000 else 0 end as y from year)
    select cast(province as bigint) as province, cast(year_ce as bigint) as year_ce,
        case when y + 0.5 >= greatest(0.0, p - 0.5) * 1000 / (a + 0.5) and y - 0.5 <= (p + 0.5) * 1000 / (a - 0.5) then 'rounding_consistent' else 'inconsistent' end as status from r""")
def _(t):
    printed = F.round("yield_v") + F.when(F.col("year_ce") % 2 == 0, 3000).otherwise(0)
    status = Q.ratio_consistent(F.round("production"), F.col("area").cast("double"), printed)
    return t.year.select(F.col("province").cast("long"), F.col("year_ce").cast("long"), status.alias("status"))


@query("p20_source_conflicts", "year", """
    select cast(province as bigint) as province, cast(year_ce as bigint) as year_ce, round(production, 6) as value_a,
        round(production * 1.05, 6) as value_b, round(production * 1.05 - production, 6) as difference,
        round(abs(production * 1.05 - production), 6) as abs_difference, round(100 * (production * 1.05 - production) / production, 6) as pct_difference
    from year where province % 3 = 0""")
def _(t):
    other = t.year.withColumn("production", F.when(F.col("province") % 3 == 0, F.col("production") * 1.05).otherwise(F.col("production")))
    out = Q.source_conflicts(t.year, other, ["province", "year_ce"], "production")
    return out.select(F.col("province").cast("long"), F.col("year_ce").cast("long"), *[
        F.round(c, 6).alias(c) for c in ("value_a", "value_b", "difference", "abs_difference", "pct_difference")])


@query("p21_certificate_status", "ord", """
    select doc_id, case when doc_id % 50 = 0 or end_date < start_date then 'invalid_dates' when start_date > date '1998-06-01' then 'future_issue'
        when end_date < date '1998-06-01' then 'expired' else 'within_dates' end as status from ord""")
def _(t):
    issued = F.when(F.col("doc_id") % 50 == 0, "n/a").otherwise(F.col("start_date").cast("string"))
    status = Q.date_status(issued, F.col("end_date").cast("string"), F.lit("1998-06-01").cast("date"))
    return t.ord.select("doc_id", status.alias("status"))


@query("p22_coordinate_reason", "pts", """
    select point_id, case when point_id % 5 = 0 then case point_id % 3 when 0 then 'unknown_coordinate_reference_system'
            when 1 then 'invalid_coordinate' else 'missing_coordinate' end
        when point_id % 7 = 0 then 'axis_swapped_source_quarantined' when not (lon between 100.5 and 101.5 and lat between 12.5 and 13.5) then 'outside_bounds'
        when lon + lat > 114.2 then 'outside_boundary' end as reason from pts""")
def _(t):
    k = F.col("point_id")
    lon = F.when(k % 5 != 0, F.col("lon"))
    flag = F.when(k % 5 == 0, F.when(k % 3 == 0, "unknown CRS").when(k % 3 == 1, "out of range")).when(k % 7 == 0, "axes swapped")
    reason = Q.coord_reason(lon, F.col("lat"), flag, (100.5, 101.5, 12.5, 13.5), F.col("lon") + F.col("lat") <= 114.2)
    return t.pts.select("point_id", reason.alias("reason"))


@query("p23_split_label", "year", """
    select cast(province as bigint) as province, cast(year_ce as bigint) as year_ce, case when year_ce <= 1997 then 'train'
        when year_ce <= 1998 then 'validation' when year_ce <= 1999 then 'test' else 'future_holdout' end as split from year""")
def _(t):
    return t.year.select(F.col("province").cast("long"), F.col("year_ce").cast("long"),
                         Q.split_label(F.col("year_ce"), 1997, 1998, 1999).alias("split"))


@query("p24_eligibility", "month", """
    select cast(province as bigint) as province, cast(year_ce as bigint) as year_ce, cast(month as bigint) as month,
        concat_ws(';', case when tonnes < 800 then 'low_target' end, case when month in (1, 2) then 'outside_season' end) as exclusion_reason,
        not (tonnes < 800 or month in (1, 2)) as eligible from month""")
def _(t):
    out = Q.eligibility(t.month, {"low_target": F.col("tonnes") < 800, "outside_season": F.col("month").isin(1, 2)})
    return out.select(*[F.col(c).cast("long").alias(c) for c in ("province", "year_ce", "month")], "exclusion_reason", "eligible")


@query("p25_text_normalisation", "", """
    select doc_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 160) as clean,
        cast(length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as bigint) as full_chars from documents""")
def _(t):
    return t.documents.select("doc_id", X.squeeze("text", 160).alias("clean"), F.length(X.squeeze("text")).cast("long").alias("full_chars"))


@query("p25_district_key", "", """
    select c_custkey, replace(n_name || c_mktsegment, ' ', '') as match_key from customer join nation on n_nationkey = c_nationkey""")
def _(t):
    rows = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    prefix = F.when(F.col("c_custkey") % 3 == 0, "อำเภอ ").when(F.col("c_custkey") % 3 == 1, "อ.").otherwise("")
    return rows.select("c_custkey", X.district_key(F.concat(prefix, "n_name", F.lit("  "), "c_mktsegment")).alias("match_key"))


@query("p25_unicode_text")
def _(t):
    return t.documents.select("doc_id", F.md5(X.unicode_text("text")).alias("clean_md5"))


@query("p26_facet_filter", "", """
    select doc_id, lang, source from documents where lower(concat_ws(' ', text, source)) like '%the%' and lang = 'en' and n_chars > 500""")
def _(t):
    rows = t.documents.withColumn("tags", F.array_compact(F.array(F.when(F.col("n_chars") > 500, F.lit("long")))))
    return Q.facet_filter(rows, " The ", ["text", "source"], {"lang": "en"}, "tags", "long").select("doc_id", "lang", "source")


@query("p27_levels", "year", """
    with q as (select *, quantile_cont(yield_v, 0.25) over (partition by year_ce) as a, quantile_cont(yield_v, 0.5) over (partition by year_ce) as b,
        quantile_cont(yield_v, 0.75) over (partition by year_ce) as c from year)
    select cast(province as bigint) as province, cast(year_ce as bigint) as year_ce,
        case when yield_v <= 240000 then 'low' when yield_v <= 260000 then 'mid' else 'high' end as level,
        case when yield_v <= a then 'q1' when yield_v <= b then 'q2' when yield_v <= c then 'q3' else 'q4' end as quantile_class from q""")
def _(t):
    out = Q.quantile_class(t.year, "yield_v", ["year_ce"])
    return out.select(F.col("province").cast("long"), F.col("year_ce").cast("long"),
                      Q.level(F.col("yield_v"), 240000, 260000).alias("level"), "quantile_class")


@query("p28_code_classes", "", """
    select p_partkey, case p_partkey % 3 when 0 then 'pure' when 1 then 'mixed' end as kind,
        case when p_type = 'ECONOMY' then 'water' when p_type = 'LARGE' then 'terrain_misc_unit' when p_type = 'MEDIUM' then 'complex_or_association'
             when p_type = 'PROMO' then 'unidentified' else 'named_single_unit_candidate' end as tag from part""")
def _(t):
    k = F.col("p_partkey") % 3
    code = F.when(k == 0, "A403").when(k == 1, F.concat(F.lit("A302/A403/"), F.col("p_type"))).otherwise("A4031")
    kind = F.col("p_type")
    soil = F.when(kind == "ECONOMY", "W").when(kind == "LARGE", "SC").when(kind == "MEDIUM", "12-3").when(kind == "PROMO", "").otherwise("34B")
    return t.part.select("p_partkey", X.landuse_kind(code, "A403").alias("kind"), X.soil_tag(soil, F.col("p_name")).alias("tag"))


@query("p29_shift_repair", "sensor", "select event_id, soil as a, temp_c as b, rh as c, cast(null as double) as d from sensor")
def _(t):
    broken = F.col("sig1").isin("click", "view")
    none = F.lit(None).cast("double")
    rows = t.sensor.select(
        "event_id", F.when(broken, none).otherwise(F.col("soil")).alias("a"),
        F.when(broken, F.col("soil")).otherwise(F.col("temp_c")).alias("b"),
        F.when(broken, F.col("temp_c")).otherwise(F.col("rh")).alias("c"), F.when(broken, F.col("rh")).otherwise(none).alias("d"))
    return Q.repair_shift(rows, ["a", "b", "c", "d"])


@query("p30_sensor_state", "sensor", """
    with s as (select *, date_diff('microsecond', recorded_at, timestamp '2024-01-20 00:00:00') / 6e7 as minutes from sensor)
    select event_id, case when minutes < -5 then 'clock_error' when not valid then 'invalid' when age_sec > 3600 or minutes not between 0 and 14400 then 'stale'
        when soil > 100 then 'missing' else 'fresh' end as state from s""")
def _(t):
    state = Q.sensor_state(F.when(F.col("soil") <= 100, F.col("soil")), F.col("valid"), F.col("age_sec"), F.lit(False),
                           F.col("recorded_at"), stamp("2024-01-20 00:00:00"), fresh_minutes=14400)
    return t.sensor.select("event_id", state.alias("state"))


@query("p31_forecast_contract", "vint", """
    with c as (select *, case when temp_c between 12 and 30 then temp_c end as t2, case when rain_mm between 0 and 6 then rain_mm end as r2,
        date_diff('hour', lag(valid) over (partition by issue_id order by valid), valid) as step from vint)
    select issue_id, strftime(valid, '%Y-%m-%d %H:%M:%S') as valid, t2 as temp_c, r2 as rain_mm,
        concat_ws(',', case when t2 is null then 'temp_c' end, case when r2 is null then 'rain_mm' end) as quality_flags,
        coalesce(max(case when step <> 1 then 1 else 0 end) over (partition by issue_id), 0) = 0 as contiguous from c""")
def _(t):
    out = Q.normalize_forecast(t.vint, ["issue_id"], "valid", {"temp_c": (12.0, 30.0), "rain_mm": (0.0, 6.0)})
    return out.select("issue_id", F.date_format("valid", "yyyy-MM-dd HH:mm:ss").alias("valid"), "temp_c", "rain_mm",
                      joined("quality_flags").alias("quality_flags"), "contiguous")


@query("p31_full_day_mean", "vint", """
    select location, cast(cast(valid as date) as varchar) as day, cast(count(case when rain_mm < 7 then temp_c end) as bigint) as valid_hours,
        round(case when count(case when rain_mm < 7 then temp_c end) = 24 then sum(case when rain_mm < 7 then temp_c end) / 24 end, 6) as temp_c_mean from vint group by all""")
def _(t):
    rows = t.vint.withColumn("temp_c", F.when(F.col("rain_mm") < 7, F.col("temp_c")))
    return Q.full_day_mean(rows, ["location"], "valid", "temp_c").select(
        "location", day("day"), "valid_hours", F.round("temp_c_mean", 6).alias("temp_c_mean"))


@query("p32_export_contract", "daily", """
    select '' as missing_columns, cast(count(*) as bigint) as rows, cast(count(*) filter (province not in (0, 1, 2, 3) or day not between date '1995-02-01' and date '2001-12-31') as bigint) as offending_rows,
        count(*) between 1 and 100000000 and count(*) filter (province not in (0, 1, 2, 3) or day not between date '1995-02-01' and date '2001-12-31') = 0 as accepted from daily""")
def _(t):
    return Q.export_contract(t.daily, ["province", "day", "rain_mm"], "province", [0, 1, 2, 3], "day", "1995-02-01", "2001-12-31", 100_000_000)


@query("p33_registry_normalisation", "", """
    with r as (select c_custkey, c_nationkey, c_mktsegment, case when c_mktsegment = 'BUILDING' then 'other_product' when c_nationkey >= 20 then 'province_unresolved'
            when c_nationkey >= 10 then 'non_target' else 'target' end as outcome from customer),
    k as (select c_nationkey, c_mktsegment, min(c_custkey) as c_custkey, count(*) - 1 as duplicates from r where outcome = 'target' group by all)
    select c_custkey, 'P' || (c_nationkey // 2) as province_code, case c_custkey % 3 when 0 then 'Normal' when 1 then 'Suspension' else 'Unknown' end as registration_status,
        c_custkey % 4 = 0 as open_ended, cast(duplicates as bigint) as duplicates from k
    union all select null, outcome, 'count', null, cast(count(*) as bigint) from r group by outcome""")
def _(t):
    k = F.col("c_nationkey")
    places = F.when(k >= 20, " , \n").when(k >= 10, F.concat(F.lit("c1,c4,"), k)).otherwise(F.concat(F.lit("c"), k, F.lit("\nx")))
    rows = t.customer.select(
        "c_custkey", F.concat_ws("-", "c_nationkey", "c_mktsegment").alias("key"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Mango").otherwise("Mango,  Lychee").alias("products"), places.alias("places"),
        (F.col("c_custkey") % 3 + 1).cast("string").alias("state"),
        F.when(F.col("c_custkey") % 4 == 0, "2999-12-31").otherwise("2026-01-01").alias("valid_to"))
    codes = {f"c{i}": f"P{i // 2}" for i in range(10)}
    kept, counts = Q.normalize_registry(rows, codes, {"1": "Normal", "2": "Suspension"}, "Lychee", ["key"], ["c_custkey"])
    a = kept.select("c_custkey", "province_code", "registration_status", "open_ended", "duplicates")
    b = counts.select(F.lit(None).cast("long").alias("c_custkey"), F.col("outcome").alias("province_code"), F.lit("count").alias("registration_status"),
                      F.lit(None).cast("boolean").alias("open_ended"), F.col("rows").alias("duplicates"))
    return a.unionByName(b)


@query("p34_inspection_items", "sensor", """
    with d as (select device_id, cast(recorded_at as date) as day, bool_or(not valid) as bad, max(temp_c) > 35 as wet, max(age_sec) // 120 as age,
        max(sig1) as stage from sensor group by all)
    select device_id, cast(day as varchar) as day, array_to_string(list_filter([case when wet then 'drainage' else 'water' end, case when bad then 'sensor' end,
        case when wet and age between 0 and 30 and stage in ('view', 'signup') then 'fruit' end, case when not age between 0 and 30 then 'stage' end], lambda x: x is not null)[1:3], ',') as items from d""")
def _(t):
    daily = t.sensor.groupBy("device_id", F.to_date("recorded_at").alias("day")).agg(
        F.bool_or(~F.col("valid")).alias("bad"), (F.max("temp_c") > 35).alias("wet"), F.floor(F.max("age_sec") / 120).alias("age"),
        F.max("sig1").alias("stage"))
    out = Q.inspection_items(daily, F.when(F.col("bad"), "invalid").otherwise("fresh"), F.col("wet"), F.col("age"), F.col("stage"), ["view", "signup"])
    return out.select("device_id", day("day"), joined("items").alias("items"))
