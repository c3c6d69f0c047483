"""Model and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamline.operators import aggregates as A
from loamline.operators import joins as J
from loamline.operators import models as M
from loamline.operators.quality import split_label
from loamline.plans.q_aggregates import ERRORS, errors, m4
from loamline.plans.q_windows import day, ints
from loamline.plans.registry import query


def r6(*names):
    return [F.round(c, 6).alias(c) for c in names]


def panel(t):
    """Annual panel with last year's yield and two covariates, the first year dropped."""
    rows = J.prev_period_join(t.year, ["province"], "year_ce", ["yield_v", "production"])
    return rows.select("province", "year_ce", F.col("yield_v").alias("target"), F.col("previous_yield_v").alias("lag"),
                       F.col("previous_production").alias("lag_production"), F.col("area").cast("double").alias("area"))


PANEL = """
    pn as (select a.province, a.year_ce, a.yield_v as target, b.yield_v as lag, b.production as lag_production, cast(a.area as double) as area from year a join year b on b.province = a.province and b.year_ce = a.year_ce - 1)
"""


def ridge2(train: str) -> str:
    """Normal equations of lag and area with a penalty of 1, by determinants: ``w`` has one row."""
    return PANEL + f""",
    g as (select count(*)::double as n, avg(lag) m1, avg(area) m2, avg(target) my, stddev_pop(lag) s1, stddev_pop(area) s2, covar_pop(lag, area) c12,
        covar_pop(lag, target) c1, covar_pop(area, target) c2 from pn where {train}),
    e as (select *, n + 1 as a, n * c12 / s1 / s2 as b, n * c1 / s1 as r1, n * c2 / s2 as r2 from g),
    w as (select *, (a * r1 - b * r2) / (a * a - b * b) as w1, (a * r2 - b * r1) / (a * a - b * b) as w2 from e)"""


def ridge3(train: str) -> str:
    """The same for lag, lag_production and area with penalties of 1 and 10: ``w`` has a row per alpha."""
    return PANEL + f""",
    g as (select count(*)::double as n, avg(lag) m1, avg(lag_production) m2, avg(area) m3, avg(target) my, stddev_pop(lag) s1, stddev_pop(lag_production) s2, stddev_pop(area) s3,
        covar_pop(lag, lag_production) c12, covar_pop(lag, area) c13, covar_pop(lag_production, area) c23,
        covar_pop(lag, target) c1, covar_pop(lag_production, target) c2, covar_pop(area, target) c3 from pn where {train}),
    e as (select *, n + alpha as a, n * c12 / s1 / s2 as x, n * c13 / s1 / s3 as y, n * c23 / s2 / s3 as z, n * c1 / s1 as r1, n * c2 / s2 as r2, n * c3 / s3 as r3
        from g cross join (values (1.0::double), (10.0::double)) v(alpha)),
    d as (select *, a * a * a + 2 * x * y * z - a * (x * x + y * y + z * z) as det from e),
    w as (select *, ((a * a - z * z) * r1 + (y * z - a * x) * r2 + (x * z - a * y) * r3) / det as w1, ((y * z - a * x) * r1 + (a * a - y * y) * r2 + (x * y - a * z) * r3) / det as w2,
        ((x * z - a * y) * r1 + (x * y - a * z) * r2 + (a * a - x * x) * r3) / det as w3 from d)"""


@query("m01_ridge_single_feature", "year", "with " + PANEL + """
    , g as (select n_regionkey as region, count(*) n, avg(lag) mx, stddev_pop(lag) sx, avg(target) my, covar_pop(lag, target) cv from pn join nation on n_nationkey = province group by all)
    select region, cast(alpha as double) as alpha, round(my, 5) as intercept, round(n * cv / sx / (n + alpha), 4) as coef, round(mx, 5) as mean, round(sx, 5) as scale from g cross join (values (1), (10), (100)) a(alpha)""")
def _(t):
    rows = panel(t).join(t.nation.select(F.col("n_nationkey").alias("province"), F.col("n_regionkey").alias("region")), "province")
    out = M.ridge_fit(rows, ["lag"], "target", [1, 10, 100], ["region"])
    return out.select("region", "alpha", F.round("intercept", 5).alias("intercept"), F.round(F.col("coef")[0], 4).alias("coef"),
                      F.round(F.col("mean")[0], 5).alias("mean"), F.round(F.col("scale")[0], 5).alias("scale"))


@query("m01_ridge_panel", "year", "with " + ridge3("year_ce <= 1998") + """
    select cast(province as bigint) as province, cast(year_ce as bigint) as year_ce, alpha,
        round(greatest(0.0, my + (lag - m1) / s1 * w1 + (lag_production - m2) / s2 * w2 + (area - m3) / s3 * w3), 4) as predicted from pn cross join w where year_ce > 1998""")
def _(t):
    rows = panel(t)
    models = M.ridge_fit(rows.where("year_ce <= 1998"), ["lag", "lag_production", "area"], "target", [1, 10], [])
    out = M.ridge_predict(models, rows.where("year_ce > 1998"), ["lag", "lag_production", "area"], [])
    return out.select(*ints("province", "year_ce"), "alpha", F.round("predicted", 4).alias("predicted"))


@query("m02_guarded_scoring", "year", "with " + ridge2("year_ce <= 1998") + """
    , p as (select province, year_ce, area, case when province not between 0 and 19 then 'unknown_entity' when year_ce <= 1998 then 'year_not_after_training'
            when province = 5 or lag is null or area is null then 'missing_or_not_finite' when not area between 0 and 300 then 'out_of_range' end as problem,
        greatest(0.0, my + (lag - m1) / s1 * w1 + (area - m2) / s2 * w2) as v from pn cross join w)
    select cast(province as bigint) as province, cast(year_ce as bigint) as year_ce, problem, case when problem is null then round(v, 4) end as predicted,
        case when problem is null and area > 0 then round(v * area / 1000, 4) end as predicted_tonnes from p""")
def _(t):
    rows = panel(t)
    models = M.ridge_fit(rows.where("year_ce <= 1998"), ["lag", "area"], "target", [1], [])
    tested = rows.withColumn("lag", F.when(F.col("province") != 5, F.col("lag")))
    out = M.score(models, tested, list(range(20)), "province", "year_ce", 1998, ["lag", "area"], {"area": (0.0, 300.0)}, "area")
    return out.select(*ints("province", "year_ce"), "problem", F.round("predicted", 4).alias("predicted"), F.round("predicted_tonnes", 4).alias("predicted_tonnes"))


@query("m03_baselines", "month", """
    with tr as (select * from month where year_ce <= 1998 and not (province = 4 and month = 6)), te as (select * from month where year_ce > 1998),
    a as (select province, month, quantile_cont(tonnes, 0.5) m from tr group by all), b as (select province, quantile_cont(tonnes, 0.5) m, avg(tonnes) v from tr group by all)
    select cast(te.province as bigint) as province, cast(te.year_ce as bigint) as year_ce, cast(te.month as bigint) as month, round(coalesce(a.m, b.m), 6) as seasonal, round(b.m, 6) as median, round((select avg(tonnes) from tr), 6) as mean
    from te left join a on a.province = te.province and a.month = te.month left join b on b.province = te.province""")
def _(t):
    train = t.month.where("year_ce <= 1998 and not (province = 4 and month = 6)")
    out = t.month.where("year_ce > 1998").select("province", "year_ce", "month")
    for kind, name in (("seasonal_median", "seasonal"), ("entity_median", "median"), ("train_mean", "mean")):
        out = M.baseline(train, out, kind, ["province"], "year_ce", "tonnes", "month", name=name)
    return out.select(*ints("province", "year_ce", "month"), *r6("seasonal", "median", "mean"))


@query("m03_lag_baselines", "year", """
    select cast(a.province as bigint) as province, cast(a.year_ce as bigint) as year_ce, round(b.yield_v, 6) as previous, round(c.yield_v, 6) as lag2
    from year a left join year b on b.province = a.province and b.year_ce = a.year_ce - 1 left join year c on c.province = a.province and c.year_ce = a.year_ce - 2""")
def _(t):
    keys = t.year.select("province", "year_ce")
    out = M.baseline(t.year, keys, "previous", ["province"], "year_ce", "yield_v", name="previous")
    out = M.baseline(t.year, out, "lag2", ["province"], "year_ce", "yield_v", name="lag2")
    return out.select(*ints("province", "year_ce"), *r6("previous", "lag2"))


SIMPLE = [{"config": 0, "model": "previous", "kind": "previous"}, {"config": 1, "model": "median", "kind": "entity_median"},
          {"config": 2, "model": "mean", "kind": "train_mean"}]
NESTED = """
    with fy as (select y from generate_series(1997, 2000) g(y)),
    p as (select y as fold_year, 0 as config, 'previous' as model, a.province, a.yield_v as actual, b.yield_v as predicted from fy join year a on a.year_ce = y left join year b on b.province = a.province and b.year_ce = y - 1
        union all select y, 1, 'median', a.province, a.yield_v, (select quantile_cont(b.yield_v, 0.5) from year b where b.province = a.province and b.year_ce < y) from fy join year a on a.year_ce = y
        union all select y, 2, 'mean', a.province, a.yield_v, (select avg(b.yield_v) from year b where b.year_ce < y) from fy join year a on a.year_ce = y),
    e as (select fold_year, config, model, avg(abs(predicted - actual)) as mae from p group by all), s as (select o, config, model, avg(mae) as inner_mae from (values (1999), (2000)) v(o) join e on e.fold_year between o - 2 and o - 1 group by all),
    q as (select o, model as policy, config, inner_mae from s union all select o, 'inner_selected', config, inner_mae from s),
    w as (select o, policy, config, inner_mae from q qualify row_number() over (partition by o, policy order by inner_mae, config) = 1)
"""


@query("m04_nested_choices", "year", NESTED + "select cast(o as bigint) as outer_year, policy, cast(config as bigint) as config, round(inner_mae, 4) as inner_mae from w")
def _(t):
    choices, _ = M.nested_validate(t.year, SIMPLE, ["province"], "year_ce", "yield_v", [1999, 2000], 2)
    return choices.select(*ints("outer_year"), "policy", *ints("config"), F.round("inner_mae", 4).alias("inner_mae"))


@query("m04_nested_predictions", "year", NESTED + """
    select cast(o as bigint) as outer_year, policy, cast(w.config as bigint) as config, cast(p.province as bigint) as province, round(actual, 5) as actual, round(predicted, 5) as predicted from w join p on p.fold_year = o and p.config = w.config""")
def _(t):
    _, out = M.nested_validate(t.year, SIMPLE, ["province"], "year_ce", "yield_v", [1999, 2000], 2)
    return out.select(*ints("outer_year"), "policy", *ints("config", "province"), F.round("actual", 5).alias("actual"), F.round("predicted", 5).alias("predicted"))


@query("m04_nested_ridge")
def _(t):
    configs = SIMPLE[:2] + [{"config": 10 + i, "model": m, "kind": "ridge", "alpha": a, "features": f} for i, (m, a, f) in enumerate(
        [(m, a, f) for m, f in (("ridge_lag", ["lag"]), ("ridge_all", ["lag", "lag_production", "area"])) for a in (1.0, 10.0, 100.0)])]
    choices, out = M.nested_validate(panel(t), configs, ["province"], "year_ce", "target", [1999, 2000], 2)
    return A.error_metrics(out, ["outer_year", "policy"]).join(choices, ["outer_year", "policy"]).select(
        *ints("outer_year"), "policy", *ints("config"), "n", *m4("mae", "rmse", "bias", "inner_mae"))


def split_panel(t):
    return panel(t).withColumn("split", split_label(F.col("year_ce"), 1997, 1998, 2000))


@query("m05_split_tuning")
def _(t):
    return M.split_tune(split_panel(t), "split", ["lag", "area"], "target", [1, 10, 100]).select("alpha", *m4("validation_mae", "test_mae"), "selected")


@query("m06_purged_split", "sensor", """
    with r as (select event_id, recorded_at, row_number() over (order by recorded_at, event_id) - 1 as n, count(*) over () as k from sensor),
    c as (select max(recorded_at) filter (n = floor(0.6 * k)) as a, max(recorded_at) filter (n = floor(0.8 * k)) as b from r)
    select event_id, case when recorded_at + interval 6 hour < a then 'train' when recorded_at >= a and recorded_at + interval 6 hour < b then 'validation' when recorded_at >= b then 'test' end as split from r cross join c""")
def _(t):
    rows = t.sensor.withColumn("target_at", F.col("recorded_at") + F.expr("interval 6 hours"))
    return M.purged_split(rows, "recorded_at", "target_at", ["event_id"]).select("event_id", "split")


@query("m07_feature_ablation")
def _(t):
    out = M.ablation(split_panel(t), "split", {"baseline": ["lag"], "production": ["lag", "lag_production"], "area": ["lag", "area"], "all": ["lag", "lag_production", "area"]}, "target", [1, 10, 100])
    return out.select("variant", "alpha", *m4("validation_mae", "test_mae", "gain"))


@query("m08_tree_folds")
def _(t):
    rows = panel(t)
    out = M.tree_fit_predict(rows, "forest", ["lag", "area"], "province", "year_ce", "target", [1999, 2000], {"numTrees": 20, "maxDepth": 3}).withColumn("model", F.lit("forest")).unionByName(
        M.tree_fit_predict(rows, "boosted", ["lag", "area"], "province", "year_ce", "target", [1999, 2000], {"maxIter": 10, "maxDepth": 2}).withColumn("model", F.lit("boosted")))
    return A.error_metrics(out, ["model", "year_ce"]).select("model", *ints("year_ce"), "n", *m4("mae", "rmse", "bias"))


def level(number: int) -> str:
    """Exhaustive search of the best split of each node: every threshold and every single province against the rest."""
    a, b = f"n{number}", f"n{number + 1}"
    return f""",
    k{number} as (select r.fold_year, r.node, c.f, c.bin, c.cat, count(*) as n, sum(target) as s,
            count(*) filter (case when c.f < 0 then r.province = c.cat when c.f = 0 then r.b0 <= c.bin else r.b1 <= c.bin end) as nl,
            sum(target) filter (case when c.f < 0 then r.province = c.cat when c.f = 0 then r.b0 <= c.bin else r.b1 <= c.bin end) as sl
        from {a} r join c on c.fold_year = r.fold_year where r.learn and r.node >= {2**number - 1} group by all),
    s{number} as (select * from k{number} where nl > 0 and nl < n qualify row_number() over (partition by fold_year, node order by sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n desc, f, bin) = 1),
    {b} as (select r.* replace (case when s.f is null then r.node else 2 * r.node + 1 + (case when s.f < 0 then r.province = s.cat when s.f = 0 then r.b0 > s.bin else r.b1 > s.bin end)::int end as node)
        from {a} r left join s{number} s on s.fold_year = r.fold_year and s.node = r.node)"""


@query("m08_depth_two_tree", "year", "with " + PANEL + """
    , fo as (select f as fold_year, p.*, year_ce < f as learn from pn p join (values (1999), (2000)) v(f) on year_ce <= f),
    eg as (select fold_year, quantile_cont(lag, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) as q0, quantile_cont(area, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) as q1 from fo where learn group by fold_year),
    n0 as (select fo.*, 0 as node, len(list_filter(q0, lambda e: e < lag)) as b0, len(list_filter(q1, lambda e: e < area)) as b1 from fo join eg using (fold_year)),
    c as (select fold_year, f, bin, null as cat from (select distinct fold_year from fo), (values (0), (1)) a(f), generate_series(0, 6) g(bin)
        union all select distinct fold_year, -1, 0, province from fo where learn)""" + level(0) + level(1) + """
    select cast(x.province as bigint) as province, cast(x.year_ce as bigint) as year_ce, round(greatest(0, v.p), 4) as predicted
    from n2 x join (select fold_year, node, avg(target) as p from n2 where learn group by all) v on v.fold_year = x.fold_year and v.node = x.node where not x.learn""")
def _(t):
    out = M.tree_fit_predict(panel(t), "tree", ["lag", "area"], "province", "year_ce", "target", [1999, 2000], {"maxDepth": 2, "maxBins": 8})
    return out.select(*ints("province", "year_ce"), F.round("predicted", 4).alias("predicted"))


def direction_panel(t):
    rows = panel(t).withColumn("label", F.when(F.col("target") > F.col("lag"), 1).when(F.col("target") < F.col("lag"), 0))
    return rows.withColumn("lag_production", F.when(F.col("province") % 6 != 0, F.col("lag_production")))


@query("m09_direction_models")
def _(t):
    parts = [M.direction_models(direction_panel(t), f, ["lag", "lag_production", "area"], "province", "year_ce", "label", [1999, 2000], b).withColumns(
        {"family": F.lit(f), "balanced": F.lit(b)}) for f, b in (("logistic", True), ("forest", False))]
    out = A.class_metrics(parts[0].unionByName(parts[1]), ["family", "balanced"], "actual", "predicted")
    return out.select("family", "balanced", "n", *r6("accuracy", "balanced_accuracy", "macro_f1"))


@query("m10_impute_with_indicator", "year", "with " + PANEL + """
    , x as (select *, case when province % 6 <> 0 then lag_production end as lp from pn), m as (select quantile_cont(lp, 0.5) as med from x where year_ce <= 1998)
    select cast(province as bigint) as province, cast(year_ce as bigint) as year_ce, round(coalesce(lp, med), 6) as lag_production, case when lp is null then 1.0::double else 0.0::double end as lag_production_missing from x cross join m where year_ce > 1998""")
def _(t):
    rows = direction_panel(t)
    out = M.impute_with_indicator(rows.where("year_ce <= 1998"), rows.where("year_ce > 1998"), ["lag_production"])
    return out.select(*ints("province", "year_ce"), *r6("lag_production"), "lag_production_missing")


@query("m11_delta_target")
def _(t):
    out = M.delta_fit_predict(panel(t), ["lag", "area"], "year_ce", "target", "lag", 10, [1999, 2000])
    return out.select(*ints("province", "year_ce"), F.round("predicted", 4).alias("predicted"))


@query("m12_promotion_gate", "year", "with " + ERRORS + """
    , k as (select e.* from e join (select province, year_ce from e group by all having count(*) = 2) using (province, year_ce)),
    a as (select model, avg(abs(predicted - actual)) mae, sqrt(avg(pow(predicted - actual, 2))) rmse from k group by model), p as (select province, avg(abs(predicted - actual)) filter (model = 'previous') b, avg(abs(predicted - actual)) filter (model = 'flat') c from k group by province),
    g as (select max(mae) filter (model = 'previous') bm, max(mae) filter (model = 'flat') cm, max(rmse) filter (model = 'previous') br, max(rmse) filter (model = 'flat') cr, (select count(*) from p where c > 1.1 * b) w from a)
    select round(bm, 4) as base_mae, round(cm, 4) as candidate_mae, round(br, 4) as base_rmse, round(cr, 4) as candidate_rmse, cast(w as bigint) as entities_worse, round(1 - cm / bm, 6) as improvement, cm <= 0.95 * bm as mae_pass, cr <= br as rmse_pass, cm <= 0.95 * bm and cr <= br and w = 0 as passed from g""")
def _(t):
    rows = errors(t)
    both = rows.groupBy("province", "year_ce").agg(F.count("*").alias("k")).where("k = 2").drop("k")
    out = M.promotion_gate(rows.join(both, ["province", "year_ce"]), "province", "model", "previous", "flat")
    return out.select(*m4("base_mae", "candidate_mae", "base_rmse", "candidate_rmse"), "entities_worse", *r6("improvement"), "mae_pass", "rmse_pass", "passed")


def paired(t):
    """Monthly panel errors of two simple predictors."""
    rows = J.prev_period_join(t.month, ["province", "month"], "year_ce", ["tonnes"])
    return rows.select("year_ce", F.abs(F.col("previous_tonnes") - F.col("tonnes")).alias("model_error"), F.abs(F.col("tonnes") - 900).alias("base_error"))


BOOT = """
    with e as (select a.year_ce, abs(b.tonnes - a.tonnes) as m, abs(a.tonnes - 900) as b from month a join month b on b.province = a.province and b.month = a.month and b.year_ce = a.year_ce - 1),
    y as (select year_ce, avg(m) m, avg(b) b, row_number() over (order by year_ce) - 1 as k, count(*) over () as n from e group by year_ce),
    d as (select i, j, n, (((((i * 1103515245 + 12345 + 42) % 2147483648) + {unit} * 69069) * 1103515245 + 12345) % 2147483648 // 65536) % n as start from (select i, j, (select max(n) from y) as n from generate_series(0, {last}) a(i), generate_series(0, 20) b(j)) where j < n),
    s as (select i, avg(m) m, avg(b) b from d join y on y.k = ({index}) group by i)
    select cast(count(*) as bigint) as resamples, round(quantile_cont(b - m, 0.025), 6) as gain_low, round(quantile_cont(b - m, 0.975), 6) as gain_high, round(quantile_cont(100 * (1 - m / b), 0.025), 6) as reduction_low, round(quantile_cont(100 * (1 - m / b), 0.975), 6) as reduction_high{extra} from s"""


@query("m13_year_bootstrap", "month", BOOT.format(unit="j", last=4999, index="d.start", extra=", cast((select count(*) from y where m < b) as bigint) as better_years, cast((select count(*) from y) as bigint) as years"))
def _(t):
    out = M.year_bootstrap(paired(t), "year_ce", "model_error", "base_error")
    return out.select("resamples", *r6("gain_low", "gain_high", "reduction_low", "reduction_high"), *ints("better_years", "years"))


@query("m14_block_bootstrap", "month", BOOT.format(unit="(j // 3)", last=19999, index="(d.start + d.j % 3) % d.n", extra=", cast(3 as bigint) as block_years"))
def _(t):
    out = M.block_bootstrap(paired(t), "year_ce", "model_error", "base_error")
    return out.select("resamples", *r6("gain_low", "gain_high", "reduction_low", "reduction_high"), *ints("block_years"))


STATS = """
    with v as (select 'soil' as feature, soil as v from sensor union all select 'temp_c', temp_c from sensor union all select 'rh', rh from sensor),
    q as (select feature, quantile_cont(v, 0.5) m, quantile_cont(v, 0.75) q3 from v group by feature), k as (select feature, m, q3, quantile_cont(abs(v - m), 0.5) mad from v join q using (feature) group by all),
    st as (select max(m) filter (feature = 'soil') ms, max(mad) filter (feature = 'soil') ds, max(m) filter (feature = 'temp_c') mt, max(mad) filter (feature = 'temp_c') dt, max(m) filter (feature = 'rh') mr, max(mad) filter (feature = 'rh') dr,
        max(q3) filter (feature = 'soil') qs, max(q3) filter (feature = 'rh') qr from k)
"""


@query("m15_anomaly_score", "sensor", STATS + """
    , z as (select s.*, abs(soil - ms) / (1.4826::double * ds) as zs, abs(temp_c - mt) / (1.4826::double * dt) as zt, abs(rh - mr) / (1.4826::double * dr) as zr from sensor s cross join st)
    select event_id, round(greatest(zs, zt, zr), 6) as anomaly_score, case when zs >= zt and zs >= zr then 'soil' when zt >= zr then 'temp_c' else 'rh' end as anomaly_feature, valid as model_eligible, valid and greatest(zs, zt, zr) >= 4.5 as is_anomaly from z""")
def _(t):
    names = ["soil", "temp_c", "rh"]
    out = M.anomaly_score(t.sensor, A.robust_stats(t.sensor, names), names, F.col("valid"))
    return out.select("event_id", *r6("anomaly_score"), "anomaly_feature", "model_eligible", "is_anomaly")


@query("m16_wet_alert", "sensor", STATS + """
    select event_id, cast((soil >= qs)::int + (rh >= qr)::int + (sig2 > 0)::int as bigint) as wet_score, valid and (soil >= qs)::int + (rh >= qr)::int + (sig2 > 0)::int >= 2 as wet_alert from sensor cross join st""")
def _(t):
    out = M.wet_alert(t.sensor, A.robust_stats(t.sensor, ["soil", "rh"]), "soil", "rh", "sig2", F.col("valid"))
    return out.select("event_id", *ints("wet_score"), "wet_alert")


@query("m17_coefficients", "year", "with " + ridge3("true") + """
    , c as (select alpha, 'lag' as feature, w1 as c from w union all select alpha, 'lag_production', w2 from w union all select alpha, 'area', w3 from w)
    select alpha, feature, round(c, 4) as coefficient, row_number() over (partition by alpha order by abs(c) desc, feature) as rank from c""")
def _(t):
    names = ["lag", "lag_production", "area"]
    models = M.ridge_fit(panel(t), names, "target", [1, 10], [])
    return M.coefficients(models, names).select("alpha", "feature", F.round("coefficient", 4).alias("coefficient"), *ints("rank"))


@query("m18_permutation_importance")
def _(t):
    rows = direction_panel(t)
    out = M.permutation_importance(rows.where("year_ce <= 1998"), rows.where("year_ce > 1998"), "logistic", ["lag", "lag_production", "area"],
                                   {"yield": ["lag"], "weather": ["lag_production", "area"]}, "province", "label", ["province", "year_ce"])
    return out.select("group", *r6("drop_mean", "drop_sd"), "repeats")


@query("m19_replay_levels", "year", "with " + ERRORS + """
    , l as (select *, case when actual <= 240000 then 'low' when actual <= 260000 then 'mid' else 'high' end as a, case when predicted <= 240000 then 'low' when predicted <= 260000 then 'mid' else 'high' end as p from e)
    select cast(year_ce as bigint) as year_ce, cast(count(*) as bigint) as n, round(avg(abs(predicted - actual)), 4) as mae, round(100 * avg(abs(predicted - actual) / actual), 6) as mape_pct, cast(count(*) filter (a = p) as bigint) as correct, round(100.0 * count(*) filter (a = p) / count(*), 6) as level_accuracy_pct from l group by year_ce""")
def _(t):
    _, out = M.replay_levels(errors(t), "year_ce", 240000, 260000)
    return out.select(*ints("year_ce"), "n", *m4("mae"), *r6("mape_pct"), "correct", *r6("level_accuracy_pct"))


@query("m20_expansion_metrics", "year", "with " + ERRORS + """
    , v as (select *, case when year_ce >= 1998 then 'primary' else 'secondary' end as evaluation from e)
    select evaluation, model, cast(year_ce as bigint) as year_ce, cast(province as bigint) as province, cast(count(*) as bigint) as n, round(avg(abs(predicted - actual)), 4) as mae from v group by grouping sets ((evaluation, model), (evaluation, model, year_ce), (evaluation, model, province))""")
def _(t):
    rows = errors(t).withColumn("evaluation", F.when(F.col("year_ce") >= 1998, "primary").otherwise("secondary"))
    out, _ = M.expansion_summary(rows, ["year_ce", "province"], "evaluation", "model", {"flat_gain": ("previous", "flat")})
    return out.select("evaluation", "model", *ints("year_ce", "province"), "n", *m4("mae"))


@query("m20_expansion_gains", "year", "with " + ERRORS + """
    , g as (select abs(b.predicted - b.actual) - abs(a.predicted - a.actual) as gain from e a join e b on a.province = b.province and a.year_ce = b.year_ce and b.model = 'previous' where a.model = 'flat' and a.year_ce >= 1998)
    select 'flat_gain' as comparison, cast(count(*) as bigint) as n, cast(count(*) filter (gain > 1e-9) as bigint) as wins, cast(count(*) filter (gain < -1e-9) as bigint) as losses, round(avg(gain), 4) as mean_gain, round(quantile_cont(gain, 0.5), 4) as median_gain from g""")
def _(t):
    rows = errors(t).withColumn("evaluation", F.when(F.col("year_ce") >= 1998, "primary").otherwise("secondary"))
    _, out = M.expansion_summary(rows, ["year_ce", "province"], "evaluation", "model", {"flat_gain": ("previous", "flat")})
    return out.select("comparison", "n", "wins", "losses", *m4("mean_gain", "median_gain"))


@query("m21_same_predictions", "month", """
    select cast(province as bigint) as province, cast(year_ce as bigint) as year_ce, cast(month as bigint) as month, case when month = 3 then 'only_first' else 'different' end as problem from month where month = 3 or province = 7""")
def _(t):
    other = t.month.where("month <> 3").withColumn("tonnes", F.when(F.col("province") == 7, F.col("tonnes") * 1.001).otherwise(F.col("tonnes") * (1 + 1e-12)))
    return M.same_predictions(t.month, other, ["province", "year_ce", "month"], "tonnes").select(*ints("province", "year_ce", "month"), "problem")


@query("m22_water_balance", "daily_full", """
    with recursive d as (select province, day, t_max / 6 as e, rain_mm / 40 as r, row_number() over (partition by province order by day) as n from daily_full),
    w as (select province, n, day, 30.0::double as dep, 0.0::double as ks, 0.0::double as eta, 0.0::double as drain from (select province, 0 as n, min(day) as day from d group by province)
        union all select d.province, d.n, d.day, least(80, greatest(0, w.dep - d.r) + least(case when greatest(0, w.dep - d.r) <= 40 then 1 else greatest(0, (80 - greatest(0, w.dep - d.r)) / 40) end * d.e * 0.8, 80 - greatest(0, w.dep - d.r))),
            case when greatest(0, w.dep - d.r) <= 40 then 1 else greatest(0, (80 - greatest(0, w.dep - d.r)) / 40) end,
            least(case when greatest(0, w.dep - d.r) <= 40 then 1 else greatest(0, (80 - greatest(0, w.dep - d.r)) / 40) end * d.e * 0.8, 80 - greatest(0, w.dep - d.r)), greatest(0, d.r - w.dep) from w join d on d.province = w.province and d.n = w.n + 1)
    select province, cast(day as varchar) as day, round(dep, 6) as depletion_mm, round(ks, 6) as ks, round(eta, 6) as eta_mm, round(drain, 6) as drainage_mm from w where n > 0""")
def _(t):
    rows = t.daily_full.select("province", "day", (F.col("t_max") / 6).cast("double").alias("et0"), (F.col("rain_mm") / 40).cast("double").alias("rain"), F.lit(0.0).alias("irrigation"))
    out = M.water_balance(rows, ["province"], "day", 0.28, 0.12, 0.5, 0.5, 30.0, 0.8)
    return out.select("province", day("day"), *r6("depletion_mm", "ks", "eta_mm", "drainage_mm"))


@query("m23_dated_estimate", "year", "with " + ridge2("year_ce <= 1997") + """
    , k as (select year.province, year.year_ce, pn.lag, case when year.province <> 3 then pn.area end as area from year left join pn on pn.province = year.province and pn.year_ce = year.year_ce),
    p as (select *, case when lag is null then 'pending_prior_yield' when make_date(cast(year_ce as int), 9, 30) >= date '2000-06-01' then 'pending_future_weather' when area is null then 'missing_weather' else 'estimate' end as status from k)
    select cast(province as bigint) as province, cast(year_ce as bigint) as year_ce, status,
        case when status = 'estimate' then round(greatest(0.0, my + (lag - m1) / s1 * w1 + (area - m2) / s2 * w2), 4) end as predicted from p cross join w""")
def _(t):
    rows = panel(t)
    models = M.ridge_fit(rows.where("year_ce <= 1997"), ["lag", "area"], "target", [1], [])
    keys = t.year.select("province", "year_ce", F.make_date("year_ce", F.lit(9), F.lit(30)).alias("window_end"))
    features = rows.select("province", "year_ce", "lag", F.when(F.col("province") != 3, F.col("area")).alias("area"))
    out = M.dated_estimate(keys, features, models, ["province", "year_ce"], ["lag", "area"], "lag", "window_end", F.lit("2000-06-01").cast("date"))
    return out.select(*ints("province", "year_ce"), "status", F.round("predicted", 4).alias("predicted"))


@query("m24_policy_winners", "month", """
    with s as (select province, month as config, month % 3 as g, round(avg(abs(tonnes - 900)), 3) as score from month group by all),
    p as (select province, 'g' || g as policy, config, score from s union all select province, 'inner_selected', config, score from s union all select province, 'pair', config, score from s where g in (0, 1))
    select cast(province as bigint) as province, policy, cast(config as bigint) as config, score from p qualify row_number() over (partition by province, policy order by score, config) = 1""")
def _(t):
    scores = t.month.groupBy("province", F.col("month").alias("config")).agg(F.round(F.avg(F.abs(F.col("tonnes") - 900)), 3).alias("score")).withColumn(
        "g", F.concat(F.lit("g"), F.col("config") % 3))
    out = M.policy_winners(scores, ["province"], "g", "score", "config", {"pair": ["g0", "g1"]})
    return out.select(*ints("province"), "policy", *ints("config"), "score")
