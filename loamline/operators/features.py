"""Feature builders on entity-year keys.

A harvest season is a run of possible harvest days. Each day h defines a cohort whose bloom is h - age, and
a stage window [start, stop) counts days from bloom. Averages over all (cohort, day) cells need only the
number of cohorts that touch each calendar day, so a key spreads to its days with that weight (about two
hundred rows) instead of to every cell. Features that need the order of days inside a cohort read one array
per key, bounded by the same span.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.functions.climate import cyclic, one_hot
from loamline.functions.dates import completed_key, to_local
from loamline.operators import joins as J
from loamline.operators.aggregates import calendar_normals, digest_group, month_length, peak_window, weighted_summary
from loamline.operators.quality import eligibility
from loamline.operators.scan import grouped_quantiles
from loamline.operators.windows import dedupe_last, lag_delta_full, lead_target_full

# Stage windows in days from bloom; ``None`` ends at harvest.
STAGE_WINDOWS = {
    "pre_bloom_90d": (-90, 0), "fruit_0_29d": (0, 30), "fruit_30_59d": (30, 60), "fruit_60_89d": (60, 90),
    "fruit_90_to_harvest": (90, None),
}


def season_days(keys: DataFrame, year: str, season_start: str, months: int = 3) -> DataFrame:
    """Adds the first and last harvest day (``_h0``, ``_h1``) of the season."""
    first = F.make_date(year, season_start, F.lit(1))
    return keys.withColumns({"_h0": first, "_h1": F.date_sub(F.add_months(first, months), 1)})


def _window_table(windows: Mapping[str, tuple[int, int | None]], ages: Sequence[int]) -> Column:
    rows = [F.struct(F.lit(a).alias("age"), F.lit(n).alias("stage"), F.lit(s).alias("start"),
                     F.lit(a if e is None else e).alias("stop")) for a in ages for n, (s, e) in windows.items()]
    return F.explode(F.array(*rows))


def stage_cells(seasons: DataFrame, by: Sequence[str], ages: Sequence[int],
                windows: Mapping[str, tuple[int, int | None]] = STAGE_WINDOWS) -> DataFrame:
    """(by, age, stage, day, weight, cohorts, cells): how many cohorts touch the day inside the window."""
    spread = seasons.withColumn("_w", _window_table(windows, ages)).select(*by, "_h0", "_h1", "_w.*")
    low = F.date_add("_h0", F.col("start") - F.col("age"))
    high = F.date_add("_h1", F.col("stop") - F.col("age") - 1)
    days = spread.withColumn("day", F.explode(F.sequence(low, high)))
    # Cohorts h with start <= day - h + age < stop, clipped to the season.
    first = F.greatest(F.unix_date("_h0"), F.unix_date("day") + F.col("age") - F.col("stop") + 1)
    last = F.least(F.unix_date("_h1"), F.unix_date("day") + F.col("age") - F.col("start"))
    cohorts = F.datediff("_h1", "_h0") + 1
    return days.select(*by, "age", "stage", "day", (last - first + 1).cast("long").alias("weight"), cohorts.alias("cohorts"),
                       (cohorts * (F.col("stop") - F.col("start"))).cast("long").alias("cells"))


def reduce_cells(cells: DataFrame, by: Sequence[str], measures: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Reduce joined cells. ``measures`` maps an output name to (column, reducer): mean, sum (per cohort, then
    over cohorts) or p90. Null unless every cell has a value; the coverage percent is kept."""
    w = F.col("weight")
    aggs = [F.first("cells").alias("cells"), F.first("cohorts").alias("cohorts")]
    for name, (c, kind) in measures.items():
        aggs += [F.coalesce(F.sum(F.when(F.col(c).isNotNull(), w)), F.lit(0)).alias(f"_k_{name}")]
        aggs += [F.percentile(c, 0.9, w).alias(f"_v_{name}") if kind == "p90" else F.sum(F.col(c) * w).alias(f"_v_{name}")]
    out = cells.groupBy(*by).agg(*aggs)
    final = []
    for name, (_, kind) in measures.items():
        value = F.col(f"_v_{name}")
        if kind == "mean":
            value = value / F.col("cells")
        elif kind == "sum":
            value = value / F.col("cohorts")
        final += [F.when(F.col(f"_k_{name}") == F.col("cells"), value).alias(name),
                  (100.0 * F.col(f"_k_{name}") / F.col("cells")).alias(f"{name}_coverage_pct")]
    return out.select(*by, *final)


def stage_exposure(seasons: DataFrame, daily: DataFrame, entity: Sequence[str], keys: Sequence[str], ages: Sequence[int],
                   measures: Mapping[str, tuple[str, str]], windows: Mapping[str, tuple[int, int | None]] = STAGE_WINDOWS
                   ) -> DataFrame:
    """Stage features of every key, age and window. ``keys`` identify a season and include ``entity``."""
    cells = stage_cells(seasons, keys, ages, windows)
    columns = sorted({c for c, _ in measures.values()})
    joined = cells.join(daily.select(*entity, "day", *columns), [*entity, "day"], "left")
    return reduce_cells(joined, [*keys, "age", "stage"], measures)


def stage_table(exposure: DataFrame, keys: Sequence[str], stages: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Wide form: one row per key and age, one column per (stage, field)."""
    return exposure.groupBy(*keys, "age").agg(*[
        F.max(F.when(F.col("stage") == s, F.col(f))).alias(f"{s}_{f}") for s in stages for f in fields])


def backcast(harvest: DataFrame, annual: DataFrame, daily: DataFrame, entity: str, year: str, month: str, tonnes: str,
             ages: Sequence[int], measures: Mapping[str, tuple[str, str]], production: str, bearing: str
             ) -> tuple[DataFrame, DataFrame]:
    """(monthly cohorts, annual scopes). Each reported month with a harvest is a season of its own; the annual
    rows weight the months by tonnes over all reported months and over the best three."""
    reported = harvest.where(F.col(tonnes) > 0)
    main = peak_window(reported, [entity, year], month, tonnes).select(entity, year, F.col("start_month").alias("main_start"))
    totals = reported.groupBy(entity, year).agg(F.sum(tonnes).alias("reported_tonnes"), F.count("*").alias("reported_months"))
    months = reported.join(main, [entity, year]).join(totals, [entity, year]).withColumns({
        "share_pct": 100 * F.col(tonnes) / F.col("reported_tonnes"),
        "in_main": F.col(month).between(F.col("main_start"), F.col("main_start") + 2)})
    seasons = season_days(reported.select(entity, year, month), year, month, 1)
    windows = {**STAGE_WINDOWS, "fruit_full": (0, None)}
    exposure = stage_exposure(seasons, daily, [entity], [entity, year, month], ages, measures, windows)
    fields = list(measures)
    features = [f"{s}_{f}" for s in windows for f in fields]
    wide = stage_table(exposure, [entity, year, month], list(windows), fields)
    bloom = {"bloom_start": F.date_sub(F.make_date(year, month, F.lit(1)), F.col("age")),
             "bloom_end": F.date_sub(F.last_day(F.make_date(year, month, F.lit(1))), F.col("age"))}
    monthly = months.join(wide, [entity, year, month]).withColumns(bloom)
    scopes = F.when(F.col("in_main"), F.array(F.lit("all_reported"), F.lit("main_peak3"))).otherwise(F.array(F.lit("all_reported")))
    scoped = monthly.withColumn("scope", F.explode(scopes))
    keys = [entity, year, "age", "scope"]
    yearly = weighted_summary(scoped, keys, tonnes, features).withColumnRenamed("total_weight", "selected_tonnes")
    extra = scoped.groupBy(*keys).agg(F.count("*").alias("selected_months"), F.min("bloom_start").alias("bloom_start"),
                                      F.max("bloom_end").alias("bloom_end"), F.first("reported_tonnes").alias("reported_tonnes"))
    yearly = yearly.join(extra, keys).join(annual.select(entity, year, F.col(production).alias("annual_production"),
                                                         F.col(bearing).alias("annual_bearing")), [entity, year], "left")
    yearly = yearly.withColumns({
        "selected_share_pct": 100 * F.col("selected_tonnes") / F.col("reported_tonnes"),
        "annual_yield": F.when(F.col("annual_bearing") > 0, F.col("annual_production") * 1000 / F.col("annual_bearing")),
        "monthly_to_annual_pct": F.when(F.col("annual_production") > 0, 100 * F.col("reported_tonnes") / F.col("annual_production"))})
    return monthly, yearly


def day_arrays(seasons: DataFrame, daily: DataFrame, entity: Sequence[str], keys: Sequence[str], age: int, start: int,
               stop: int, columns: Sequence[str]) -> DataFrame:
    """Per key the daily values from the first cohort's ``start`` to the last cohort's ``stop``: one array per
    column, one element per calendar day, null where missing. Element i belongs to cohort i at ``start``."""
    spread = seasons.select(*keys, (F.datediff("_h1", "_h0") + 1).alias("cohorts"), F.explode(F.sequence(
        F.date_add("_h0", start - age), F.date_add("_h1", stop - age - 1))).alias("day"))
    joined = spread.join(daily.select(*entity, "day", *columns), [*entity, "day"], "left")
    rows = joined.groupBy(*keys).agg(F.first("cohorts").alias("cohorts"),
                                     F.array_sort(F.collect_list(F.struct("day", *columns))).alias("_a"))
    return rows.select(*keys, "cohorts", *[F.col(f"_a.{c}").alias(c) for c in columns])


def run_length(flags: Column) -> Column:
    """Longest run of true values in an array."""
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(acc, flag):
        now = F.when(flag, acc["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["best"], now).alias("best"))

    return F.aggregate(flags, zero, step, lambda acc: acc["best"])


def over_cohorts(n: Column, per_cohort) -> Column:
    """Mean over cohorts i = 0..n-1 of a per-cohort number."""
    values = F.transform(F.sequence(F.lit(0), n - 1), per_cohort)
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n


def sliding(values: Column, k: int) -> Column:
    """Sums of k neighbouring elements."""
    return F.transform(F.sequence(F.lit(1), F.size(values) - k + 1),
                       lambda i: reduce(lambda a, b: a + b, [F.element_at(values, i + j) for j in range(k)]))


def _complete(*arrays: str) -> Column:
    test = F.lit(True)
    for a in arrays:
        test = test & ~F.exists(a, lambda v: v.isNull())
    return test


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and use it in ``fn``: a plain column reference inside a lambda would be
    evaluated again for every element."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def shock_features(seasons: DataFrame, daily: DataFrame, entity: Sequence[str], keys: Sequence[str], age: int,
                   rain: str = "rain_mm", tmax: str = "t_max", dry_mm: float = 1, hot: Sequence[float] = (35, 38)) -> DataFrame:
    """Cohort means of dry runs, hot days, hot runs and the largest 3- and 7-day rain. Null when a day is missing."""
    days = day_arrays(seasons, daily, entity, keys, age, -90, age, [rain, tmax])
    r, x, n = F.col(rain), F.col(tmax), F.col("cohorts")
    shared = F.struct(
        F.transform(r, lambda v: v < dry_mm).alias("dry"), *[
            F.transform(x, lambda v: v > limit).alias(f"hot{k}") for k, limit in enumerate(hot)],
        sliding(r, 3).alias("s3"), sliding(r, 7).alias("s7"))

    def features(s):
        def window_run(name, offset, length):
            return over_cohorts(n, lambda i: run_length(F.slice(s[name], i + 1 + offset, length)))

        def window_days(name):
            return over_cohorts(n, lambda i: F.size(F.filter(F.slice(s[name], i + 91, 30), lambda v: v)))

        def largest(k):
            return over_cohorts(n, lambda i: F.array_max(F.slice(s[f"s{k}"], i + 91, age - k + 1)))

        out = {"pre_bloom_dry_run": window_run("dry", 0, 90), "early_dry_run": window_run("dry", 90, 30)}
        for k, limit in enumerate(hot):
            out[f"early_hot{limit:g}_days"] = window_days(f"hot{k}")
        out[f"early_hot{hot[0]:g}_run"] = window_run("hot0", 90, 30)
        out |= {"fruit_rx3": largest(3), "fruit_rx7": largest(7)}
        return F.struct(*[c.alias(name) for name, c in out.items()])

    done_rows = days.select(*keys, F.when(_complete(rain, tmax), let(shared, features)).alias("_f"))
    return done_rows.select(*keys, "_f.*")


def critical_features(seasons: DataFrame, daily: DataFrame, entity: Sequence[str], keys: Sequence[str], age: int,
                      rain: str = "rain_mm", tmax: str = "t_max", dry_mm: float = 1, wet_mm: float = 10, hot: float = 38
                      ) -> DataFrame:
    """Days 30..50 after bloom: dry run, hot days, hot run, heavy rain after a dry week, heat x dry."""
    days = day_arrays(seasons, daily, entity, keys, age, 23, 51, [rain, tmax])
    r, x, n = F.col(rain), F.col(tmax), F.col("cohorts")
    flags = F.struct(F.transform(r, lambda v: v < dry_mm).alias("dry"), F.transform(r, lambda v: v >= wet_mm).alias("wet"),
                     F.transform(x, lambda v: v > hot).alias("hot"))

    def with_surge(f):
        # A surge day is judged once per calendar day: wet after seven dry days.
        surge = F.transform(F.sequence(F.lit(8), F.size(f["wet"])), lambda p: F.element_at(f["wet"], p) & F.forall(
            F.slice(f["dry"], p - 7, 7), lambda v: v))
        return let(F.struct(f["dry"].alias("dry"), f["hot"].alias("hot"), surge.alias("surge")), features)

    def features(s):
        def dry_run(i):
            return run_length(F.slice(s["dry"], i + 8, 21))

        def count(name, i, offset):
            return F.size(F.filter(F.slice(s[name], i + offset, 21), lambda v: v))

        return F.struct(
            over_cohorts(n, dry_run).alias("dry_run"), over_cohorts(n, lambda i: count("hot", i, 8)).alias("hot_days"),
            over_cohorts(n, lambda i: run_length(F.slice(s["hot"], i + 8, 21))).alias("hot_run"),
            over_cohorts(n, lambda i: count("surge", i, 1)).alias("rain_after_dry"),
            over_cohorts(n, lambda i: count("hot", i, 8) * dry_run(i)).alias("heat_x_dry"))

    done_rows = days.select(*keys, F.when(_complete(rain, tmax), let(flags, with_surge)).alias("_f"))
    return done_rows.select(*keys, "_f.*")


def trigger_windows(seasons: DataFrame, searched: DataFrame, keys: Sequence[str], age: int, lag: int = 50, tol: int = 30
                    ) -> DataFrame:
    """Bloom of every cohort: the trigger plus ``lag`` nearest to the nominal bloom within ``tol`` days (a tie
    goes to the earlier), else the nominal bloom. One row per key with arrays of blooms and flags.

    ``searched`` has the keys and ``triggers`` (sorted dates) as made by ``trigger_search``.
    """
    joined = seasons.join(searched.select(*keys, "triggers"), list(keys), "left")
    found = F.coalesce("triggers", F.array().cast("array<date>"))
    harvest = F.sequence("_h0", "_h1")

    def bloom(h):
        nominal = F.date_sub(h, age)
        options = F.transform(found, lambda d: F.struct(F.abs(F.datediff(F.date_add(d, lag), nominal)).alias("gap"),
                                                        F.date_add(d, lag).alias("bloom")))
        best = F.array_min(F.filter(options, lambda o: o["gap"] <= tol))
        return F.struct(F.coalesce(best["bloom"], nominal).alias("bloom"), best.isNotNull().alias("detected"),
                        nominal.alias("nominal"))

    out = joined.withColumn("cohort", F.transform(harvest, bloom))
    n = F.size("cohort")
    hits = F.size(F.filter("cohort", lambda c: c["detected"]))
    shift = F.aggregate("cohort", F.lit(0).cast("long"), lambda a, c: a + F.datediff(c["bloom"], c["nominal"])) / n
    status = F.when(hits == 0, "not_found").when(hits == n, "all_cohorts").otherwise("partial_fallback")
    return out.select(*keys, "cohort", n.alias("cohorts"), hits.alias("trigger_cohorts"), shift.alias("mean_shift_days"),
                      status.alias("trigger_status"),
                      F.array_min(F.transform("cohort", lambda c: c["bloom"])).alias("bloom_start"),
                      F.array_max(F.transform("cohort", lambda c: c["bloom"])).alias("bloom_end"))


def bloom_exposure(blooms: DataFrame, daily: DataFrame, entity: Sequence[str], keys: Sequence[str], age: int,
                   measures: Mapping[str, tuple[str, str]], windows: Mapping[str, tuple[int, int | None]] = STAGE_WINDOWS
                   ) -> DataFrame:
    """Stage features for explicit blooms. Cohorts that share a bloom are one row with their count as weight."""
    shared = blooms.select(*keys, "cohorts", F.explode("cohort").alias("c")).groupBy(*keys, "cohorts", "c.bloom").agg(
        F.count("*").alias("_n"))
    spread = shared.withColumn("_w", _window_table(windows, [age])).select(*keys, "cohorts", "bloom", "_n", "_w.*")
    cells = spread.select(
        *keys, "stage", "age", "cohorts", (F.col("cohorts") * (F.col("stop") - F.col("start"))).cast("long").alias("cells"),
        F.col("_n").alias("weight"), F.explode(F.sequence(F.date_add("bloom", F.col("start")), F.date_add("bloom", F.col("stop") - 1))).alias("day"))
    per_day = cells.groupBy(*keys, "age", "stage", "cohorts", "cells", "day").agg(F.sum("weight").alias("weight"))
    columns = sorted({c for c, _ in measures.values()})
    joined = per_day.join(daily.select(*entity, "day", *columns), [*entity, "day"], "left")
    return reduce_cells(joined, [*keys, "age", "stage"], measures)


def issue_cells(seasons: DataFrame, daily: DataFrame, entity: Sequence[str], keys: Sequence[str], year: str, age: int,
                lead: int, columns: Sequence[str], weather_lag: int = 7, years_back: int = 10, min_n: int = 8,
                windows: Mapping[str, tuple[int, int | None]] = STAGE_WINDOWS) -> DataFrame:
    """Cells as known at issue: days up to issue - lag carry observations, later days the normals of the years
    before the row's year. ``issue`` is ``lead`` days before the first harvest day."""
    issue = F.date_sub("_h0", lead)
    dated = seasons.withColumns({"issue": issue, "available": F.date_sub(issue, weather_lag)})
    cells = stage_cells(dated, [*keys, "issue", "available"], [age], windows)
    normals = calendar_normals(daily, seasons, entity, "day", year, columns, years_back, min_n)
    normals = normals.select(*entity, year, "mmdd", *[F.col(c).alias(f"_n_{c}") for c in columns])
    joined = cells.withColumn("mmdd", F.date_format("day", "MM-dd")).join(
        daily.select(*entity, "day", *columns), [*entity, "day"], "left").join(normals, [*entity, year, "mmdd"], "left")
    seen = F.col("day") <= F.col("available")
    return joined.withColumn("observed", seen).withColumns(
        {c: F.when(seen, F.col(c)).otherwise(F.col(f"_n_{c}")) for c in columns}).drop(*[f"_n_{c}" for c in columns])


def issue_features(cells: DataFrame, keys: Sequence[str], predictors: Mapping[str, tuple[str, str, str]]) -> DataFrame:
    """Wide features from ``issue_cells``. ``predictors`` maps a name to (stage, column, reducer). A missing
    observation or normal leaves the feature null and the status tells so; nothing is filled with zero."""
    columns = {}
    for name, (stage, c, kind) in predictors.items():
        mine = F.col("stage") == stage
        v, w = F.when(mine, F.col(c)), F.when(mine, F.col("weight"))
        full = F.sum(F.when(v.isNotNull(), w)) == F.max(F.when(mine, F.col("cells")))
        value = (F.percentile(v, 0.9, F.coalesce(w, F.lit(0))) if kind == "p90" else F.sum(v * w) / F.max(
            F.when(mine, F.col("cells" if kind == "mean" else "cohorts"))))
        columns[name] = F.when(full, value)
        columns[f"{name}_observed"] = F.coalesce(F.sum(F.when(F.col("observed"), w)), F.lit(0)) / F.sum(w)
    out = cells.groupBy(*keys, "issue").agg(*[c.alias(n) for n, c in columns.items()])
    missing = reduce(lambda a, b: a | b, [F.col(n).isNull() for n in predictors])
    return out.withColumn("status", F.when(missing, "missing_weather").otherwise("ok"))


def feature_lineage(cells: DataFrame, daily: DataFrame, entity: Sequence[str], keys: Sequence[str], year: str, column: str,
                    years_back: int = 10) -> DataFrame:
    """Per key and stage: the dates consumed as observation and as normal, the cell counts, and digests of the
    consumed values. Lists hold dates of one season, at most a few hundred (normals: times ``years_back``)."""
    w = F.col("weight")
    seen = F.when(F.col("observed"), F.struct(F.col("day").cast("string").alias("d"), F.col(column).alias("v")))
    main = cells.groupBy(*keys, "stage", "issue").agg(
        F.array_sort(F.collect_set(seen)).alias("_o"), F.coalesce(F.sum(F.when(F.col("observed"), w)), F.lit(0)).alias("observed_cells"),
        F.coalesce(F.sum(F.when(~F.col("observed"), w)), F.lit(0)).alias("climatology_cells"), F.first("cells").alias("cells"))
    used = cells.where("not observed").select(*keys, "stage", F.explode(F.when(
        F.col("mmdd") == "02-29", F.array(F.lit("02-28"), F.lit("03-01"))).otherwise(F.array("mmdd"))).alias("mmdd")).distinct()
    used = used.withColumn("_y", F.explode(F.sequence(F.col(year) - years_back, F.col(year) - 1)))
    day = F.concat_ws("-", F.col("_y").cast("string"), F.col("mmdd")).try_cast("date")
    history = used.withColumn("day", day).join(daily.select(*entity, "day", F.col(column).alias("_v")), [*entity, "day"]).where("_v is not null")
    normals = history.groupBy(*keys, "stage").agg(
        F.array_sort(F.collect_list(F.struct(F.col("day").cast("string").alias("d"), F.col("_v").alias("v")))).alias("_n"))
    out = main.join(normals, [*keys, "stage"], "left")

    def dates(c):
        return F.coalesce(F.transform(c, lambda r: r["d"].cast("date")), F.array().cast("array<date>"))

    return out.select(*keys, "stage", "issue", dates("_o").alias("observed_dates"), dates("_n").alias("normal_dates"),
                      "observed_cells", "climatology_cells", "cells", F.sha2(F.to_json("_o"), 256).alias("observed_values_sha256"),
                      F.sha2(F.coalesce(F.to_json("_n"), F.lit("[]")), 256).alias("normal_values_sha256"))


def month_union(weather: DataFrame, harvest: DataFrame, by: Sequence[str], year: str, month: str, lagged: Sequence[str]
                ) -> DataFrame:
    """Full union of the month keys of two tables, with the weather of the month before under ``lag_`` names."""
    keys = [*by, "_m"]
    index = (F.col(year) * 12 + F.col(month) - 1).cast("long")
    a = weather.withColumn("_m", index).drop(year, month)
    b = harvest.withColumn("_m", index).drop(year, month)
    before = a.select(*by, (F.col("_m") + 1).alias("_m"), *[F.col(c).alias(f"lag_{c}") for c in lagged])
    out = a.join(b, keys, "full_outer").join(before, keys, "left")
    return out.withColumns({year: F.floor(F.col("_m") / 12), month: F.col("_m") % 12 + 1}).drop("_m")


def lag_month_panel(weather: DataFrame, harvest: DataFrame, by: Sequence[str], year: str, month: str, fields: Sequence[str],
                    target: str) -> DataFrame:
    """Modelling panel: target of the month, weather of the month before, coverage and exclusion reasons.
    ``weather`` has ``<field>`` and ``<field>_days`` per month."""
    columns = [*fields, *[f"{f}_days" for f in fields]]
    panel = month_union(weather, harvest, by, year, month, columns)
    before = F.add_months(F.make_date(F.col(year).cast("int"), F.col(month).cast("int"), F.lit(1)), -1)
    panel = panel.withColumn("lag_expected_days", F.dayofmonth(F.last_day(before)))
    short = reduce(lambda a, b: a | b, [~F.coalesce(F.col(f"lag_{f}_days") == F.col("lag_expected_days"), F.lit(False)) for f in fields])
    empty = reduce(lambda a, b: a | b, [F.col(f"lag_{f}").isNull() for f in fields])
    out = eligibility(panel, {"no_target_record": F.col(target).isNull(), "incomplete_lag_daily_coverage": short,
                              "missing_lag_feature": empty})
    return out.select(*by, year, month, target, *[f"lag_{c}" for c in columns], "lag_expected_days", "eligible", "exclusion_reason")


def pre_anchor_windows(daily: DataFrame, anchors: DataFrame, by: Sequence[str], year: str, anchor: str, means: Sequence[str],
                       sums: Sequence[str], windows: Sequence[int] = (1, 2, 3, 4, 5, 6)) -> DataFrame:
    """Means and sums over the 1..6 full months before the anchor month; one incomplete month nulls every
    window that holds it. Columns ``w<k>_<field>``."""
    fields = [*means, *sums]
    longest = max(windows)
    months = daily.groupBy(*by, (F.year("day") * 12 + F.month("day") - 1).alias("_m")).agg(
        *[F.sum(c).alias(f"_s_{c}") for c in fields], *[F.count(c).alias(f"_n_{c}") for c in fields],
        F.first(month_length(F.year("day"), F.month("day"))).alias("_days"))
    full = reduce(lambda a, b: a & b, [F.col(f"_n_{c}") == F.col("_days") for c in fields])
    months = months.withColumn("_full", full)
    spread = anchors.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(longest)))).withColumn(
        "_m", F.col(year) * 12 + F.col(anchor) - 1 - F.col("_k"))
    joined = spread.join(months, [*by, "_m"], "left")
    aggs = []
    for k in windows:
        mine = F.col("_k") <= k
        ok = F.count_if(mine & F.coalesce(F.col("_full"), F.lit(False))) == k
        days = F.sum(F.when(mine, F.col("_days")))
        for c in fields:
            total = F.sum(F.when(mine, F.col(f"_s_{c}")))
            aggs.append(F.when(ok, total / days if c in means else total).alias(f"w{k}_{c}"))
    return joined.groupBy(*anchors.columns).agg(*aggs)


def interval_features(seasons: DataFrame, intervals: DataFrame, entity: Sequence[str], keys: Sequence[str], age: int, value: str,
                      start: str, end: str, min_coverage: float = 50.0) -> DataFrame:
    """Overlap-weighted interval values over the pre-bloom and fruit windows of all cohorts."""
    cells = stage_cells(seasons, keys, [age], {"pre_bloom": (-90, 0), "fruit": (0, None)})
    density = J.interval_density(cells, intervals, entity, start, end, value).select(
        *entity, "day", F.col("n").alias("_n"), F.col("v").alias("_v"))
    joined = cells.join(density, [*entity, "day"], "left")
    w = F.col("weight")
    out = joined.groupBy(*keys, "stage").agg(
        F.coalesce(F.sum(w * F.col("_n")), F.lit(0)).alias("_k"), F.sum(w * F.col("_v")).alias("_s"), F.first("cells").alias("_c"))
    coverage = 100.0 * F.col("_k") / F.col("_c")
    return out.select(*keys, "stage", coverage.alias("coverage_pct"), F.when(coverage >= min_coverage, F.col("_s") / F.col("_k")).alias("mean_value"))


def interval_year(intervals: DataFrame, entity: Sequence[str], value: str, start: str, end: str, min_coverage: float = 50.0
                  ) -> DataFrame:
    """Calendar-year mean by overlap, coverage, and the tenth percentile of the intervals starting in the year."""
    windows = intervals.select(*entity, F.year(start).alias("year")).distinct().withColumns({
        "_a": F.make_date("year", F.lit(1), F.lit(1)), "_b": F.make_date(F.col("year") + 1, F.lit(1), F.lit(1))})
    exposure = J.interval_exposure(windows, intervals, entity, ["year"], "_a", "_b", value, start, end, min_coverage)
    tail = grouped_quantiles(intervals.withColumn("year", F.year(start)), [*entity, "year"], value, {"p10": 0.1}).drop("n")
    return exposure.join(tail, [*entity, "year"], "left").withColumn(
        "p10", F.when(F.col("coverage_pct") >= min_coverage, F.col("p10")))


def climate_context(seasons: DataFrame, daily: DataFrame, index: DataFrame, entity: Sequence[str], keys: Sequence[str],
                    measures: Mapping[str, tuple[str, str]], age: int = 120) -> DataFrame:
    """Reference-window climate and the index known on each day of it (centre month two months back).
    ``index`` has (key_year, key_month, index_value)."""
    ky, km = completed_key("day")
    cells = stage_cells(seasons, keys, [age], {"reference": (0, age)}).withColumns({"key_year": ky, "key_month": km})
    columns = sorted({c for c, _ in measures.values()})
    joined = cells.join(daily.select(*entity, "day", *columns), [*entity, "day"], "left").join(index, ["key_year", "key_month"], "left")
    return reduce_cells(joined, list(keys), {**measures, "reference_index": ("index_value", "mean")})


def pick_age(bank: DataFrame, ages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each key takes the features of its own age."""
    return ages.join(bank, [*keys, "age"], "left")


def state_features(folds: DataFrame, documents: DataFrame, issue: str, cutoff: str, published: str, state: str,
                   vocabulary: Sequence[str], max_age_days: int = 45, by: Sequence[str] = ()) -> DataFrame:
    """One-hot state of the latest document strictly before the earlier of issue and cutoff."""
    use = folds.withColumn("_use", F.least(issue, cutoff))
    matched = J.asof_join(use, documents, by, "_use", published, max_age_days * 86400, True, [state], slice_seconds=365 * 86400)
    return matched.select(*folds.columns, "asof_status", F.col(f"asof_{published}").alias("document_day"),
                          *one_hot(f"asof_{state}", vocabulary, "state_"))


def soil_panel(hourly: DataFrame, vintages: DataFrame, by: Sequence[str], hour: str, soil: str, horizon: int, measures: Mapping[str, Column],
               required: Sequence[str], lookback_hours: int = 24, zone: str = "UTC") -> DataFrame:
    """Hourly origins with the full-path lag and target, local-time encodings and the forecast known then."""
    out = lag_delta_full(hourly, by, hour, soil, 3, "soil_delta_3h")
    out = lead_target_full(out, by, hour, soil, horizon, "target_soil")
    sin, cos = cyclic(F.hour(to_local(hour, zone)), 24)
    out = out.withColumns({"hour_sin": sin, "hour_cos": cos, "target_time": F.timestamp_seconds(
        F.unix_seconds(F.col(hour).cast("timestamp")) + horizon * 3600)})
    return J.vintage_asof(out, vintages, by, hour, horizon, lookback_hours, measures, required)


def sensor_training(df: DataFrame, event: str, order: Sequence[str], required: Sequence[str], ts: str, zone: str = "UTC") -> DataFrame:
    """Deduplicated readings with all key fields, plus cyclic hour and day-of-year."""
    rows = dedupe_last(df.dropna(subset=list(required)), [event], order)
    local = to_local(ts, zone)
    hs, hc = cyclic(F.hour(local) + F.minute(local) / 60, 24)
    ds, dc = cyclic(F.dayofyear(local), 365.25)
    return rows.withColumns({"hour_sin": hs, "hour_cos": hc, "doy_sin": ds, "doy_cos": dc})


def fold_list(outer_years: Sequence[int], inner: int = 3) -> list[tuple[int, int, str]]:
    """(outer year, fold year, stage): the outer year itself and the inner years before it."""
    return [(o, y, "inner") for o in outer_years for y in range(o - inner, o)] + [(o, o, "outer") for o in outer_years]


def nested_folds(panel: DataFrame, year: str, target: str, outer_years: Sequence[int], inner: int = 3) -> DataFrame:
    """Every fold's rows with their role. A panel row spreads to the folds it can serve, without a join.

    ``train`` rows precede the fold year and keep the target; ``forecast`` rows are the fold year without
    it; ``evaluation`` rows are the fold year with it. Nothing later than the fold year is ever in a fold.
    """
    folds = F.array(*[F.struct(F.lit(o).alias("outer_year"), F.lit(f).alias("fold_year"), F.lit(s).alias("fold_stage"))
                      for o, f, s in fold_list(outer_years, inner)])
    usable = F.filter(folds, lambda f: f["fold_year"] >= F.col(year))
    rows = panel.withColumn("_f", F.explode(usable))
    roles = F.when(F.col("_f.fold_year") > F.col(year), F.array(F.lit("train"))).otherwise(
        F.array(F.lit("forecast"), F.lit("evaluation")))
    rows = rows.withColumn("role", F.explode(roles)).select(*panel.columns, "_f.*", "role")
    return rows.withColumn(target, F.when(F.col("role") != "forecast", F.col(target)))


def fold_completeness(folds: DataFrame, year: str, entities: int, first_year: int) -> DataFrame:
    """Rows per fold and role against entities x years; ``complete`` is false where any is missing."""
    out = folds.groupBy("outer_year", "fold_year", "fold_stage", "role").agg(F.count("*").alias("rows"), F.max(year).alias("last_year"))
    want = F.when(F.col("role") == "train", entities * (F.col("fold_year") - first_year)).otherwise(entities)
    return out.withColumn("expected_rows", want.cast("long")).withColumn("complete", F.col("rows") == F.col("expected_rows"))


def target_pairs(folds: DataFrame, annual: DataFrame, entity: Sequence[str], year: str, value: str) -> DataFrame:
    """(current, prior, delta) of every labelled fold row; the prior is exactly the year before."""
    pairs = J.prev_period_join(annual.select(*entity, year, value), list(entity), year, [value])
    pairs = pairs.select(*entity, year, F.col(value).alias("current"), F.col(f"previous_{value}").alias("prior"))
    rows = folds.where("role <> 'forecast'").select("outer_year", "fold_year", "fold_stage", "role", *entity, year)
    return rows.join(pairs, [*entity, year], "left").withColumn("delta", F.col("current") - F.col("prior"))


def registry_aggregates(df: DataFrame, entity: Sequence[str], district: str, year: str, area: str, columns: Sequence[str]
                        ) -> DataFrame:
    """Area and record sums per district and year, and whether another year of the entity has the same rows."""
    sums = df.groupBy(*entity, district, year).agg(
        F.count("*").alias("records"), F.sum(area).alias("area"), F.count_if(F.col(area) == 0).alias("zero_area"))
    digests = digest_group(df, [*entity, year], columns)
    repeats = digests.groupBy(*entity, "digest").agg(F.count("*").alias("_years"))
    flags = digests.join(repeats, [*entity, "digest"]).select(*entity, year, (F.col("_years") > 1).alias("repeated_year"))
    return sums.join(flags, [*entity, year])


def district_evidence(documented: DataFrame, points: DataFrame, units: DataFrame, key: Sequence[str], unit: str, tol: float = 2.0
                      ) -> DataFrame:
    """Documented targets with their reference point and the set of mapped units of the district. Columns of
    ``documented``: bearing, production, reported. Units are context, never an allocation."""
    listed = units.select(*key, unit).distinct().groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list(unit)), ";").alias("units"))
    calculated = F.when(F.col("bearing") > 0, F.col("production") * 1000 / F.col("bearing"))
    out = documented.withColumn("calculated", calculated).join(points, list(key), "left").join(listed, list(key), "left")
    return out.withColumn("precision_warning", F.coalesce(F.abs(F.col("calculated") - F.col("reported")) > tol, F.lit(False)))
