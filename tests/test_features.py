"""Cohort windows, triggers, seasons and leakage checks on small daily series."""

import datetime as dt
from types import SimpleNamespace

from pyspark.sql import functions as F

from loamline.functions import arrays, climate, dates
from loamline.operators import aggregates as A
from loamline.operators import features as B
from loamline.operators import models as M
from loamline.operators import windows as W
from loamline.plans.catalog import REGISTRY

DAY0 = dt.date(2024, 1, 1)


def daily(spark, values, column="rain_mm", **extra):
    rows = [("p", DAY0 + dt.timedelta(days=i), v, *[e[i] for e in extra.values()]) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "e string, day date, " + ", ".join(f"{c} double" for c in [column, *extra]))


def scalar(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_longest_run(spark):
    for mask, want in (([1, 1, 0, 1], 2), ([0, 1, 1, 1], 3)):
        df = daily(spark, [float(m) for m in mask])
        assert W.longest_run(df, ["e"], "day", F.col("rain_mm") == 1, "n").first()["n"] == want
        assert scalar(spark, B.run_length(F.transform(F.array(*[F.lit(m) for m in mask]), lambda v: v == 1))) == want


def search(spark, rain, start, stop, **kw):
    found = W.dry_triggers(daily(spark, rain), ["e"], "day", "rain_mm", **kw)
    window = spark.createDataFrame([("p", DAY0 + dt.timedelta(days=start), DAY0 + dt.timedelta(days=stop))], "e string, start date, end date")
    return W.trigger_search(found, window, ["e"], "day").first()


def rain_with(dry, wet=()):
    values = [10.0] * 130
    for a, b in dry:
        values[a:b] = [0.0] * (b - a)
    for day, mm in wet:
        values[day] = mm
    return values


def test_dry_trigger_day(spark):
    got = search(spark, rain_with([(25, 45)]), 20, 80)
    assert got["triggers"] == [DAY0 + dt.timedelta(days=39 - 1)] and not got["left_censored"]


def test_dry_trigger_reset_and_censoring(spark):
    rain = rain_with([(25, 45), (70, 90)], [(50, 26.0)])
    got = search(spark, rain, 20, 95, reset_mm=25)
    assert got["triggers"] == [DAY0 + dt.timedelta(days=83)] and got["rejected_rain_reset"] == 1
    got = search(spark, rain_with([(20, 60)]), 40, 58)
    assert got["triggers"] == [] and got["left_censored"]


def seasons(spark, start_month=6):
    keys = spark.createDataFrame([("p", 2024, start_month)], "e string, year int, season_start int")
    return B.season_days(keys, "year", "season_start", 1)


def test_exposure_zero_is_not_missing(spark):
    window = {"w": (0, 10)}
    zero = daily(spark, [0.0] * 366)
    got = B.stage_exposure(seasons(spark), zero, ["e"], ["e", "year"], [120], {"rain": ("rain_mm", "sum")}, window).first()
    assert got["rain"] == 0.0 and got["rain_coverage_pct"] == 100.0
    blank = zero.withColumn("rain_mm", F.lit(None).cast("double"))
    got = B.stage_exposure(seasons(spark), blank, ["e"], ["e", "year"], [120], {"rain": ("rain_mm", "sum")}, window).first()
    assert got["rain"] is None and got["rain_coverage_pct"] == 0.0


def test_cells_match_enumeration(spark):
    cells = B.stage_cells(seasons(spark), ["e", "year"], [120], {"w": (-5, 12)}).collect()
    want = {}
    for h in range(30):
        for o in range(-5, 12):
            d = dt.date(2024, 6, 1) + dt.timedelta(days=h - 120 + o)
            want[d] = want.get(d, 0) + 1
    assert {r["day"]: r["weight"] for r in cells} == want and cells[0]["cells"] == 30 * 17


def test_trigger_window_prefers_nearest_and_falls_back(spark):
    one = spark.createDataFrame([("p", 2024, dt.date(2024, 6, 1), dt.date(2024, 6, 1))], "e string, year int, _h0 date, _h1 date")
    nominal = dt.date(2024, 6, 1) - dt.timedelta(days=120)
    trig = [nominal - dt.timedelta(days=45)]
    searched = spark.createDataFrame([("p", 2024, trig)], "e string, year int, triggers array<date>")
    got = B.trigger_windows(one, searched, ["e", "year"], 120).first()
    assert got["bloom_start"] == nominal + dt.timedelta(days=5) and got["trigger_status"] == "all_cohorts"
    none = spark.createDataFrame([("p", 2024, [])], "e string, year int, triggers array<date>")
    got = B.trigger_windows(one, none, ["e", "year"], 120).first()
    assert got["bloom_start"] == nominal and got["trigger_status"] == "not_found"


def test_issue_features_ignore_days_after_the_cutoff(spark):
    days = 366 * 6
    start = dt.date(2019, 1, 1)
    rows = [("p", start + dt.timedelta(days=i), float(i % 17)) for i in range(days)]
    base = spark.createDataFrame(rows, "e string, day date, v double")
    cut = dt.date(2024, 6, 1) - dt.timedelta(days=67)
    changed = base.withColumn("v", F.when(F.col("day") > F.lit(cut), 999.0).otherwise(F.col("v")))
    got = []
    for frame in (base, changed):
        cells = B.issue_cells(seasons(spark), frame, ["e"], ["e", "year"], "year", 120, 60, ["v"], 7, 5, 3)
        got.append(B.issue_features(cells, ["e", "year"], {"x": ("fruit_60_89d", "v", "p90")}).first()["x"])
    assert got[0] is not None and got[0] == got[1]


def test_training_seasons_follow_the_cutoff(spark):
    df = spark.createDataFrame([("p", 2010, 5, 9.0), ("p", 2010, 6, 1.0), ("p", 2011, 9, 99.0)], "e string, y int, m int, t double")
    assert A.training_seasons(df, ["e"], "y", "m", "t", 2010).first()["season_start"] == 4


def test_season_keys(spark):
    for day, want in ((dt.date(2025, 1, 1), (2024, 11)), (dt.date(2025, 12, 31), (2025, 10))):
        y, m = dates.completed_key(F.lit(day))
        assert (scalar(spark, y), scalar(spark, m)) == want
    for key, want in (((2025, 1), ("2024-12-01", "2025-02-28")), ((2025, 12), ("2025-11-01", "2026-01-31"))):
        a, b = dates.season_bounds(F.lit(key[0]), F.lit(key[1]))
        assert (str(scalar(spark, a)), str(scalar(spark, b))) == want


def test_adjusted_age(spark):
    def age(kind, base, heat=0.0, index=0.0):
        return scalar(spark, climate.adjusted_age(F.lit(heat), F.lit(0.0), F.lit(0.0), F.lit(index), F.lit(kind), F.lit(base), F.lit(10)))
    assert age("heat", 120, heat=2.0) == 110 and age("enso", 150, index=-1.0) == 160 and age("fixed", 140, heat=2.0) == 140


def test_thai_dates(spark):
    for text, want in (("8-ม.ค.-62", "2019-01-08"), ("23/03/2020", "2020-03-23"), ("2 กรกฎาคม 2564", "2021-07-02"), ("-", None)):
        got = scalar(spark, dates.thai_date(F.lit(text)))
        assert (str(got) if got else None) == want


def test_regime_needs_five_seasons(spark):
    df = spark.createDataFrame([("i", k, 0.7) for k in range(5)], "f string, n int, x double")
    full = [r["phase"] for r in W.regime_streak(df, ["f"], "n", "x").orderBy("n").collect()]
    assert full == ["not_yet_persistent"] * 4 + ["persistent_warm"]
    assert [r["phase"] for r in W.regime_streak(df.where("n < 4"), ["f"], "n", "x").orderBy("n").collect()] == full[:4]


def test_good_pixels_keep_observed_zero(spark):
    good = 1 << 11
    value = [0, -3000, 5, 5, 5, 5, 5, 5]
    rel = [0, 0, 1, 0, 0, 0, 0, 0]
    qa = [good, good, good, good | 1, good | (3 << 6), good | (1 << 8), 0, 65535]
    cols = [F.array(*[F.lit(v) for v in a]) for a in (value, rel, qa)]
    assert scalar(spark, arrays.good_pixels(*cols)) == [True] + [False] * 7


def test_normals_use_earlier_years_only(spark):
    rows = [("p", dt.date(y, m, d), float(y)) for y in range(2010, 2022) for m, d in ((2, 28), (3, 1))]
    df = spark.createDataFrame(rows, "e string, day date, v double")
    keys = spark.createDataFrame([("p", 2020)], "e string, year int")
    got = {r["mmdd"]: r["v"] for r in A.calendar_normals(df, keys, ["e"], "day", "year", ["v"]).collect()}
    assert got["02-28"] == sum(range(2010, 2020)) / 10 and got["02-29"] == got["02-28"]


def test_ridge_matches_the_closed_form(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3)) * [1, 10, 100] + [0, 50, 1e6]
    y = x @ [1.0, 0.2, 0.03] + rng.normal(size=40)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    got = M.ridge_fit(df, ["a", "b", "c"], "y", [5.0], []).first()
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + 5 * np.eye(3), z.T @ (y - y.mean()))
    assert np.allclose(got["coef"], want, rtol=1e-6) and abs(got["intercept"] - y.mean()) < 1e-6


def test_heldout_target_does_not_move_predictions(spark):
    rows = [(e, y, float(y - 2000 + i), float((y * 7 + i * 3) % 11)) for i, e in enumerate("abc") for y in range(2000, 2008)]
    base = spark.createDataFrame(rows, "e string, y int, t double, x double")
    changed = base.withColumn("t", F.when(F.col("y") == 2007, 1e6).otherwise(F.col("t")))
    configs = [{"config": 0, "model": "median", "kind": "entity_median"}, {"config": 1, "model": "ridge", "kind": "ridge", "alpha": 1.0, "features": ["x"]}]
    got = []
    for frame in (base, changed):
        _, out = M.nested_validate(frame, configs, ["e"], "y", "t", [2007], 2)
        got.append(sorted((r["policy"], r["e"], round(r["predicted"], 6)) for r in out.collect()))
    assert got[0] == got[1] and len(got[0]) == 9


def test_trigger_search_takes_every_year(spark):
    rows = [(1, dt.date(y, 1, 1) + dt.timedelta(days=i), 0.0) for y in (2001, 2002, 2003) for i in range(365)]
    t = SimpleNamespace(daily_full=spark.createDataFrame(rows, "province long, day date, rain_mm double"))
    assert {r["year"] for r in REGISTRY["e11_trigger_search"].build(t).collect()} == {2001, 2002, 2003}


def test_permutation_importance_repeats_as_the_operator_does(spark):
    got = REGISTRY["m18_permutation_importance"](spark, "/root/testdata/sf0.001").collect()
    assert {r["group"] for r in got} == {"yield", "weather"} and {r["repeats"] for r in got} == {5}
