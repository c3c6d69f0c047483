"""Runs, hourly means and vintages on hand-made readings."""

import datetime as dt

from pyspark.sql import functions as F

from loamline.operators import aggregates as A
from loamline.operators import joins as J
from loamline.operators import windows as W
from loamline.operators.scan import Series, balanced, grouped_quantiles, previous, running_count

START = dt.datetime(2026, 1, 1)
S = Series(("device",), "at", ("event",), slice_seconds=3600)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def readings(spark, n=20, step=15):
    return spark.createDataFrame([("d", i, at(i * step), 1.0, 30.0) for i in range(n)],
                                 "device string, event long, at timestamp, sig double, soil double")


def by_event(df, column):
    return [r[column] for r in df.orderBy("event").select("event", column).collect()]


def test_online_flags_after_an_hour_and_never_revises(spark):
    flags = by_event(W.flatline_online(readings(spark), S, ["sig"]), "flatline_online")
    assert flags == [i >= 4 for i in range(20)]
    assert by_event(W.flatline_online(readings(spark, 4), S, ["sig"]), "flatline_online") == flags[:4]


def test_offline_masks_whole_run_and_contains_online(spark):
    rows = readings(spark)
    offline = by_event(W.flatline_offline(rows, S, ["sig"]), "flatline_offline")
    assert all(offline)
    assert not any(by_event(W.flatline_offline(readings(spark, 4), S, ["sig"]), "flatline_offline"))


def test_null_signature_breaks_the_run(spark):
    rows = readings(spark).withColumn("sig", F.when(F.col("event") != 3, F.col("sig")))
    flags = by_event(W.stale_runs(rows, S, ["sig"], 60), "stale")
    assert flags == [False] * 8 + [True] * 12


def test_slices_do_not_change_results(spark):
    rows = readings(spark, 50, 7).withColumn("sig", F.floor(F.col("event") / 13).cast("double"))
    results = []
    for series in (Series(("device",), "at", ("event",), slice_seconds=10**9), S, balanced(rows, S, 7)):
        out = W.flatline_online(rows, series, ["sig"], 30, 600)
        results.append((by_event(out, "flatline_online"), by_event(running_count(rows, series, F.col("event") % 3 == 0, "n"), "n"),
                        by_event(previous(rows, series, {"soil": "p"}), "p")))
    assert results[0] == results[1] == results[2]


def test_daily_mean_weights_hours(spark):
    rows = [("d", i, at(i), 20.0) for i in range(10)] + [("d", 10, at(60), 80.0)]
    df = spark.createDataFrame(rows, "device string, event long, at timestamp, soil double")
    out = A.history_rollup(df, ["device"], "at", "event", ["soil"]).collect()
    assert len(out) == 1 and out[0]["soil_mean"] == 50.0 and out[0]["raw_count"] == 11


def test_hour_is_closed_on_the_right(spark):
    df = spark.createDataFrame([("d", at(0), 1.0), ("d", at(60), 3.0)], "device string, at timestamp, v double")
    out = {r["hour"]: r["v"] for r in A.hourly_mean(df, ["device"], "at", ["v"], 1).collect()}
    assert out == {at(0): 1.0, at(60): 3.0}


def test_full_path_target(spark):
    rows = [("d", at(60 * h), None if h == 3 else float(h)) for h in range(12)]
    df = spark.createDataFrame(rows, "device string, hour timestamp, soil double")
    out = {r["hour"]: r["t"] for r in W.lead_target_full(df, ["device"], "hour", "soil", 6, "t").collect()}
    assert out[at(0)] is None and out[at(60 * 4)] == 10.0


def vintage(spark, rows):
    return spark.createDataFrame(rows, "loc string, issued timestamp, received timestamp, source string, valid timestamp, rain double")


def test_vintage_takes_the_batch_known_at_the_origin(spark):
    origin = at(600)
    early = [("x", at(540), at(540), "a", origin + dt.timedelta(hours=h), 2.0) for h in range(1, 7)]
    late = [("x", at(601), at(601), "b", origin + dt.timedelta(hours=h), 99.0) for h in range(1, 7)]
    origins = spark.createDataFrame([("x", origin)], "loc string, origin timestamp")
    got = J.vintage_asof(origins, vintage(spark, early + late), ["loc"], "origin", measures={"rain_max": F.max("rain")}).collect()
    assert got[0]["rain_max"] == 2.0
    mixed = early[:3] + [(*r[:3], "b", *r[4:]) for r in early[3:]]
    got = J.vintage_asof(origins, vintage(spark, mixed), ["loc"], "origin", measures={"rain_max": F.max("rain")}).collect()
    assert got[0]["rain_max"] is None


def test_asof_boundary_and_ambiguity(spark):
    left = spark.createDataFrame([(1, at(10)), (2, at(25)), (3, at(-5))], "id int, at timestamp")
    docs = spark.createDataFrame([(at(0), "p"), (at(10), "q"), (at(20), "r"), (at(20), "s")], "pub timestamp, state string")
    strict = {r["id"]: (r["asof_status"], r["asof_state"]) for r in J.asof_join(left, docs, [], "at", "pub", 3600, True, ["state"]).collect()}
    assert strict == {1: ("ok", "p"), 2: ("ambiguous", None), 3: ("none", None)}
    loose = {r["id"]: r["asof_state"] for r in J.asof_join(left, docs, [], "at", "pub", 3600, False, ["state"]).collect()}
    assert loose[1] == "q"
    stale = {r["id"]: r["asof_status"] for r in J.asof_join(left, docs, [], "at", "pub", 60, True, ["state"]).collect()}
    assert stale[1] == "stale"


def test_exact_quantiles_match_percentile_on_skewed_groups(spark):
    rows = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        (F.pow(F.col("id") * 7919 % 10007, F.lit(2)) / 13).alias("v"))
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.9, "e": 1.0}
    # A coarse sketch forces the bracket to do its work.
    got = {r["k"]: r for r in grouped_quantiles(rows, ["k"], "v", probs).collect()}
    want = rows.groupBy("k").agg(*[F.percentile("v", p).alias(n) for n, p in probs.items()]).collect()
    for r in want:
        for n in probs:
            assert abs(got[r["k"]][n] - r[n]) < 1e-6
    one = grouped_quantiles(rows, [], "v", {"m": 0.5}).collect()[0]
    assert one["n"] == 20000


def test_first_after_sees_gap_and_limit(spark):
    values = [(0, 60.0), (15, 45.0), (75, 38.0), (90, 70.0)]
    df = spark.createDataFrame([("d", i, at(m), v) for i, (m, v) in enumerate(values)], "device string, event long, at timestamp, soil double")
    gaps = W.gap_delta(df, S, "soil", 1800)
    out = J.first_after(gaps, S, F.col("soil") >= 50, F.col("soil") <= 40, F.coalesce(F.col("gap_minutes") > 30, F.lit(False)), 48 * 3600)
    got = {r["event"]: (r["hours_to_crossing"], r["path_has_gap"]) for r in out.collect()}
    assert got == {0: (1.25, True), 3: (None, None)}
