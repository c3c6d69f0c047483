"""Aligned blocks of intervals, radix selection and doubled pointers beside brute force."""

import datetime as dt
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.operators import joins as J
from loamline.operators import ledger as L
from loamline.operators import scan

DAY = dt.date(2020, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def test_blocks_cover_each_day_of_a_span_once(spark):
    rng = random.Random(3)
    spans = [(i, a, a + n) for i, (a, n) in enumerate([(0, 1), (7, 1), (-5, 12), (-1, 2), (8, 8), (3, 0), (5, -4), (-4096, 8192)])]
    spans += [(100 + i, a, a + rng.randint(1, 5000)) for i, a in enumerate(rng.sample(range(-20000, 20000), 60))]
    rows = J.dyadic_blocks(spark.createDataFrame(spans, "i int, a long, b long"), F.col("a"), F.col("b")).collect()
    for i, a, b in spans:
        mine = [(r["_l"], r["_k"]) for r in rows if r.i == i]
        assert sorted(d for lev, k in mine for d in range(k << lev, (k + 1) << lev)) == list(range(a, b))
        assert len(mine) <= 2 * max(1, math.ceil(math.log2(max(b - a, 1))))


def test_interval_exposure_against_days(spark):
    rng = random.Random(4)
    rows = [("p", day(0), day(3652), 2.0), ("p", day(5), day(5), 1e-9), ("p", day(6), day(9), 1e17), ("p", day(6), day(9), float("nan")),
            ("p", day(6), day(9), None), ("p", day(9), day(6), 5.0), ("q", day(-900), day(-890), 4.0), ("q", None, day(3), 1.0)]
    rows += [("q", day(a), day(a + rng.randint(0, 400)), rng.uniform(-5, 5)) for a in rng.sample(range(3000), 200)]
    windows = [("p", "none", day(-30), day(-10)), ("p", "five", day(5), day(6)), ("p", "mixed", day(4), day(12)), ("p", "ten", day(0), day(3653)),
               ("q", "old", day(-1000), day(-800)), ("q", "mid", day(100), day(900)), ("r", "no", day(0), day(2))]
    found = J.interval_exposure(spark.createDataFrame(windows, "e string, w string, a date, b date"),
                                spark.createDataFrame(rows, "e string, s date, t date, v double"), ["e"], ["w"], "a", "b", "v", "s", "t", 5.0)
    got = {r.w: r for r in found.collect()}
    assert len(got) == len(windows)
    for e, w, a, b in windows:
        inside = [(max(0, (min(b, t + dt.timedelta(1)) - max(a, s)).days), v) for k, s, t, v in rows
                  if k == e and s is not None and t >= s and v is not None and v == v]
        days = sum(n for n, _ in inside)
        length = (b - a).days
        assert (got[w].overlap_days, got[w].coverage_pct) == (days, pytest.approx(100 * days / length))
        if 100 * days / length >= 5:
            assert got[w].mean_value == pytest.approx(sum(n * v for n, v in inside) / days, rel=1e-12)
        else:
            assert got[w].mean_value is None
    # A small value beside a large one is not lost on the days that only the small one covers.
    assert got["five"].mean_value == pytest.approx((2.0 + 1e-9) / 2, rel=1e-15)


def test_order_bits_are_those_of_the_double(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 5e-324, 2.0**-1022, math.inf, -math.inf, math.nan, 1.7976931348623157e308, -1.5]
    for e in range(-1074, 1024, 7):
        values += [2.0**e, -(2.0**e), math.nextafter(2.0**e, 0), math.nextafter(2.0**e, math.inf)]
    values += [struct.unpack("d", rng.randbytes(8))[0] for _ in range(2000)]
    df = scan.order_bits(spark.createDataFrame([(v,) for v in values], "v double"), F.col("v"), "bits")
    for r in df.withColumn("back", scan.bits_order(F.col("bits"))).collect():
        if math.isnan(r.v):
            assert r.bits == (2047 << 52) + 1 and math.isnan(r.back)
        else:
            size = struct.unpack("q", struct.pack("d", abs(r.v)))[0]
            assert r.bits == (-size if r.v < 0 else size) and r.back == r.v


def test_quantiles_equal_sorting_for_any_values(spark):
    rng = random.Random(6)
    groups = {"one": [4.25], "same": [7.0] * 50, "two": [1.0, 2.0], "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(301)],
              "close": [1.0 + i * 2.0**-52 for i in range(200)], "ends": [-math.inf, 0.0, -0.0, 3.0, math.inf]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("gone", None)]
    probs = {"low": 0.0, "tenth": 0.1, "mid": 0.5, "p90": 0.9, "high": 1.0}
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in scan.grouped_quantiles(df, ["g"], "v", probs).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g].n == len(values)
        for name, p in probs.items():
            ranked = sorted(values)
            k = math.floor(p * (len(values) - 1))
            part = p * (len(values) - 1) - k
            want = ranked[k] if part == 0 else ranked[k] + part * (ranked[k + 1] - ranked[k])
            assert got[g][name] == want or (math.isnan(got[g][name]) and math.isnan(want)), (g, name)
    counted = df.where("v is not null").groupBy("g", "v").agg(F.count("*").alias("k"))
    again = {r.g: r for r in scan.grouped_quantiles(counted, ["g"], "v", probs, "k").collect()}
    assert {g: str(r) for g, r in again.items()} == {g: str(r) for g, r in got.items()}


def test_one_group_of_all_rows_is_spread_over_tasks(spark):
    df = spark.range(200_000).select(F.lit("x").alias("g"), (F.rand(5) * 1000).alias("v"))
    plain = scan.order_bits(df, F.col("v"), "bits").groupBy("g", "bits").agg(F.count("*").alias("c"))
    parts = plain.repartition(8, "g", "bits").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 2 * 200_000 / 8
    values = np.sort(np.array([r.v for r in df.collect()]))
    found = scan.grouped_quantiles(df, ["g"], "v", {"q": 0.37}).first()
    assert found.q == pytest.approx(np.quantile(values, 0.37), rel=1e-12)


def versions(attempts):
    """Optimistic locking, attempt by attempt."""
    state, out = {}, {}
    first = {}
    for r, seq, expected, owner in sorted(attempts, key=lambda a: (a[0], a[1])):
        if expected == 0 and r not in first:
            first[r] = owner
    for r, seq, expected, owner in sorted(attempts, key=lambda a: (a[0], a[1])):
        if r not in state and expected != 0 or r not in first:
            out[r, seq] = "not_found"
        elif owner != first[r]:
            out[r, seq] = "owner_changed"
        elif state.get(r, 0) == expected:
            state[r], out[r, seq] = expected + 1, "applied"
        else:
            out[r, seq] = "version_conflict"
    return out


def test_versioned_updates_take_log_rounds(spark, monkeypatch):
    rng = random.Random(9)
    attempts, seq = [], 0
    for version in range(1000):  # one long record, with attempts that come too early or too late
        for _ in range(rng.choice([0, 0, 1, 2])):
            attempts.append(("long", seq, max(0, version + rng.choice([-1, 1, 2])) or 1, "a"))
            seq += 1
        attempts.append(("long", seq, version, "a"))
        seq += 1
    for r in range(30):
        for s in range(rng.randint(1, 12)):
            attempts.append((f"r{r}", s, rng.randint(0, 4), rng.choice("aaab")))
    written, cut = [], L.cut_lineage
    monkeypatch.setattr(L, "cut_lineage", lambda df: (lambda out: written.append(out.count()) or out)(cut(df)))
    df = spark.createDataFrame(attempts, "record string, seq long, expected long, owner string")
    got = {(r.record, r.seq): r.status for r in L.apply_versioned(df, "record", "seq", "expected", "owner").collect()}
    assert got == versions(attempts)
    # Two tables a round, and the creates and first pointers before them.
    assert len(written) <= 2 + 2 * 12 and max(written) < len(attempts)


def test_a_long_chain_is_built_as_a_stream(spark):
    hot = spark.range(100_000).select(F.lit("hot").alias("r"), (F.col("id") + 1).alias("seq"), F.concat(F.lit('é"\\\n'), F.col("id") % 9).alias("p"), F.lit(None).cast("int").alias("q"))
    rest = spark.range(40).select(F.concat(F.lit("r"), F.col("id") % 4).alias("r"), (F.floor(F.col("id") / 4) + 1).alias("seq"), F.lit("x").alias("p"), F.lit(3).alias("q"))
    built = L.build_chain(hot.unionByName(rest).withColumn("hash", F.lit("old")), "r", "seq", ["p", "q"]).cache()
    assert built.columns == ["r", "seq", "p", "q", "prev_hash", "hash"] and built.count() == 100_040
    assert L.verify_chain(built, "r", "seq", ["p", "q"], "prev_hash", "hash").where("problem is not null").count() == 0
    broken = built.withColumn("p", F.when((F.col("r") == "hot") & (F.col("seq") == 500), "y").otherwise(F.col("p"))).where("not (r = 'r1' and seq = 5)")
    found = L.verify_chain(broken, "r", "seq", ["p", "q"], "prev_hash", "hash").where("problem is not null").select("r", "seq", "problem").collect()
    assert sorted(map(tuple, found)) == [("hot", 500, "hash"), ("r1", 6, "sequence")]
    assert L.build_chain(rest.where("false"), "r", "seq", ["p"]).count() == 0
    built.unpersist()
