"""Runs read from one slice summary, next to a plain walk over the rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loamline.operators import joins as J
from loamline.operators import windows as W
from loamline.operators.scan import Series, runs

START = datetime(2024, 1, 1)


def walk(rows, max_gap):
    """(run start, run end) of each row of one entity, rows in order."""
    begins = [i == 0 or rows[i][3] is None or rows[i][3] != rows[i - 1][3] or (rows[i][1] - rows[i - 1][1]).total_seconds() > max_gap
              for i in range(len(rows))]
    heads = [i for i, b in enumerate(begins) if b] + [len(rows)]
    return {rows[i][2]: (rows[a][1], rows[b - 1][1]) for a, b in zip(heads, heads[1:]) for i in range(a, b)}


@pytest.fixture(scope="module")
def readings():
    rng, rows = random.Random(5), []
    for device, n in (("hot", 400), ("cold", 40), ("single", 1)):
        at = START
        for i in range(n):
            # Ties in time, gaps that skip whole slices, values that stay for several slices.
            at += timedelta(seconds=rng.choice([0, 5, 20, 20, 30, 400]))
            rows.append((device, at, len(rows), rng.choice([1, 1, 1, 2, None]), rng.uniform(0, 100)))
    return rows


@pytest.mark.parametrize("slice_seconds", [1, 60, 100_000])
def test_runs_do_not_depend_on_slices(spark, readings, slice_seconds):
    s = Series(("d",), "at", ("id",), slice_seconds=slice_seconds)
    df = spark.createDataFrame(readings, "d string, at timestamp, id int, v int, x double")
    out = W.flatline_offline(df, s, ["v"], minutes=0.5, max_gap_s=100)
    assert out.columns == [*df.columns, "run_start", "run_end", "flatline_offline"]
    want = {}
    for device in ("hot", "cold", "single"):
        want.update(walk([r for r in readings if r[0] == device], 100))
    got = {r["id"]: (r["run_start"], r["run_end"]) for r in out.collect()}
    assert got == want
    online = {r["id"]: r["flatline_online"] for r in W.flatline_online(df, s, ["v"], 0.5, 100).collect()}
    assert online == {r[2]: r[3] is not None and (r[1] - want[r[2]][0]).total_seconds() >= 30 for r in readings}


@pytest.mark.parametrize("slice_seconds", [1, 60, 100_000])
def test_first_crossing_and_gap_do_not_depend_on_slices(spark, readings, slice_seconds):
    s = Series(("d",), "at", ("id",), slice_seconds=slice_seconds)
    df = spark.createDataFrame(readings, "d string, at timestamp, id int, v int, x double")
    want = {}
    for i, (device, at, id_, _, x) in enumerate(readings):
        if x < 80:
            continue
        path = [r for r in readings[i:] if r[0] == device]
        hit = next((k for k, r in enumerate(path) if r[4] <= 20), None)
        if hit is None or (path[hit][1] - at).total_seconds() > 900:
            want[id_] = (None, None)
        else:
            want[id_] = (path[hit][1], any((b[1] - a[1]).total_seconds() > 100 for a, b in zip(path[:hit], path[1:hit + 1])))
    follows = W.gap_delta(df, s, "x", 100)
    for rows, gap in ((df, 100), (follows, F.col("gap_minutes") > 100 / 60)):
        out = J.first_after(rows, s, F.col("x") >= 80, F.col("x") <= 20, gap, 900)
        assert {r["id"]: (r["crossed_at"], r["path_has_gap"]) for r in out.collect()} == want


def test_runs_reads_its_input_twice_at_most(spark, readings, tmp_path):
    path = str(tmp_path / "readings")
    spark.createDataFrame(readings, "d string, at timestamp, id int, v int, x double").write.parquet(path)
    df = spark.read.parquet(path)
    s = Series(("d",), "at", ("id",), slice_seconds=60)
    out = W.flatline_offline(df, s, ["v"], minutes=0.5, max_gap_s=100)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") <= 2
    empty = runs(df.where("id < 0"), s, {"at": "_b"}, F.col("_b").isNull())
    assert empty.count() == 0
