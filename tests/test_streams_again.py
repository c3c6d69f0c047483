"""A status stream that is started again with nothing new, an upsert into the null partition, bulletins as rows."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loamline.functions import text as X
from loamline.session import shared_folder
from loamline.sources import sinks as K
from loamline.streaming import ops as T


START = dt.datetime(2024, 1, 1)
READINGS = "d int, ts timestamp, event string, v double"


def readings(spark, minutes, device=1, value=5.0):
    return spark.createDataFrame([(device, START + dt.timedelta(minutes=m), f"e{m:04d}", value) for m in minutes], READINGS)


def test_status_is_kept_in_state_and_survives_a_start_without_new_files(spark, tmp_path):
    def run(rows=None):
        if rows is not None:
            rows.write.mode("append").parquet(str(tmp_path / "in"))
        stream = T.read_files(spark, str(tmp_path / "in"), readings(spark, [0]).schema, 10)
        T.stream_status(stream, ["d"], "ts", "event", str(tmp_path / "out"), str(tmp_path / "check"))
        return {r.d: (r.event, r.v) for r in T.status_table(spark, str(tmp_path / "out"), ["d"]).collect()}

    assert run(readings(spark, []).limit(0)) == {}
    assert run(readings(spark, [10, 30, 20]).unionByName(readings(spark, [5], device=2))) == {1: ("e0030", 5.0), 2: ("e0005", 5.0)}
    assert run() == {1: ("e0030", 5.0), 2: ("e0005", 5.0)}
    # An older row changes nothing; a batch writes only the devices it has rows of.
    assert run(readings(spark, [15], value=9.0)) == {1: ("e0030", 5.0), 2: ("e0005", 5.0)}
    last = spark.read.parquet(str(tmp_path / "out")).orderBy(F.desc("batch")).first().batch
    assert [r.d for r in spark.read.parquet(str(tmp_path / "out")).where(F.col("batch") == last).collect()] == [1]


def test_stuck_sensor_stream_takes_rows_in_any_order_and_sets_late_ones_apart(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)

    def run(minutes=None, value=5.0):
        if minutes:
            readings(spark, minutes, value=value).write.mode("append").parquet(str(tmp_path / "in"))
        stream = T.read_files(spark, str(tmp_path / "in"), readings(spark, [0]).schema, 100)
        out = T.stream_flatline(stream, ["d"], "ts", "event", ["v"], 60, 1800, "40 minutes")
        T.run_to_end(out, str(tmp_path / "out"), str(tmp_path / "check"), disk_state=True)
        return {(r.event, r.late): r.flatline_online for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    # The watermark stands at minute 10, so only the first row is sure to have none before it.
    assert run([0, 20, 10, 50, 40, 30]) == {("e0000", False): False}
    assert run() == {("e0000", False): False}
    got = run([60, 15, 80, 70, 0, 300])
    assert got.pop(("e0000", True)) is None
    assert got == {(f"e{m:04d}", False): m >= 60 for m in (0, 10, 15, 20, 30, 40, 50, 60, 70, 80)}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_stuck_sensors_of_one_bucket_are_judged_as_one_by_one():
    class Cell:
        def __init__(self):
            self.value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    class Rows(Cell):
        def get(self):
            return iter(self.value or [])

        def appendList(self, rows):
            self.value = (self.value or []) + rows

        def put(self, rows):
            self.value = list(rows)

    class Handle:
        timers = set()

        def getListState(self, name, schema):
            return Rows()

        def getValueState(self, name, schema):
            return Cell()

        def registerTimer(self, at):
            self.timers.add(at)

    class Mark:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    rng, handle, expire = random.Random(7), Handle(), 400
    work = T.InOrder("event", 60_000, 50_000, expire)
    work.init(handle)
    got, want, number, mark = [], [], 0, 0
    waiting, runs = {}, {}
    for step in range(60):
        # One call for all devices of the bucket: a row of each of them may come at any time.
        rows = [(1, f"d{rng.randrange(6)}", number + i, 1000 * (step * 60 + rng.randrange(-200, 200)), rng.choice(["a", "a", "a", "a", "b", None]))
                for i in range(0 if step in (30, 31, 32, 33, 34, 35, 36, 37, 38, 39) else 8)]
        number += len(rows)
        if rows:
            frame = pd.DataFrame(rows, columns=["_bucket", "k", "event", "t", "s"])
            for out in work.handleInputRows((1,), iter([frame[:5], frame[5:]]), Mark(mark)):
                got += list(out.itertuples(index=False, name=None))
        for _, device, event, us, sig in rows:
            if us <= (runs[device][2] if device in runs else (mark - expire) * 1000):
                want.append((device, event, None, True))
            else:
                waiting.setdefault(device, []).append((us, event, sig))
        mark = step * 60 - 100
        while handle.timers and min(handle.timers) < mark:
            handle.timers.remove(min(handle.timers))
            for out in work.handleExpiredTimer((1,), Mark(mark), None):
                got += list(out.itertuples(index=False, name=None))
        for device in {*waiting, *runs}:
            ready = sorted(r for r in waiting.get(device, []) if r[0] < mark * 1000)
            waiting[device] = [r for r in waiting.get(device, []) if r[0] >= mark * 1000]
            if not ready and not waiting[device] and device in runs and mark * 1000 - runs[device][2] >= expire * 1000:
                del runs[device]
            for us, event, sig in ready:
                was, start, last = runs.get(device, (None, None, None))
                start = us if sig is None or sig != was or us - last > 50_000 else start
                runs[device] = (sig, start, us)
                want.append((device, event, sig is not None and us - start >= 60_000, False))
    assert not set(got) ^ set(want) and len(got) == len(want) > 300
    assert any(flag for *_, flag, late in got if not late) and any(late for *_, late in got)


def test_stuck_sensor_stream_keeps_keys_of_any_type(spark, tmp_path):
    rows = spark.createDataFrame([(None, START, 1, "x"), (2**60 + 1, START, 2, "x"), (2**60, START + dt.timedelta(microseconds=1), 3, None)],
                                 "d long, ts timestamp, event long, v string").withColumn("at", F.col("ts"))
    closing = rows.limit(1).withColumn("ts", F.col("ts") + F.expr("interval 1 day"))
    for part in (rows, closing):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        stream = T.read_files(spark, str(tmp_path / "in"), rows.schema, 100)
        out = T.stream_flatline(stream, ["d", "at"], "ts", "event", ["v"], 60, 1800, "40 minutes", buckets=1)
        T.run_to_end(out, str(tmp_path / "out"), str(tmp_path / "check"), disk_state=True)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "timestamp", "bigint", "boolean", "boolean"]
    assert sorted((r.event, r.d, r["at"], r.flatline_online, r.late) for r in got.collect()) == [
        (r.event, r.d, r["at"], False, False) for r in rows.orderBy("event").collect()]


def test_guard_sets_future_and_late_rows_apart(spark, tmp_path):
    names = {n: str(tmp_path / n) for n in ("in", "good", "bad", "late", "check")}
    now = F.lit(START + dt.timedelta(minutes=100))
    for minutes in ([0, 90, 104, 105, 106], [20, 44, 45, 95], [105]):
        readings(spark, minutes, value=float(len(minutes))).write.mode("append").parquet(names["in"])
        stream = T.read_files(spark, names["in"], readings(spark, [0]).schema, 10)
        T.stream_guard(stream, "ts", now, 300, names["good"], names["bad"], names["check"], names["late"], 3600)

    def events(name):
        return sorted(r.event for r in spark.read.parquet(names[name]).collect())

    # Newest accepted before the second batch is minute 105, so minute 45 is an hour behind and still accepted.
    assert events("good") == ["e0000", "e0045", "e0090", "e0095", "e0104", "e0105", "e0105"]
    assert events("bad") == ["e0106"] and events("late") == ["e0020", "e0044"]
    nothing = spark.createDataFrame([(1, None)], "d int, ts timestamp")
    good, bad = T.guard(nothing, "ts", now)
    assert good.isEmpty() and bad.count() == 1


def test_upsert_keeps_the_null_partition(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k int, v string, at int, part string"
    spark.createDataFrame([(1, "a", 1, None), (2, "b", 1, "x"), (3, "c", 1, None)], schema).write.partitionBy("part").parquet(path)
    K.upsert_table(spark, path, spark.createDataFrame([(1, "A", 2, None), (4, "d", 2, "x")], schema), ["k", "part"], "part", ["at"])
    got = {(r.k, r.v, r.part) for r in spark.read.schema(schema).parquet(path).collect()}
    assert got == {(1, "A", None), (3, "c", None), (2, "b", "x"), (4, "d", "x")}


def test_bulletin_rows(spark):
    texts = [
        (1, "Overall, conditions were consistent with La Nina, while El Nino was gone. A 60 to 70% chance is given. A 60 to 70% chance is given."),
        (2, "El Niño is expected. It remains ENSO‑neutral now; chances are ~55% or about 80 - 90%. Rain fell by 40%. A probability of 130% or 9-3% is wrong."),
        (3, "Nothing here."), (4, None), (5, "")]
    df = spark.createDataFrame(texts, "id int, text string")
    assert {tuple(r) for r in X.observed_states(df, ["id"], "text").collect()} == {(1, "La Niña"), (2, "ENSO-neutral")}
    got = {r.id: [(m.low, m.high, m.approximate) for m in r.mentions] for r in X.probability_mentions(df, ["id"], "text").collect()}
    assert got == {1: [(60.0, 70.0, False)], 2: [(55.0, 55.0, True), (80.0, 90.0, True)]}


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        conf = Conf({"spark.sql.warehouse.dir": "/here"})

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session)
    Session.conf["spark.checkpoint.dir"] = "hdfs://shared/"
    assert shared_folder(Session) == "hdfs://shared"
