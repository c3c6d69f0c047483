"""Checks, rules, spatial, ledger, source and sink behaviour on small tables."""

import datetime as dt
import decimal
import itertools

import pytest
from pyspark.sql import functions as F

from loamline.operators import aggregates as A
from loamline.operators import joins as J
from loamline.operators import ledger as L
from loamline.operators import quality as Q
from loamline.operators import spatial as S
from loamline.sources import readers as R
from loamline.sources import sinks as K


def test_checked_join_stops_on_a_repeated_key(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (1, "z")], "k int, w string")
    with pytest.raises(Exception, match="Duplicate key"):
        J.checked_join(a, b, ["k"]).collect()
    assert J.checked_join(a, b, ["k"], validate="1:m").count() == 2


def test_strict_number_stops_and_lenient_does_not(spark):
    from loamline.functions import text as X

    df = spark.createDataFrame([("1,200.5",), ("",), ("abc",)], "c string")
    assert [r[0] for r in df.select(X.to_number("c")).collect()] == [None, None, None]
    assert [r[0] for r in df.where("c <> 'abc'").select(X.strict_number("c")).collect()] == [1200.5, None]
    with pytest.raises(Exception, match="Not a finite number"):
        df.select(X.strict_number("c")).collect()


def test_new_year_is_accepted_without_flags(spark):
    items = {"prod": ("prod", "t"), "bear": ("bear", "rai"), "plant": ("plant", "rai"), "yield": ("rep", "kg")}
    values = {"prod": 110.0, "bear": 100.0, "plant": 120.0, "yield": 1100.0}
    rows = [("p", 2025, i, items[i][1], 2568, v) for i, v in values.items()]
    source = spark.createDataFrame(rows, "e string, y int, item string, unit string, crop_year int, data double")
    base = spark.createDataFrame([("p", 2024, 100.0, 100.0, 120.0, 1000.0)], "e string, y int, prod double, bear double, plant double, rep double")
    got = Q.review_update(source, base, items, "e", "y", ("prod", "bear", "plant", "rep")).first()
    assert got["flags"] == [] and got["accepted"]


def test_season_tie_has_no_label(spark):
    d = decimal.Decimal
    rows = [("o", "s", 2024, d("0.1"), d("0.3"), "a", "complete"), ("o", "s", 2025, d("0.2"), d("0.6"), "a", "complete"),
            ("o", "s", 2027, d("9"), d("1"), "b", "complete")]
    df = spark.createDataFrame(rows, "orchard string, season string, harvest_year int, harvested_kg decimal(38,6), bearing_area decimal(38,6), cultivar string, status string")
    got = J.season_pairs(df).collect()
    assert len(got) == 1 and got[0]["increase_label"] is None and got[0]["harvest_year"] == 2025


def test_boundary_is_inside_and_hole_is_not(spark):
    square = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]]
    polys = spark.createDataFrame([("sq", square)], "poly string, rings array<array<struct<x: double, y: double>>>")
    points = spark.createDataFrame([(1, 0.0, 2.0), (2, 2.0, 2.0), (3, 0.5, 0.5), (4, 4.0, 4.0), (5, 5.0, 1.0), (6, 1.0, 2.0)], "id int, lon double, lat double")
    got = sorted(r["id"] for r in S.point_in_polygon_join(points, polys).collect())
    assert got == [1, 3, 4, 6]


def brute_farthest(points, k):
    import math

    def km(a, b):
        p, q = math.radians(a[2]), math.radians(b[2])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(min(1, h)))

    centre = (None, sum(p[1] for p in points) / len(points), sum(p[2] for p in points) / len(points))
    chosen = [min(points, key=lambda p: (km(p, centre), p[0]))]
    while len(chosen) < k:
        far = min(points, key=lambda p: (-min(km(p, c) for c in chosen), p[0]))
        if min(km(far, c) for c in chosen) <= 1e-9:
            break
        chosen.append(far)
    return {p[0] for p in chosen}


def test_farthest_points_match_brute_force(spark):
    points = [(i, 100 + (i * 37 % 101) / 50, 13 + (i * 53 % 97) / 60) for i in range(60)]
    df = spark.createDataFrame([("g", *p) for p in points] + [("one", 900, 1.0, 1.0), ("one", 901, 1.0, 1.0)], "g string, id long, lon double, lat double")
    got = S.farthest_points(df, ["g"], "id", 5).collect()
    assert {r["id"] for r in got if r["g"] == "g"} == brute_farthest(points, 5)
    assert [r["id"] for r in got if r["g"] == "one"] == [900]


def test_merged_clusters_keep_members_and_spacing(spark):
    rows = [(i, 100 + (i * 7 % 40) * 0.02, 13 + (i * 11 % 30) * 0.02) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, lon double, lat double")
    x, y = S.world_pixel(F.col("lon"), F.col("lat"), 9)
    out = S.merge_clusters(S.bin_points(df, x, y, 72), 9, 56)
    placed = [(r["x"], r["y"]) for r in out.select(*[c.alias(n) for c, n in zip(S.world_pixel(F.col("lon"), F.col("lat"), 9), "xy")]).collect()]
    assert out.agg(F.sum("members")).first()[0] == 400
    assert all((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 >= 56**2 - 1e-6 for a, b in itertools.combinations(placed, 2))


def brute_versions(attempts):
    current, owner, status = {}, {}, {}
    for record, seq, expected, who in sorted(attempts, key=lambda a: (a[0], a[1])):
        if record not in current:
            if expected == 0:
                current[record], owner[record] = 1, who
                status[record, seq] = "applied"
            else:
                status[record, seq] = "not_found"
        elif who != owner[record]:
            status[record, seq] = "owner_changed"
        elif expected == current[record]:
            current[record] += 1
            status[record, seq] = "applied"
        else:
            status[record, seq] = "version_conflict"
    return status


def test_versioned_updates_match_a_sequential_run(spark):
    attempts = [(r, s, (s * (r + 3) // 4 + s % 3) % (s + 1) if s else r % 2, "a" if (r + s) % 6 else "b") for r in range(12) for s in range(25)]
    df = spark.createDataFrame(attempts, "record int, seq int, expected int, owner string")
    got = {(r["record"], r["seq"]): r["status"] for r in L.apply_versioned(df, "record", "seq", "expected", "owner").collect()}
    assert got == brute_versions(attempts)


def test_chain_reports_each_kind(spark):
    import hashlib
    import json

    rows, before = [], L.GENESIS
    for i in range(1, 6):
        digest = hashlib.sha256(json.dumps([f"p{i}", before], separators=(",", ":")).encode()).hexdigest()
        rows.append(["x", i, f"p{i}", before, digest])
        before = digest
    rows[1][2] = "changed"
    rows[4][3] = "f" * 64
    df = spark.createDataFrame([tuple(r) for r in rows if r[1] != 3], "ledger string, seq long, payload string, prev string, hash string")
    got = {r["seq"]: r["problem"] for r in L.verify_chain(df, "ledger", "seq", ["payload"], "prev", "hash").collect()}
    assert got == {1: None, 2: "hash", 4: "sequence", 5: "link"}


def test_digest_ignores_order_but_not_content(spark):
    a = spark.createDataFrame([("g", i, float(i)) for i in range(10)], "g string, i int, v double")
    b = a.orderBy(F.desc("i"))
    c = a.withColumn("v", F.when(F.col("i") == 3, 3.5).otherwise(F.col("v")))
    digest = [A.digest_group(d, ["g"], ["i", "v"]).first()["digest"] for d in (a, b, c, a.unionByName(a))]
    assert digest[0] == digest[1] and len(set(digest)) == 3


def test_missing_columns_fail_the_export_contract(spark):
    df = spark.createDataFrame([("A", dt.date(2024, 1, 1))], "area string, day date")
    got = Q.export_contract(df, ["area", "day", "source"], "area", ["A"], "day", "2024-01-01", "2024-01-31", 10).first()
    assert got["missing_columns"] == "source" and not got["accepted"]


def test_payload_numbers_must_be_json_numbers(spark):
    df = spark.createDataFrame([('{"device_id":"d","recorded_at":"2024-01-01T00:00:00Z","soil":"5","t":5,"b":true}',)], "p string")
    got = R.flatten_payload(df, "p", {"soil": "$.soil", "t": "$.t", "b": "$.b", "none": "$.none"}).first()
    assert got["event_id"] == "d:2024-01-01T00:00:00Z" and (got["soil"], got["t"], got["b"], got["none"]) == (None, 5.0, None, None)


def test_index_problems(spark):
    lines = [" SEAS YR ANOM", "DJF 2020 0.5", "FMA 2020 0.4", "MAM 2020 x"]
    df = spark.createDataFrame([("f", i, line) for i, line in enumerate(lines)], "f string, n int, line string")
    assert [r["problem"] for r in R.parse_index(df, "f", "n", "line").orderBy("n").collect()] == [None, "sequence", "value"]


def test_scan_range_is_capped_newest_first(spark):
    df = spark.createDataFrame([("d", i, dt.datetime(2024, 1, 1, i)) for i in range(10)], "device_id string, event_id long, recorded_at timestamp")
    got = R.scan_range(df.unionByName(df), "d", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), 3).orderBy("event_id").collect()
    assert [r["event_id"] for r in got] == [7, 8, 9] and all(r["truncated"] for r in got)


def test_write_once_and_upsert(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "b", 1)], "k int, part string, v int")
    K.write_once(df, str(tmp_path / "once"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        K.write_once(df, str(tmp_path / "once"))
    target = str(tmp_path / "t")
    df.write.partitionBy("part").parquet(target)
    K.upsert_table(spark, target, spark.createDataFrame([(2, "a", 9), (7, "a", 5)], "k int, part string, v int"), ["k", "part"], "part")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(target).collect()) == [(1, 1), (2, 9), (3, 1), (7, 5)]


def test_manifest_lists_missing_and_changed(spark, tmp_path):
    for name, text in (("a.txt", "1"), ("b.txt", "2"), ("c.txt", "3")):
        (tmp_path / name).write_text(text)
    manifest = K.file_digests(spark, str(tmp_path)).where("name <> 'c.txt'").withColumn(
        "sha256", F.when(F.col("name") == "b.txt", "0").otherwise(F.col("sha256")))
    extra = spark.createDataFrame([("d.txt", "1")], "name string, sha256 string")
    got = {r["name"]: r["status"] for r in K.verify_manifest(spark, str(tmp_path), manifest.unionByName(extra)).collect()}
    assert got == {"a.txt": "ok", "b.txt": "changed", "c.txt": "unlisted", "d.txt": "missing"}


def test_digests_of_long_files_are_handed_on_by_block(spark, tmp_path):
    import hashlib
    import random

    noise = random.Random(3).randbytes(3_000_000)
    cases = {"a b+%20.bin": noise, "newline.bin": noise + b"\n", "mark.bin": b"\xef\xbb\xbf" + noise, "both.bin": b"\xef\xbb\xbf\n\r\n" + noise + b"\n\n",
             "crlf.txt": b"one\r\ntwo\rthree\n" * 50000, "one line": b"x" * 700000, "data.gz": noise[:1000000], "short.bin": b"s"}
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        got = sorted(map(tuple, K.file_digests(spark, str(tmp_path), whole=1000, step=400000).collect()))
        lines = spark.read.option("lineSep", "\n").text(str(tmp_path / "newline.bin")).select(
            F.lit("p").alias("path"), F.lit("p").alias("name"), F.lit(1).cast("long").alias("size"), F.col("_metadata.file_block_start").alias("start"),
            F.col("value").cast("binary").alias("line"))
        longest = K._pieces(lines, 400000).groupBy("round").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [(name, hashlib.sha256(data).hexdigest()) for name, data in cases.items()]
    assert {x for x, _ in got} == set(cases)
    assert got == sorted(want) and longest < 420000
    assert got == sorted(map(tuple, K.file_digests(spark, str(tmp_path)).collect()))


def test_grid_rows_and_registry_have_unique_names():
    from __spark_entry__ import oracle_sql, queries

    names = queries()
    assert set(oracle_sql()) <= set(names) and len(names) > 200
