"""Streaming queries. The given readings are replayed as files in time order, the stream runs to its end and
the sink table is the result, so it can be compared with the batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loamline.operators.quality import sensor_state
from loamline.plans.q_windows import GAP, NEAR, RUNS, STALE_MINUTES, signed, ts
from loamline.plans.registry import query
from loamline.session import shared_folder
from loamline.streaming import ops as T

# The replayed files split the month of readings at these times.
CUTS = ["2024-01-09", "2024-01-17", "2024-01-24"]


def folder(t) -> str:
    return f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"


def replay(t, df, at: str, run, closing=()) -> None:
    """Append the rows period by period, oldest first, and let the query process each period: ``run`` gets the
    stream and continues from its own checkpoint, as a scheduled ingest job would."""
    path = folder(t)
    edges = [None, *CUTS, None]
    parts = []
    for low, high in zip(edges, edges[1:]):
        part = df
        if low:
            part = part.where(F.col(at) >= F.lit(low).cast("timestamp_ntz"))
        if high:
            part = part.where(F.col(at) < F.lit(high).cast("timestamp_ntz"))
        parts.append(part)
    for part in [*parts, *[c.select(*df.columns) for c in closing]]:
        part.write.mode("append").parquet(path)
        run(T.read_files(t.spark, path, df.schema, 10_000))


def closing_rows(df, at: str):
    """Two late rows of an unknown device that push the watermark past the data."""
    one = df.limit(1)
    return [one.withColumns({"device_id": F.lit(-1).cast("long"), at: F.lit(d).cast("timestamp_ntz")}) for d in ("2024-03-01", "2024-03-02")]


def finish(t, df, at: str, transform, closing=(), disk_state=False):
    out = folder(t)
    replay(t, df, at, lambda s: T.run_to_end(transform(s), out, out + "-checkpoint", disk_state=disk_state), closing)
    return t.spark.read.parquet(out)


@query("t01_stream_dedupe", "sensor", "select event_id, device_id, soil from sensor")
def _(t):
    rows = t.sensor.select("event_id", "device_id", "soil", F.col("recorded_at").cast("timestamp").alias("at"), F.col("recorded_at"))
    out = finish(t, rows.unionByName(rows), "recorded_at", lambda s: T.stream_dedupe(s, ["event_id"], "at", "2 days"))
    return out.select("event_id", "device_id", "soil")


@query("t02_stream_hourly", "sensor", """
    select device_id, strftime(cast(make_timestamp(cast(ceil(epoch_us(recorded_at) / 3600000000) as bigint) * 3600000000) as timestamp), '%Y-%m-%d %H:%M:%S') as hour,
        round(avg(soil), 6) as soil, cast(count(soil) as bigint) as soil_n from sensor group by all""")
def _(t):
    rows = t.sensor.select("device_id", "recorded_at", "soil")
    out = finish(t, rows, "recorded_at", lambda s: T.stream_hourly(s, ["device_id"], "recorded_at", ["soil"], "1 hour", 1),
                 closing_rows(rows, "recorded_at"))
    return out.where("device_id >= 0").select("device_id", ts("hour").alias("hour"), F.round("soil", 6).alias("soil"), "soil_n")


def delivered(event: str = "event_id"):
    """Time of delivery: every tenth reading comes eight days after it was taken."""
    return F.when(F.col(event) % 10 == 0, F.col("recorded_at") + F.expr("interval 8 days")).otherwise(F.col("recorded_at"))


@query("t03_stream_flatline", "sensor", RUNS.format(gap=NEAR) + """
    select event_id, complete and date_diff('microsecond', run_start, recorded_at) / 6e7 >= 360 as flatline_online, false as late from m
    union all select event_id, null, true from sensor where event_id % 50 = 0""")
def _(t):
    rows = signed(t).select("event_id", "device_id", "recorded_at", "sig1", "sig2").withColumn("delivered", delivered())
    # Some rows come once more after the watermark has passed them.
    out = finish(t, rows, "delivered", lambda s: T.stream_flatline(
        s, ["device_id"], "recorded_at", "event_id", ["sig1", "sig2"], STALE_MINUTES, GAP, "30 days"),
        [*closing_rows(rows, "recorded_at"), rows.where("event_id % 50 = 0")], True)
    return out.where("device_id >= 0").select("event_id", "flatline_online", "late")


@query("t04_stream_episodes", "sensor", """
    with h as (select *, lag(recorded_at) over (partition by device_id order by recorded_at, event_id) as pt from sensor where soil >= 50),
    g as (select *, sum(case when pt is null or recorded_at >= pt + interval 12 hour then 1 else 0 end) over (partition by device_id order by recorded_at, event_id rows unbounded preceding) as ep from h)
    select device_id, strftime(min(recorded_at), '%Y-%m-%d %H:%M:%S') as start_at, strftime(max(recorded_at), '%Y-%m-%d %H:%M:%S') as end_at, cast(count(*) as bigint) as rows, max(soil) as peak_value from g group by device_id, ep""")
def _(t):
    rows = t.sensor.select("device_id", "recorded_at", "soil")
    closing = [r.withColumn("soil", F.lit(60.0)) for r in closing_rows(rows, "recorded_at")]
    out = finish(t, rows, "recorded_at", lambda s: T.stream_episodes(s, ["device_id"], "recorded_at", "soil", 50, "12 hours", "1 hour"), closing)
    return out.where("device_id >= 0").select("device_id", ts("start_at").alias("start_at"), ts("end_at").alias("end_at"), "rows", "peak_value")


@query("t05_stream_upsert", "sensor", """
    select device_id, cast(day(recorded_at) % 4 as bigint) as part, arg_max(soil, struct_pack(t := recorded_at, e := event_id)) as soil from sensor group by all""")
def _(t):
    rows = t.sensor.select("device_id", (F.dayofmonth("recorded_at") % 4).alias("part"), "soil", "recorded_at", "event_id")
    target = folder(t)
    # The table exists before the stream starts: one row carries its schema.
    rows.limit(1).write.partitionBy("part").parquet(target)
    replay(t, rows, "recorded_at", lambda s: T.stream_upsert(
        s, target, target + "-checkpoint", ["device_id", "part"], "part", ["recorded_at", "event_id"]))
    return t.spark.read.parquet(target).select("device_id", F.col("part").cast("long").alias("part"), "soil")


@query("t06_stream_enrich", "vint", """
    with o as (select distinct location, valid - interval 1 hour as origin from vint),
    r as (select o.location, o.origin, v.issued, v.source, max(v.rain_mm) as rain, count(*) as k, count(distinct v.valid) as u from o join vint v on v.location = o.location
        and v.valid > o.origin and v.valid <= o.origin + interval 3 hour and greatest(v.issued, v.received) between o.origin - interval 24 hour and o.origin group by all),
    b as (select *, row_number() over (partition by location, origin order by issued desc, source) as rn from r where k = 3 and u = 3)
    select o.location, strftime(o.origin, '%Y-%m-%d %H:%M:%S') as origin, strftime(b.issued, '%Y-%m-%d %H:%M:%S') as issued, b.source, b.rain as rain_max
    from o left join b on b.location = o.location and b.origin = o.origin and b.rn = 1""")
def _(t):
    origins = t.vint.select("location", (F.col("valid") - F.expr("interval 1 hour")).alias("origin")).distinct()
    path = folder(t)
    origins.repartitionByRange(3, "origin").write.parquet(path)
    stream = T.read_files(t.spark, path, origins.schema)
    out = folder(t)
    T.stream_enrich(stream, t.vint, ["location"], "origin", out, out + "-checkpoint", 3, {"rain_max": F.max("rain_mm")}, ["rain_mm"])
    rows = t.spark.read.parquet(out)
    return rows.select("location", ts("origin").alias("origin"), ts("issued").alias("issued"), "source", "rain_max")


@query("t07_stream_status", "sensor", """
    with r as (select *, row_number() over (partition by device_id order by recorded_at desc, event_id desc) as n, date_diff('microsecond', recorded_at, timestamp '2024-01-31 00:00:00') / 6e7 as minutes from sensor)
    select device_id, event_id, case when minutes < -5 then 'clock_error' when not valid then 'invalid' when age_sec > 3600 or minutes not between 0 and 1440 then 'stale' else 'fresh' end as state from r where n = 1""")
def _(t):
    rows = t.sensor.select("device_id", "event_id", "recorded_at", "soil", "valid", "age_sec")
    base = folder(t)
    replay(t, rows, "recorded_at", lambda s: T.stream_status(s, ["device_id"], "recorded_at", "event_id", base, base + "-checkpoint"))
    out = T.status_table(t.spark, base, ["device_id"])
    state = sensor_state(F.col("soil"), F.col("valid"), F.col("age_sec"), F.lit(False), F.col("recorded_at"),
                         F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), fresh_minutes=1440)
    return out.select("device_id", "event_id", state.alias("state"))


@query("t08_stream_guard", "sensor", """
    with d as (select event_id, recorded_at, recorded_at > timestamp '2024-01-20 00:05:00' as ahead,
        case when event_id % 10 = 0 then recorded_at + interval 8 day else recorded_at end as delivered from sensor),
    p as (select *, (delivered >= timestamp '2024-01-09')::int + (delivered >= timestamp '2024-01-17')::int + (delivered >= timestamp '2024-01-24')::int as part from d),
    m as (select part, max(max(recorded_at) filter (not ahead)) over (order by part rows between unbounded preceding and 1 preceding) as mark from p group by part)
    select event_id, case when ahead then 'rejected' when recorded_at < mark - interval 2 day then 'late' else 'accepted' end as outcome from p join m using (part)""")
def _(t):
    rows = t.sensor.select("event_id", "device_id", "recorded_at", "soil").withColumn("delivered", delivered())
    base = folder(t)
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    replay(t, rows, "delivered", lambda s: T.stream_guard(
        s, "recorded_at", now, 300, base + "/good", base + "/bad", base + "-checkpoint", base + "/late", 2 * 86400))
    parts = [t.spark.read.parquet(f"{base}/{name}").select("event_id", F.lit(outcome).alias("outcome"))
             for name, outcome in (("good", "accepted"), ("bad", "rejected"), ("late", "late"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
