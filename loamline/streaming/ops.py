"""Structured Streaming forms of the ingest operators.

Transformations take and return streaming frames. Sinks write every micro-batch to its own folder, named by
the batch id and overwritten on retry, so a restarted query neither loses nor repeats a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, BooleanType, StringType, StructField, StructType

from loamline.operators.joins import elapsed, vintage_asof
from loamline.sources.sinks import upsert_table


DISK_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def read_files(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_dedupe(stream: DataFrame, key: Sequence[str], ts: str, delay: str) -> DataFrame:
    """Replay-safe ingest: a repeated key within the delay is dropped; state older than that is released."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(key))


def stream_hourly(stream: DataFrame, by: Sequence[str], ts: str, values: Sequence[str], delay: str, min_n: int = 3) -> DataFrame:
    """Right-closed hourly means (see ``hourly_mean``), emitted once the watermark has passed the hour."""
    shifted = stream.withColumn("_t", F.timestamp_micros(F.unix_micros(F.col(ts).cast("timestamp")) - 1)).withWatermark("_t", delay)
    out = shifted.groupBy(*by, F.window("_t", "1 hour")).agg(
        *[F.when(F.count(c) >= min_n, F.avg(c)).alias(c) for c in values], *[F.count(c).alias(f"{c}_n") for c in values])
    return out.select(*by, F.col("window.end").alias("hour"), *values, *[f"{c}_n" for c in values])


def _pack(frame: pd.DataFrame) -> bytes:
    table, sink = pa.Table.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


class InOrder(StatefulProcessor):
    """Holds the rows of a bucket of devices until the watermark has passed them, then judges those of each device in order of
    (time, event), all devices of the bucket at once.

    State: waiting rows, as one Arrow table per arrival; signature and start of the run and time of the last judged row per
    device, as one Arrow table. A row at or before that time comes too late to be judged in order and leaves at once with no
    flag. Where the state of a silent device was dropped, its last row was ``expire_ms`` behind the watermark, so that is
    the limit then.
    """

    def __init__(self, event: str, limit: int, gap: int, expire_ms: int):
        self.event, self.limit, self.gap, self.expire_ms = event, limit, gap, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", StructType([StructField("rows", BinaryType())]))
        self.runs = handle.getValueState("runs", StructType([StructField("rows", BinaryType())]))

    def _runs(self) -> pd.DataFrame:
        if self.runs.exists():
            return _unpack(self.runs.get()[0])
        return pd.DataFrame({"device": pd.Series(dtype=object), "sig": pd.Series(dtype=object),
                             "start": pd.Series(dtype="int64"), "last": pd.Series(dtype="int64")})

    def _frame(self, rows: pd.DataFrame, flags: list, late: bool) -> pd.DataFrame:
        return pd.DataFrame({"_device": rows["device"].to_numpy(object), self.event: rows["event"].tolist(),
                             "flatline_online": pd.Series(flags, dtype=object), "late": late})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs = self._runs()
        # The last place stands for devices without state.
        judged = np.append(runs["last"].to_numpy("int64"), (timerValues.getCurrentWatermarkInMs() - self.expire_ms) * 1000)
        known, first = pd.Index(runs["device"]), None
        for batch in rows:
            # Spark renames columns that are no Python names, so they are taken by their place.
            batch = batch.iloc[:, 1:].set_axis(["device", "event", "us", "sig"], axis=1)
            passed = batch["us"].to_numpy("int64") <= judged[known.get_indexer(batch["device"])]
            if passed.any():
                yield self._frame(batch[passed], [None] * int(passed.sum()), True)
            if not passed.all():
                keep = batch[~passed]
                first = min(int(keep["us"].min()), first if first is not None else 2**62)
                self.waiting.appendList([(_pack(keep),)])
        if first is not None:
            # The next full millisecond, so that the watermark has passed the row when the timer fires.
            self.handle.registerTimer(first // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, runs = timerValues.getCurrentWatermarkInMs() * 1000, self._runs()
        parts = [_unpack(row[0]) for row in self.waiting.get()]
        held = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"device": [], "us": []})
        passed = held["us"] < mark
        ready, rest = held[passed], held[~passed]
        # The state of a device goes once it has been silent long enough; one that is judged now begins its silence now.
        waits, judged = runs["device"].isin(rest["device"]), runs["device"].isin(ready["device"])
        fresh = runs[judged | waits | (mark - runs["last"] < self.expire_ms * 1000)]
        if len(ready):
            ready = ready.sort_values(["device", "us", "event"])
            flags, ends = self._judge(ready, runs)
            fresh = pd.concat([fresh[~fresh["device"].isin(ends["device"])], ends], ignore_index=True) if len(fresh) else ends
            if len(rest):
                self.waiting.put([(_pack(rest),)])
            else:
                self.waiting.clear()
            yield self._frame(ready, flags.tolist(), False)
        if len(rest):
            self.handle.registerTimer(int(rest["us"].min()) // 1000 + 1)
        if len(fresh):
            if len(ready) or len(fresh) < len(runs):
                self.runs.update((_pack(fresh),))
            silent = fresh["last"][~fresh["device"].isin(rest["device"])]
            if len(silent):
                self.handle.registerTimer(int(silent.min()) // 1000 + 1 + self.expire_ms)
        elif len(runs):
            self.runs.clear()

    def _judge(self, ready: pd.DataFrame, runs: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame]:
        """Flags of ``ready``, sorted by device, time and event, and the state of its devices after it."""
        device, us, sig = ready["device"].to_numpy(object), ready["us"].to_numpy("int64"), ready["sig"].to_numpy(object)
        none = ready["sig"].isna().to_numpy()
        opens = np.append(True, device[1:] != device[:-1])
        at = pd.Index(runs["device"]).get_indexer(device)
        before = {c: np.append(runs[c].to_numpy(kind), empty)[at] for c, kind, empty in (("sig", object, None), ("start", "int64", 0), ("last", "int64", 0))}
        was = np.where(opens, before["sig"], np.append(None, sig[:-1]))
        last = np.where(opens, before["last"], np.append(0, us[:-1]))
        breaks = none | (sig != was) | (us - last > self.gap) | (opens & (at < 0))
        row = np.arange(len(us))
        start = np.where(breaks, us, before["start"])[np.maximum.accumulate(np.where(breaks | opens, row, 0))]
        ends = np.append(opens[1:], True)
        state = pd.DataFrame({"device": device[ends], "sig": np.where(none, None, sig)[ends], "start": start[ends], "last": us[ends]})
        return ~none & (us - start >= self.limit), state

    def close(self) -> None:
        pass


# Keys as text and back, with every digit of a time.
KEY_TEXT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def stream_flatline(stream: DataFrame, by: Sequence[str], ts: str, event: str, signature: Sequence[str], minutes: float = 60,
                    max_gap_s: float = 1800, delay: str = "1 hour", expire_s: int = 7 * 86400, buckets: int = 1024) -> DataFrame:
    """Online stuck-sensor flag with state per device, in event time: rows may come in any order within ``delay``.

    A row is judged when the watermark has passed it, after all rows before it. A row that comes after later rows of its device
    have been judged has ``late`` set and no flag. State of a silent device is dropped ``expire_s`` of event time later.
    Devices are dealt to ``buckets``, each with one state and one Python call a micro-batch. A task holds the rows that the devices
    of one bucket sent within the delay and one micro-batch. Rows without a time are dropped.
    """
    known = F.lit(True)
    for c in signature:
        known = known & F.col(c).isNotNull()
    text = F.when(known, F.to_json(F.struct(*signature)))
    marked = stream.withColumn("_t", F.col(ts).cast("timestamp")).where("_t is not null").withWatermark("_t", delay)
    # The marked column itself is left out, or Spark would drop late rows before the operator can set them apart.
    device = F.struct(*by)
    rows = marked.select(
        F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int").alias("_bucket"), F.to_json(device, KEY_TEXT).alias("_device"), event,
        F.unix_micros("_t").alias("_us"), text.alias("_sig"))
    schema = StructType([StructField("_device", StringType()), StructField(event, rows.schema[event].dataType),
                         StructField("flatline_online", BooleanType()), StructField("late", BooleanType())])
    work = InOrder(event, int(minutes * 60_000_000), int(max_gap_s * 1_000_000), expire_s * 1000)
    judged = rows.groupBy("_bucket").transformWithStateInPandas(work, schema, "append", "EventTime")
    key = F.from_json("_device", marked.select(device.alias("_d")).schema["_d"].dataType, KEY_TEXT)
    return judged.select(*[key.getField(c).alias(c) for c in by], event, "flatline_online", "late")


def stream_episodes(stream: DataFrame, by: Sequence[str], ts: str, value: str, threshold: float, gap: str, delay: str) -> DataFrame:
    """Gap-delimited episodes of high readings: start, end, rows and peak."""
    high = stream.where(F.col(value) >= threshold).withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", delay)
    out = high.groupBy(*by, F.session_window("_t", gap)).agg(
        F.min("_t").alias("start_at"), F.max("_t").alias("end_at"), F.count("*").alias("rows"), F.max(value).alias("peak_value"))
    return out.drop("session_window")


def guard(df: DataFrame, ts: str, now: Column, tolerance_s: float = 300) -> tuple[DataFrame, DataFrame]:
    """(rows not too far in the future, rejected rows). A row without a time is rejected. Works on batch and streaming frames."""
    ahead = F.coalesce(elapsed(ts, now) > tolerance_s, F.lit(True))
    return df.where(~ahead), df.where(ahead)


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append",
               each: Callable[[DataFrame, int], None] | None = None, disk_state: bool = False) -> None:
    """Process all available input in micro-batches, then stop. ``disk_state`` keeps state on the executors' disks, which lists
    and timers (``stream_flatline``) need."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    conf = stream.sparkSession.conf
    # A query keeps the settings it started with, so the session's own are put back.
    before = {name: conf.get(name, None) for name in (DISK_STATE if disk_state else {})}
    for name in before:
        conf.set(name, DISK_STATE[name])
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(
            availableNow=True).foreachBatch(each or write).start()
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)
    query.awaitTermination()


def stream_upsert(stream: DataFrame, target: str, checkpoint: str, keys: Sequence[str], partition: str, order: Sequence[str]) -> None:
    """Keyed upsert of every micro-batch; the last write wins, and replaying a batch changes nothing."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            upsert_table(batch.sparkSession, target, batch, keys, partition, order)

    run_to_end(stream, target, checkpoint, each=apply)


def stream_guard(stream: DataFrame, ts: str, now: Column, tolerance_s: float, accepted: str, rejected: str, checkpoint: str,
                 late: str | None = None, delay_s: float = 0) -> None:
    """Accepted rows to one table, future rows to a side table. With ``late``, rows more than ``delay_s`` behind the newest
    row accepted in earlier batches go to a third table. The newest time is kept by batch id, so a retried batch meets the same one."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        good, bad = guard(batch, ts, now, tolerance_s)
        bad.write.mode("overwrite").parquet(f"{rejected}/batch={batch_id}")
        if late is not None:
            newest = good.agg(F.max(ts).alias("_newest"))
            if batch_id > 0:
                mark = spark.read.parquet(f"{checkpoint}-newest/batch={batch_id - 1}")
                newest = newest.unionByName(mark).agg(F.max("_newest").alias("_newest"))
                good = good.crossJoin(F.broadcast(mark))
                behind = F.coalesce(elapsed("_newest", F.col(ts)) > delay_s, F.lit(False))
                good.where(behind).drop("_newest").write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
                good = good.where(~behind).drop("_newest")
            else:
                good.limit(0).write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
            newest.write.mode("overwrite").parquet(f"{checkpoint}-newest/batch={batch_id}")
        good.write.mode("overwrite").parquet(f"{accepted}/batch={batch_id}")

    run_to_end(stream, accepted, checkpoint, each=apply)


def stream_enrich(stream: DataFrame, vintages: DataFrame, by: Sequence[str], origin: str, path: str, checkpoint: str, horizon: int,
                  measures: Mapping[str, Column], required: Sequence[str]) -> None:
    """Join each micro-batch with the forecast known at its origins; only vintages near the batch are read."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        span = batch.agg(F.min(origin).alias("a"), F.max(origin).alias("b")).first()
        if span["a"] is None:
            return
        near = vintages.where(F.col("valid").between(span["a"], F.lit(span["b"]) + F.expr(f"interval {horizon} hours")))
        out = vintage_asof(batch, near, by, origin, horizon, 24, measures, required)
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    run_to_end(stream, path, checkpoint, each=apply)


def stream_status(stream: DataFrame, by: Sequence[str], ts: str, event: str, folder: str, checkpoint: str) -> None:
    """Latest row per device, kept in the state of the stream. A batch writes only the devices it has rows of; ``status_table``
    reads the newest row of each. The stream must not hold a column named batch."""
    rest = [c for c in stream.columns if c not in by]
    best = stream.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(ts, event)).alias("_row"))
    newest = best.select(*by, *[F.col("_row")[c].alias(c) for c in rest])
    # An empty first part, so that the table can be read before there are rows.
    stream.sparkSession.createDataFrame([], newest.schema).write.mode("ignore").parquet(f"{folder}/batch=-1")
    run_to_end(newest, folder, checkpoint, "update")


def status_table(spark: SparkSession, folder: str, by: Sequence[str]) -> DataFrame:
    """Status of every device after the last finished batch of ``stream_status``."""
    parts = spark.read.parquet(folder)
    rest = [c for c in parts.columns if c not in (*by, "batch")]
    best = parts.groupBy(*by).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
    return best.select(*by, *[F.col("_row")[c].alias(c) for c in rest])
