"""Sinks: exclusive create, keyed upsert, manifest check and retention."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.session import shared_folder, written


def write_once(df: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    """Refuses to overwrite."""
    df.write.mode("errorifexists").format(fmt).options(**options).save(path)


def merge_upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Replace rows with the same key, append the rest. Among updates of one key the last by ``order`` wins.

    One aggregation with map-side combine: no key can overload a task.
    """
    columns = target.columns
    both = target.withColumn("_rank", F.lit(0)).unionByName(updates.select(*columns).withColumn("_rank", F.lit(1)))
    rest = [c for c in columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_rank", *order)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*columns)


def upsert_table(spark: SparkSession, path: str, updates: DataFrame, keys: Sequence[str], partition: str,
                 order: Sequence[str] = ()) -> None:
    """Upsert into a partitioned parquet table, rewriting only the partitions the updates touch.

    The merged partitions are staged in the shared folder first, so an interrupted run never leaves a
    half-written partition behind the live data. ``keys`` must include ``partition``.
    """
    if partition not in keys:
        raise ValueError("The partition column must be part of the key")
    # The join prunes partitions at run time; a null partition value matches itself.
    touched = updates.select(F.col(partition).alias("_touched")).distinct()
    current = spark.read.parquet(path)
    current = current.join(touched, F.col(partition).eqNullSafe(F.col("_touched")), "left_semi")
    staged = f"{shared_folder(spark)}/upsert-{uuid.uuid4().hex}"
    merge_upsert(current, updates, keys, order).write.parquet(staged)
    (spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition).parquet(path))


WHOLE, ROUND, PIECE = 64 << 20, 256 << 20, 1 << 20
# Names whose files the text reader would decompress.
COMPRESSED = r"\.(gz|bz2|deflate|snappy|lz4|zst|passthrough)$"
BOM = b"\xef\xbb\xbf"


def _sha256():
    """OpenSSL's SHA-256, the state of which is a plain structure; None where Python is not linked with it."""
    try:
        import _hashlib
        library = ctypes.CDLL(_hashlib.__file__)
        library.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
        library.SHA256_Init.argtypes, library.SHA256_Final.argtypes = [ctypes.c_void_p], [ctypes.c_char_p, ctypes.c_void_p]
        return library
    except (ImportError, OSError, AttributeError):
        return None


class Digest:
    """A SHA-256 that can be handed on as bytes."""

    def __init__(self, state: bytes | None = None):
        self.library, self.context = _sha256(), ctypes.create_string_buffer(state or b"", 256)
        if state is None:
            self.library.SHA256_Init(self.context)

    def update(self, data: bytes) -> Digest:
        self.library.SHA256_Update(self.context, data, len(data))
        return self

    @property
    def state(self) -> bytes:
        return self.context.raw

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self.library.SHA256_Final(out, self.context)
        return out.raw.hex()


PIECES = "path string, name string, size long, round long, start long, place long, n long, data binary"


def _pieces(files: DataFrame, step: int) -> DataFrame:
    """Rows of ``files`` (path, name, size, start of the block, line) as pieces of about a megabyte, each line behind its newline."""

    def rows(key, place, lines):
        data = b"\n" + b"\n".join(lines)
        return pa.RecordBatch.from_pylist([dict(zip(
            ("path", "name", "size", "round", "start", "place", "n", "data"), (*key[:3], key[3] // step, key[3], place, len(data), data)))], schema=schema)

    schema = pa.schema([(c, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for c, t in (x.split() for x in PIECES.split(", "))])

    def run(batches):
        key, place, lines, held = None, 0, [], 0
        for batch in batches:
            paths, starts = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(3).to_numpy()
            cuts = np.flatnonzero(np.r_[True, (paths[1:] != paths[:-1]) | (starts[1:] != starts[:-1])][:len(starts)]).tolist()
            for begin, end in zip(cuts, [*cuts[1:], len(starts)]):
                now = tuple(batch.column(i)[begin].as_py() for i in range(4))
                if lines and (now != key or held > PIECE):
                    yield rows(key, place, lines)
                    place, lines, held = place + 1, [], 0
                if now != key:
                    key, place = now, 0
                more = batch.column(4).slice(begin, end - begin).to_pylist()
                lines += more
                held += sum(map(len, more)) + len(more)
        if lines:
            yield rows(key, place, lines)

    return files.mapInArrow(run, PIECES)


def _long_digests(spark: SparkSession, lines: DataFrame, step: int) -> DataFrame:
    """(name, sha256) of files given as lines. The digest of a file is one chain: in each round one task takes the next blocks
    of a file, of ``step`` bytes together, and hands its state on to the next round."""
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    _pieces(lines, step).write.partitionBy("round").parquet(path)
    pieces = spark.read.schema(PIECES).parquet(path)
    names = ["path", "name", "size", "start", "place", "data"]

    def begin(batches):
        # The reader drops a byte order mark and does not tell whether the last line ends; the size of the file does.
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                lost = r["size"] - r.pop("n")
                if lost not in (-1, 0, 2, 3):
                    raise ValueError(f"{r['path']}: the bytes read do not fit its size")
                out.append(r | {"start": -1, "place": -1, "data": bytes([lost in (0, 3), 0]) + Digest().update(BOM if lost > 0 else b"").state})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    def hash_on(batches):
        key = state = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["path"] != key:
                    if state:
                        yield handed(state, flags, digest)
                    key, state, flags, digest = r["path"], r, list(r["data"][:2]), Digest(r["data"][2:])
                else:
                    digest.update(r["data"] if flags[1] else r["data"][1:])
                    flags[1] = 1
        if state:
            yield handed(state, flags, digest)

    def handed(state, flags, digest):
        return pa.RecordBatch.from_pylist([state | {"data": bytes(flags) + digest.state}], schema=schema)

    schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("start", pa.int64()), ("place", pa.int64()), ("data", pa.binary())])
    types = "path string, name string, size long, start long, place long, data binary"
    states = written(pieces.groupBy("path", "name", "size").agg(F.sum("n").alias("n")).mapInArrow(begin, types))
    for turn in range((pieces.agg(F.max("round")).first()[0] or 0) + 1):
        now = pieces.where(F.col("round") == turn).select(*names).union(states.select(*names))
        states = written(now.repartition("path").sortWithinPartitions("path", "start", "place").mapInArrow(hash_on, types))
    # The pieces are a copy of the files: none of them is read again.
    spark.createDataFrame([], PIECES).write.mode("overwrite").parquet(path)

    def end(batches):
        for batch in batches:
            last = [Digest(x[2:]).update(b"\n" if x[0] else b"").hexdigest() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(last, pa.string())], names=["name", "sha256"])

    return states.select("name", "data").mapInArrow(end, "name string, sha256 string")


def file_digests(spark: SparkSession, folder: str, pattern: str = "*", whole: int = WHOLE, step: int = ROUND) -> DataFrame:
    """(name, sha256) of every file. Files of up to ``whole`` bytes are read whole by a task; longer ones by block, in rounds of
    ``step`` bytes, if Python is linked with OpenSSL and the name is not that of a compressed file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    digest = lambda df: df.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))
    whole = max(whole, len(BOM))
    if not _sha256() or not files.where(F.col("length") > whole).select("path").take(1):
        return digest(files)
    name, size = F.col("_metadata.file_name"), F.col("_metadata.file_size")
    lines = spark.read.option("pathGlobFilter", pattern).option("lineSep", "\n").text(folder).where((size > whole) & ~name.rlike(COMPRESSED)).select(
        F.col("_metadata.file_path").alias("path"), F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("name"), size.alias("size"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("line"))
    return digest(files.where(F.col("length") <= whole)).union(digest(files.where((size > whole) & name.rlike(COMPRESSED)))).union(
        _long_digests(spark, lines, step))


def verify_manifest(spark: SparkSession, folder: str, manifest: DataFrame, pattern: str = "*") -> DataFrame:
    """Files that are missing, changed or not listed. ``manifest`` has (name, sha256)."""
    have = file_digests(spark, folder, pattern).withColumnRenamed("sha256", "_now")
    status = (
        F.when(F.col("_now").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted")
        .when(F.col("_now") != F.col("sha256"), "changed").otherwise("ok"))
    return manifest.join(have, "name", "full_outer").select("name", status.alias("status"))


def retention(df: DataFrame, ts: str, days: int, now) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one-row preview of how many rows stay and go)."""
    cutoff = F.lit(now).cast("timestamp") - F.expr(f"interval {int(days)} days")
    keep = F.col(ts).cast("timestamp") >= cutoff
    preview = df.agg(F.count_if(keep).alias("kept"), F.count_if(~F.coalesce(keep, F.lit(False))).alias("removed"))
    return df.where(keep), preview
