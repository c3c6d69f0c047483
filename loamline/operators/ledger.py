"""Change logs and hash chains as tables. Links are equality joins on (record, number), never a window over
all versions of a record."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loamline.operators.quality import validate_rules
from loamline.session import cut_lineage


def apply_versioned(attempts: DataFrame, record: str, order: str, expected: str, owner: str) -> DataFrame:
    """Accept or reject every write attempt under optimistic locking.

    An attempt is applied when ``expected`` equals the record's current version; a create expects 0. The
    owner of the create may not change. Adds ``status``: applied, version_conflict, owner_changed, not_found.

    The attempt accepted for version k is the first one expecting k after the attempt accepted for k - 1, so each attempt
    points to one successor, and the accepted ones are the chain that starts at the create. Pointers are doubled: after
    round i the first 2**i links of every chain are known, so the rounds grow with the logarithm of the longest chain.
    A round writes the links it has found and the pointers of records whose chain goes on, of attempts that another
    one points to.
    """
    creates = attempts.where(F.col(expected) == 0).groupBy(record).agg(
        F.min_by(owner, order).alias("_owner"), F.min(order).alias("_created"))
    known = attempts.join(creates, record, "left")
    mine = known.where(F.col(owner).eqNullSafe(F.col("_owner")) & F.col("_owner").isNotNull())
    numbers = mine.groupBy(record, F.col(expected).cast("long").alias("_k"), F.col(order).alias("_at")).agg(F.lit(1).alias("_one")).drop("_one")
    pointers = _successors(numbers, record)
    reached = [cut_lineage(creates.select(record, F.lit(0).cast("long").alias("_k"), F.col("_created").alias("_at")))]
    aimed = pointers.select(record, (F.col("_k") + 1).alias("_k"), F.col("_to").alias("_at")).distinct()
    pointers = cut_lineage(pointers.join(aimed.unionByName(reached[0]), [record, "_k", "_at"], "left_semi"))
    step = 1
    while not pointers.isEmpty():
        here = reduce(DataFrame.unionByName, reached)
        ahead = pointers.withColumn("_next", F.col("_k") + step)
        reached.append(cut_lineage(here.join(ahead, [record, "_k", "_at"]).select(record, F.col("_next").alias("_k"), F.col("_to").alias("_at"))))
        beyond = pointers.select(record, F.col("_k").alias("_next"), F.col("_at").alias("_to"), F.col("_to").alias("_further"))
        double = ahead.join(beyond, [record, "_next", "_to"]).select(record, "_k", "_at", F.col("_further").alias("_to"))
        going = double.join(reached[0], [record, "_k", "_at"], "left_semi").select(record).distinct()
        pointers = cut_lineage(double.join(going, record, "left_semi"))
        step *= 2
    accepted = reduce(DataFrame.unionByName, reached)
    hits = accepted.select(record, F.col("_k").alias(expected), F.col("_at").alias(order), F.lit(True).alias("_applied"))
    out = known.join(hits, [record, expected, order], "left")
    status = (
        F.when(F.col("_owner").isNull() | (F.col(order) < F.col("_created")), "not_found")
        .when(~F.col(owner).eqNullSafe(F.col("_owner")), "owner_changed").when(F.col("_applied"), "applied").otherwise("version_conflict"))
    return out.withColumn("status", status).select(*attempts.columns, "status")


def _successors(numbers: DataFrame, record: str) -> DataFrame:
    """(record, _k, _at, _to): the time of the first attempt that expects _k + 1 after this one. Attempts of one record that
    expect one version are walked backwards in time, with those that ask for a successor in front of equal times."""
    ask = numbers.select(record, (F.col("_k") + 1).alias("_k"), "_at", F.lit(0).alias("_side"))
    both = ask.unionByName(numbers.select(record, "_k", "_at", F.lit(1).alias("_side")))
    later = Window.partitionBy(record, "_k").orderBy(F.desc("_at"), "_side").rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("_to", F.last(F.when(F.col("_side") == 1, F.col("_at")), ignorenulls=True).over(later))
    return found.where("_side = 0 and _to is not null").select(record, (F.col("_k") - 1).alias("_k"), "_at", "_to")


def snapshot_and_history(log: DataFrame, record: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(current row per record, all earlier versions)."""
    rest = [c for c in log.columns if c != record]
    newest = log.groupBy(record).agg(F.max_by(F.struct(*rest), version).alias("_row"))
    snapshot = newest.select(record, *[F.col("_row")[c].alias(c) for c in rest])
    heads = newest.select(record, F.col("_row")[version].alias("_head"))
    history = log.join(heads, record).where(F.col(version) < F.col("_head")).drop("_head")
    return snapshot, history


GENESIS = "0" * 64


def record_hash(payload: Sequence[str], previous: str) -> Column:
    """Digest of the JSON array of the fields and the previous hash, so that no separator can be mistaken for content."""
    return F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in (*payload, previous)])), 256)


def build_chain(df: DataFrame, record: str, order: str, payload: Sequence[str], previous: str = "prev_hash", digest: str = "hash") -> DataFrame:
    """``df`` with the hash of the row before in the record's chain (``GENESIS`` for the first) and its own ``record_hash``.

    A chain is sequential by nature, so a record stays in one task; but rows are sorted on disk if need be and streamed
    through it, with only the last hash in memory, however long the chain is. ``order`` is unique within a record; rows
    of a null record make up one chain. Columns of the two names are replaced.
    """
    keep = [c for c in df.columns if c not in (previous, digest)]
    body = F.to_json(F.array(*[F.col(c).cast("string") for c in payload]))
    rows = df.select(*keep, F.struct(record).alias("_key"), body.alias("_body"))
    rows = rows.repartition(F.col(record)).sortWithinPartitions(record, order).withColumn("_key", F.to_json("_key"))
    schema = StructType([*df.select(*keep).schema.fields, StructField(previous, StringType()), StructField(digest, StringType())])

    def run(batches):
        key = last = None
        for batch in batches:
            before, own = [], []
            for now, text in zip(batch.column("_key").to_pylist(), batch.column("_body").to_pylist()):
                if now != key:
                    key, last = now, GENESIS
                before.append(last)
                # The previous hash is the last element of the JSON array.
                last = hashlib.sha256(f'{text[:-1]}{"," if len(text) > 2 else ""}"{last}"]'.encode()).hexdigest()
                own.append(last)
            columns = [batch.column(c) for c in keep] + [pa.array(before, pa.string()), pa.array(own, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, previous, digest])

    return rows.mapInArrow(run, schema)


def verify_chain(df: DataFrame, ledger: str, seq: str, payload: Sequence[str], previous: str, digest: str,
                 heads: DataFrame | None = None) -> DataFrame:
    """``problem`` per row: sequence (no predecessor), link (previous hash differs), hash (recomputed digest
    differs), head (the last row is not the externally known head). Null when the row is sound."""
    before = df.select(ledger, (F.col(seq) + 1).alias(seq), F.col(digest).alias("_before"))
    out = df.join(before, [ledger, seq], "left").withColumn("_before", F.when(F.col(seq) == 1, GENESIS).otherwise(F.col("_before")))
    problem = (
        F.when(F.col("_before").isNull(), "sequence").when(F.col(previous) != F.col("_before"), "link")
        .when(record_hash(payload, previous) != F.col(digest), "hash"))
    if heads is not None:
        last = df.groupBy(ledger).agg(F.max(seq).alias("_last"))
        out = out.join(last, ledger).join(heads.select(ledger, F.col("head").alias("_head")), ledger, "left")
        problem = F.coalesce(problem, F.when((F.col(seq) == F.col("_last")) & ~F.col("_head").eqNullSafe(F.col(digest)), "head"))
    return out.withColumn("problem", problem).select(*df.columns, "problem")


def register_sources(df: DataFrame, cutoff: str) -> DataFrame:
    """Violated rules of every registered source. Columns: source_id, provider, version, published, retrieved,
    valid_start, valid_end, data_hash, evidence_hash, evidence_version, evidence_published, revision_of."""
    original = df.select(F.col("source_id").alias("revision_of"), F.col("provider").alias("_provider"),
                         F.col("version").alias("_version"), F.lit(True).alias("_found"))
    joined = df.join(original, "revision_of", "left")
    revises = F.col("revision_of").isNotNull()
    rules = {
        "missing_version": F.coalesce(F.col("version"), F.lit("")) == "",
        "missing_publication": F.col("published").isNull(),
        "published_after_retrieval": F.col("published") > F.col("retrieved"),
        "valid_period_reversed": F.col("valid_start") > F.col("valid_end"),
        "unavailable_at_cutoff": (F.col("published") > F.col(cutoff)) | (F.col("retrieved") > F.col(cutoff)),
        "future_observations": F.col("valid_end") > F.col(cutoff),
        "evidence_unbound": ~(F.col("evidence_hash").eqNullSafe(F.col("data_hash")) & F.col("evidence_version").eqNullSafe(F.col("version"))
                              & F.col("evidence_published").eqNullSafe(F.col("published"))),
        "unknown_original": revises & F.col("_found").isNull(),
        "revision_mismatch": revises & F.col("_found") & ((F.col("_provider") != F.col("provider")) | (F.col("_version") == F.col("version"))),
    }
    out = validate_rules(joined, {r: F.coalesce(t, F.lit(False)) for r, t in rules.items()})
    return out.select(*df.columns, "violations")


def release_kinds(df: DataFrame) -> DataFrame:
    """First-release and revised actuals apart. Columns: actual_id, forecast_id, published, revision_of, seq.
    ``problem`` names a second first release, an unknown or foreign original, or a revision that is not later."""
    first = df.where(F.col("revision_of").isNull()).groupBy("forecast_id").agg(F.min_by("actual_id", "seq").alias("_first"))
    original = df.select(F.col("actual_id").alias("revision_of"), F.col("forecast_id").alias("_forecast"), F.col("published").alias("_published"))
    out = df.join(first, "forecast_id", "left").join(original, "revision_of", "left")
    revised = F.col("revision_of").isNotNull()
    problem = (
        F.when(~revised & (F.col("actual_id") != F.col("_first")), "first_release_repeated")
        .when(revised & F.col("_forecast").isNull(), "unknown_original")
        .when(revised & (F.col("_forecast") != F.col("forecast_id")), "other_forecast")
        .when(revised & ~F.coalesce(F.col("published") > F.col("_published"), F.lit(False)), "not_later"))
    return out.withColumn("release_kind", F.when(revised, "revised").otherwise("first_release")).withColumn("problem", problem).select(
        *df.columns, "release_kind", "problem")
