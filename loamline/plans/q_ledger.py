"""Change-log and hash-chain queries over the conversation log."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamline.operators import ledger as L
from loamline.plans.q_windows import ints
from loamline.plans.registry import query


def attempts(t):
    """Every log row writes twice; some writes expect a wrong version or come from another owner."""
    k = F.col("version").cast("long")
    first = t.log.select("record_id", (k * 2).alias("seq"), F.when(F.col("v") % 5 == 0, k + 1).otherwise(k).alias("expected"),
                         F.when(F.col("v") % 11 == 0, "stranger").otherwise("owner").alias("owner"))
    second = t.log.select("record_id", (k * 2 + 1).alias("seq"), F.when(F.col("v") % 3 == 0, k - 1).otherwise(k).alias("expected"), F.lit("owner").alias("owner"))
    return first.unionByName(second)


@query("l01_versioned_updates", "log", """
    with recursive a as (select record_id, version * 2 as seq, case when v % 5 = 0 then version + 1 else version end as expected, case when v % 11 = 0 then 'stranger' else 'owner' end as owner from log
        union all select record_id, version * 2 + 1, case when v % 3 = 0 then version - 1 else version end, 'owner' from log),
    c as (select record_id, arg_min(owner, seq) as owner, min(seq) as created from a where expected = 0 group by record_id),
    m as (select a.record_id, a.seq, a.expected from a join c on c.record_id = a.record_id and c.owner = a.owner),
    w as (select record_id, 0 as k, created as at from c union all select w.record_id, w.k + 1, (select min(seq) from m where m.record_id = w.record_id and m.expected = w.k + 1 and m.seq > w.at) from w
        where (select min(seq) from m where m.record_id = w.record_id and m.expected = w.k + 1 and m.seq > w.at) is not null)
    select a.record_id, cast(a.seq as bigint) as seq, cast(a.expected as bigint) as expected, a.owner, case when c.record_id is null or a.seq < c.created then 'not_found' when a.owner <> c.owner then 'owner_changed' when w.at is not null then 'applied' else 'version_conflict' end as status
    from a left join c on c.record_id = a.record_id left join w on w.record_id = a.record_id and w.at = a.seq and w.k = a.expected""")
def _(t):
    return L.apply_versioned(attempts(t), "record_id", "seq", "expected", "owner")


@query("l02_snapshot_and_history", "log", """
    select record_id, cast(version as bigint) as version, v, case when version = max(version) over (partition by record_id) then 'current' else 'history' end as kind from log""")
def _(t):
    snapshot, history = L.snapshot_and_history(t.log, "record_id", "version")
    both = snapshot.withColumn("kind", F.lit("current")).unionByName(history.withColumn("kind", F.lit("history")))
    return both.select("record_id", *ints("version"), "v", "kind")


def chained(t):
    """Build one sound chain per record, then change some payloads and drop some rows."""
    steps = t.log.select("record_id", F.col("record_id").cast("string").alias("ledger"), (F.col("version") + 1).cast("long").alias("seq"),
                         F.concat_ws(":", "owner", "v").alias("payload"))
    rows = L.build_chain(steps, "ledger", "seq", ["payload"])
    changed = F.when(F.length("payload") % 7 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload"))
    return rows.where(~((F.col("record_id") % 10 == 0) & (F.col("seq") == 3))).withColumn("payload", changed)


@query("l03_hash_chain", "log", """
    with r as (select record_id, version + 1 as seq, owner || ':' || v as payload from log),
    k as (select *, max(seq) over (partition by record_id) as last from r where not (record_id % 10 = 0 and seq = 3))
    select k.record_id, cast(k.seq as bigint) as seq, case when k.seq > 1 and p.seq is null then 'sequence' when length(k.payload) % 7 = 0 then 'hash' when k.seq = k.last and k.record_id % 6 = 0 then 'head' end as problem
    from k left join k p on p.record_id = k.record_id and p.seq = k.seq - 1""")
def _(t):
    rows = chained(t)
    last = rows.groupBy("ledger").agg(F.max_by("hash", "seq").alias("head"), F.first("record_id").alias("record_id"))
    heads = last.withColumn("head", F.when(F.col("record_id") % 6 == 0, L.GENESIS).otherwise(F.col("head")))
    out = L.verify_chain(rows, "ledger", "seq", ["payload"], "prev_hash", "hash", heads)
    return out.select("record_id", "seq", "problem")


@query("l04_source_registration", "", """
    with s as (select o_orderkey as k, 'p' || (o_custkey % 3) as provider, case when o_orderkey % 50 = 0 then '' else 'v' || (o_orderkey % 4) end as version, o_orderdate as published, o_orderdate + (o_orderkey % 5 - 1) * interval '1' day as retrieved,
        o_orderdate - (o_orderkey % 7 - 1) * interval '1' day as vs, o_orderdate as ve, case when o_orderkey % 9 = 0 then 'x' else 'h' end as eh, case when o_orderkey % 6 = 0 then o_orderkey - 6 when o_orderkey % 31 = 0 then -1 end as rev from orders)
    select s.k as source_id, concat_ws(',', case when s.version = '' then 'missing_version' end, case when s.published > s.retrieved then 'published_after_retrieval' end, case when s.vs > s.ve then 'valid_period_reversed' end,
        case when s.published > timestamp '2000-01-01' or s.retrieved > timestamp '2000-01-01' then 'unavailable_at_cutoff' end, case when s.ve > timestamp '2000-01-01' then 'future_observations' end, case when eh <> 'h' then 'evidence_unbound' end,
        case when s.rev is not null and o.k is null then 'unknown_original' end, case when s.rev is not null and (o.provider <> s.provider or o.version = s.version) then 'revision_mismatch' end) as violations
    from s left join (select k, provider, version from s) o on o.k = s.rev""")
def _(t):
    k, at = F.col("o_orderkey"), F.col("o_orderdate")

    def days(n):
        return F.make_dt_interval(n.cast("int"))

    rows = t.orders.select(
        k.alias("source_id"), F.concat(F.lit("p"), F.col("o_custkey") % 3).alias("provider"), F.when(k % 50 == 0, "").otherwise(F.concat(F.lit("v"), k % 4)).alias("version"),
        at.alias("published"), (at + days(k % 5 - 1)).alias("retrieved"), (at - days(k % 7 - 1)).alias("valid_start"), at.alias("valid_end"), F.lit("h").alias("data_hash"),
        F.when(k % 9 == 0, "x").otherwise("h").alias("evidence_hash"), F.when(k % 50 == 0, "").otherwise(F.concat(F.lit("v"), k % 4)).alias("evidence_version"),
        at.alias("evidence_published"), F.when(k % 6 == 0, k - 6).when(k % 31 == 0, -1).alias("revision_of"), F.lit("2000-01-01 00:00:00").cast("timestamp_ntz").alias("cutoff"))
    return L.register_sources(rows, "cutoff").select("source_id", F.array_join("violations", ",").alias("violations"))


@query("l05_release_kinds", "log", """
    with a as (select record_id * 100 + version as actual_id, record_id as forecast_id, v as published, case when version % 3 = 1 then record_id * 100 + version - 1 when version = 5 then record_id * 100 + 99 when version = 6 then (record_id + 1) * 100 end as revision_of, version as seq from log),
    f as (select forecast_id, arg_min(actual_id, seq) as first_id from a where revision_of is null group by forecast_id)
    select a.actual_id, case when a.revision_of is null then 'first_release' else 'revised' end as release_kind,
        case when a.revision_of is null and a.actual_id <> f.first_id then 'first_release_repeated' when a.revision_of is not null and o.actual_id is null then 'unknown_original' when a.revision_of is not null and o.forecast_id <> a.forecast_id then 'other_forecast'
             when a.revision_of is not null and not (a.published > o.published) then 'not_later' end as problem
    from a left join f on f.forecast_id = a.forecast_id left join a o on o.actual_id = a.revision_of""")
def _(t):
    k, r = F.col("version"), F.col("record_id")
    rows = t.log.select(
        (r * 100 + k).alias("actual_id"), r.alias("forecast_id"), F.col("v").alias("published"),
        F.when(k % 3 == 1, r * 100 + k - 1).when(k == 5, r * 100 + 99).when(k == 6, (r + 1) * 100).alias("revision_of"), k.alias("seq"))
    return L.release_kinds(rows).select("actual_id", "release_kind", "problem")
