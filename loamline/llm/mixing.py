"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from loamline.llm.numbering import RUN
from loamline.llm.sharding import Feistel
from loamline.llm.shared import listed


@dataclass(frozen=True)
class Mix:
    """``block``: words of a block. ``most``: times a source may be repeated. ``shards``: shards with quotas of their own."""

    block: int = 64
    most: int = 3
    shards: int = 8
    seed: int = 11
    rows_per_part: int = 50_000


def targets(sizes: list[int], weights: list[float], most: int) -> list[float]:
    """Shares of the total by weight, none above ``most`` times its size; what is over goes to the others by weight."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), float(sum(sizes))
    while open_:
        per = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if per * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = per * weights[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ -= set(full)
    assert sum(out) <= total + 1e-6 * max(1.0, total)
    return out


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    """Seats by the highest quotients votes / (2 * seats so far + 1), equal ones to the earlier party.

    Rounding the votes by a divisor somewhat too large gives every party no more than its due and all but a few seats per
    party; the rest is dealt one by one, so the work does not grow with the number of seats.
    """
    exact = [Fraction(v).limit_denominator(10**9) for v in votes]
    if not sum(exact) or not seats:
        return [0] * len(votes)
    got = [0] * len(votes)
    if seats >= len(votes):
        divisor = sum(exact) / seats * Fraction(seats + len(votes), seats)
        got = [int(v / divisor + Fraction(1, 2)) for v in exact]
    queue = [(-v / (2 * g + 1), i) for i, (v, g) in enumerate(zip(exact, got)) if v]
    heapq.heapify(queue)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(queue)
        got[i] += 1
        heapq.heappush(queue, (-exact[i] / (2 * got[i] + 1), i))
    return got


@dataclass(frozen=True)
class Share:
    """One source of the mix: its words, target, blocks, and how many block picks end with each shard."""

    source: str | None
    size: int
    target: float
    blocks: int
    picks: tuple[int, ...]


def shares(sizes: dict[str | None, int], weights: dict[str | None, float], plan: Mix) -> list[Share]:
    names = list(sizes)
    size = [sizes[n] for n in names]
    goal = targets(size, [weights[n] for n in names], plan.most)
    seats = round(sum(goal) / plan.block)
    steps = [sainte_lague(goal, seats * j // plan.shards) for j in range(1, plan.shards + 1)]
    out = []
    for i, name in enumerate(names):
        blocks = -(-size[i] // plan.block)
        out.append(Share(name, size[i], goal[i], blocks, tuple(min(s[i], plan.most * blocks) for s in steps)))
    return out


def source_sizes(docs: DataFrame) -> dict[str | None, int]:
    """Words per source, by code point with null last. One row per source comes to the driver: the sources are the
    entries of the mix, which a user names with their weights."""
    rows = docs.groupBy("source").agg(F.sum("size").alias("size")).collect()
    return {r["source"]: r["size"] for r in sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))}


def positions(docs: DataFrame, rows: int, plan: Mix) -> DataFrame:
    """Each row of ``docs`` (source, size, ... all columns groupable) with ``begin``: its first word's place among the
    words of its source, laid out in seeded order.

    A source is cut into parts by the seeded hash, so that a source with a third of all rows is ordered in many tasks;
    only the parts' sizes are added up per source. Equal rows are counted before the shuffle and laid side by side.
    """
    parts = max(1, -(-rows // plan.rows_per_part))
    columns = docs.columns
    counted = docs.groupBy(*columns).agg(F.count("*").alias("_copies")).withColumn("_key", F.xxhash64(F.lit(plan.seed), *columns)).withColumn(
        "_part", F.pmod(F.shiftright("_key", 20), F.lit(parts)))
    sizes = counted.groupBy("source", "_part").agg(F.sum(F.col("_copies") * F.col("size")).alias("_size"))
    before = W.partitionBy("source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(F.col("source").alias("_source"), F.col("_part").alias("_p"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy("source", "_part").orderBy("_key", *columns).rowsBetween(W.unboundedPreceding, -1)
    placed = counted.withColumn("_inside", F.coalesce(F.sum(F.col("_copies") * F.col("size")).over(inside), F.lit(0))).join(
        offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_p")))
    runs = placed.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(RUN))))
    each = runs.withColumn("_copy", F.explode(F.sequence("_run", F.least(F.col("_run") + RUN, F.col("_copies")) - 1)))
    return each.select(*columns, (F.col("_offset") + F.col("_inside") + F.col("_copy") * F.col("size")).alias("begin"))


def mix(docs: DataFrame, weights, plan: Mix = Mix()) -> DataFrame:
    """Rows of ``docs`` (with long ``size``, words, and ``source``) with source_size, target, taken and shard_words.

    ``weights`` maps the list of sources (code point order, null last) to their weights. A source's words, in seeded
    order, are cut into blocks; its quota of blocks goes round its blocks in the order of a seeded permutation, each
    block once before any is repeated. taken: words of the row that the mix takes, repeats counted, at most ``most``
    times its size; shard_words: the same per shard. A null size counts as 0. Reruns agree.
    """
    docs = docs.withColumn("size", F.coalesce("size", F.lit(0)).cast("long"))
    sizes = source_sizes(docs)
    columns = [c for c in docs.columns if c not in ("source_size", "target", "taken", "shard_words", "begin")]
    if not sizes:
        return docs.select(*columns).withColumns({
            "source_size": F.lit(0).cast("long"), "target": F.lit(0.0), "taken": F.lit(0).cast("long"), "shard_words": F.array(F.lit(0).cast("long"))})
    dealt = shares(sizes, weights(list(sizes)), plan)
    laid = positions(docs.select(*columns), docs.count(), plan)
    rows = []
    for s in dealt:
        a, b = Feistel(s.blocks, plan.seed).grid
        rows.append((s.source, s.size, s.target, s.blocks, a, b, list(s.picks)))
    table = listed(docs.sparkSession, rows, pa.schema([
        ("_s", pa.string()), ("source_size", pa.int64()), ("target", pa.float64()), ("_blocks", pa.int64()), ("_a", pa.int64()), ("_b", pa.int64()),
        ("_picks", pa.list_(pa.int64()))]))
    joined = laid.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("_s")))
    n = F.col("_blocks")
    last = F.col("begin") + F.col("size")

    def count(block):
        # The p-th pick of a source is block p mod n of its permuted order; shard j takes the picks up to _picks[j].
        at = _permuted(block, plan.seed)
        words = F.least(last, (block + 1) * plan.block) - F.greatest(F.col("begin"), block * plan.block)
        upto = F.transform("_picks", lambda q: F.call_function("div", q, n) + F.when(at < q % n, 1).otherwise(0))
        return F.transform(upto, lambda t: t * words)

    blocks = F.when(F.col("size") > 0, F.sequence(
        F.call_function("div", F.col("begin"), F.lit(plan.block)), F.call_function("div", last - 1, F.lit(plan.block)))).otherwise(
        F.array().cast("array<long>"))
    zero = F.array_repeat(F.lit(0).cast("long"), plan.shards)
    upto = F.aggregate(blocks, zero, lambda acc, block: F.zip_with(acc, count(block), lambda x, y: x + y))
    done = joined.withColumn("_upto", upto)
    each = F.transform("_upto", lambda x, i: x - F.when(i > 0, F.get("_upto", i - 1)).otherwise(F.lit(0)))
    return done.select(*columns, "source_size", "target", F.element_at("_upto", -1).alias("taken"), each.alias("shard_words"))


def _permuted(block, seed: int):
    """Feistel permutation of a source's blocks; its grid comes from the row, so one expression serves all sources."""
    n, a, b = F.col("_blocks"), F.col("_a"), F.col("_b")

    def once(x):
        right = x % b
        left = F.call_function("div", x - right, b)
        for i in range(4):
            if i % 2:
                right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(seed * 64 + i)), b), b)
            else:
                left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(seed * 64 + i)), a), a)
        return left * b + right

    first = once(block)
    walk = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), a * b - n)), first,
                       lambda y, _: F.when(y >= n, once(y)).otherwise(y))
    return F.when(first < n, first).otherwise(walk)


def cycle_weights(sources: list[str | None]) -> dict[str | None, float]:
    """Weights 1, 2, 3, repeating, in the given order."""
    return {s: float(i % 3 + 1) for i, s in enumerate(sources)}
