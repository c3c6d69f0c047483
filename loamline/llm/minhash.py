"""MinHash near-duplicates with sequential Bayesian verification.

Documents with the same set of word shingles are one *class* with one representative. Representatives are banded; in
each band's bucket they are compared with the bucket's smallest member, and, where a bucket still holds several
components after that, across these components. A pair is compared batch by batch of its signatures: the matches so
far give a posterior of the Jaccard similarity (uniform prior), and the pair is dropped once the chance that it reaches
the threshold is below ``miss``. Survivors are verified on their full sets, so every link is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loamline.llm.components import components, joined
from loamline.llm.shared import Scratch, small_batches, stored
from loamline.llm.words import Words, chunks, mix, signed, to_bytes


@dataclass(frozen=True)
class NearDup:
    """32 bands of 6 find a pair of similarity 0.8 with probability 0.9999; ``miss`` is the chance to drop a true pair.

    ``best``: rounds in which a document verifies only that many most similar ones of other components in its bucket; they
    join nearly all of a large group with few pairs. One more round takes all pairs that are left between components.
    """

    shingle: int = 5
    numerator: int = 80
    denominator: int = 100
    bands: int = 32
    rows: int = 6
    batch: int = 32
    miss: float = 1e-5
    block: int = 1000
    best: tuple[int, ...] = (2, 2)
    seed: int = 7

    def reached(self, x: np.ndarray, y: np.ndarray) -> bool:
        """Whether two full shingle sets are similar enough."""
        return bool(self.enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))

    def enough(self, both, x, y):
        """Whether sets of the sizes x and y that share ``both`` shingles are similar enough; also for arrays."""
        return self.denominator * both >= self.numerator * (x + y - both)

    @property
    def size(self) -> int:
        return self.bands * self.rows


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer than k words is one shingle, one without words
    has none. A-Z count as a-z."""
    found: list[np.ndarray] = []
    for begin, end in chunks(texts):
        words = Words(texts[begin:end], lower=True)
        h = words.hashes
        rolled = h.copy()
        for step in range(1, k):
            rolled[: len(h) - step] = mix(rolled[: len(h) - step] * np.uint64(0x9FB21C651E98DF25) + h[step:])
        for a, b in zip(words.first[:-1], words.first[1:]):
            if b - a >= k:
                found.append(np.unique(rolled[a:b - k + 1]))
            elif b > a:
                short = np.full(1, b - a, dtype=np.uint64)
                for i in range(a, b):
                    short = mix(short * np.uint64(0x9FB21C651E98DF25) + h[i:i + 1])
                found.append(short)
            else:
                found.append(np.zeros(0, dtype=np.uint64))
    return found


class Hasher:
    """Signatures of 16 bits per hash function, and the band keys that they give."""

    def __init__(self, plan: NearDup):
        rng = np.random.default_rng(plan.seed)
        self.plan = plan
        self.a = rng.integers(0, 1 << 31, plan.size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, plan.size, dtype=np.uint32)
        self.salt = mix(np.arange(1, plan.bands + 1, dtype=np.uint64))

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        low = np.full(self.plan.size, 0xFFFFFFFF, dtype=np.uint32)
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        for begin in range(0, len(x), 4096):
            part = np.multiply.outer(self.a, x[begin:begin + 4096])
            part += self.b[:, None]
            part ^= part >> np.uint32(15)
            low = np.minimum(low, part.min(axis=1))
        return low.astype(np.uint16)

    def bands(self, low: np.ndarray) -> np.ndarray:
        key = self.salt.copy()
        for column in low.reshape(self.plan.bands, self.plan.rows).T:
            key = mix(key * np.uint64(0x9FB21C651E98DF25) + column.astype(np.uint64))
        return key


SKETCH = "doc_id long, n_shingles long, k1 long, k2 long, sig binary, bands array<long>"


def sketches(docs: DataFrame, plan: NearDup) -> DataFrame:
    """Per document: size and two-part key of its shingle set, signature and band keys (null for an empty set)."""

    def run(batches):
        hasher = Hasher(plan)
        for batch in batches:
            ids, texts = batch.column(0), to_bytes(batch.column(1))
            for at in range(0, len(texts), 1000):
                sets = shingle_sets(texts[at:at + 1000], plan.shingle)
                n = [len(s) for s in sets]
                k1 = [int(np.add.reduce(mix(s))) if len(s) else 0 for s in sets]
                k2 = [int(np.bitwise_xor.reduce(mix(s + np.uint64(99)))) if len(s) else 0 for s in sets]
                low = [hasher.minima(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, 1000), pa.array(n, pa.int64()), signed(np.array(k1, dtype=np.uint64)), signed(np.array(k2, dtype=np.uint64)),
                    pa.array([None if x is None else x.tobytes() for x in low], pa.binary()),
                    pa.array([None if x is None else hasher.bands(x).view(np.int64) for x in low], pa.list_(pa.int64())),
                ], names=["doc_id", "n_shingles", "k1", "k2", "sig", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, SKETCH)


def least_matches(plan: NearDup) -> list[tuple[int, int]]:
    """(hashes compared, fewest matches that keep a pair) after each batch: below it the posterior chance of a
    similarity at or above the threshold is under ``miss``."""
    x = (np.arange(20_000) + 0.5) / 20_000
    above = x >= plan.numerator / plan.denominator
    found = []
    for n in range(plan.batch, plan.size + 1, plan.batch):
        for m in range(n + 1):
            log = m * np.log(x) + (n - m) * np.log1p(-x)
            weight = np.exp(log - log.max())
            if weight[above].sum() >= plan.miss * weight.sum():
                found.append((n, m))
                break
    return found


def survives(left: np.ndarray, right: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the row pairs of two signature matrices that no batch prunes."""
    alive, done, matches = np.arange(len(left)), 0, np.zeros(len(left), dtype=np.int64)
    for n, least in bounds:
        matches = matches + (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
        stay = matches >= least
        alive, matches, done = alive[stay], matches[stay], n
        if not len(alive):
            break
    return alive


class SetTable:
    """Full shingle sets of one task, numbered so that one set meets many in a single pass over their numbers."""

    def __init__(self, sets: list[np.ndarray]):
        values, numbers = np.unique(np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]), return_inverse=True)
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.numbers, self.marks = numbers.astype(np.int32), np.zeros(len(values), dtype=np.int8)

    def shared(self, i: int, others: np.ndarray) -> np.ndarray:
        """Number of shingles that set i shares with each of the sets ``others``, none of which is empty."""
        own = self.numbers[self.first[i]:self.first[i + 1]]
        self.marks[own] = 1
        both = np.array([self.marks[self.numbers[self.first[j]:self.first[j + 1]]].sum(dtype=np.int64) for j in others], dtype=np.int64)
        self.marks[own] = 0
        return both


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, size)


def _pruned(pairs: DataFrame, signatures: DataFrame, plan: NearDup) -> DataFrame:
    """Candidate pairs (a, b) that survive the comparison of signatures."""
    bounds = least_matches(plan)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keep = survives(_matrix(batch.column(2), plan.size), _matrix(batch.column(3), plan.size), bounds)
                yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(keep)) for i in (0, 1)], names=["a", "b"])

    left = signatures.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"))
    right = signatures.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, plan: NearDup) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold."""

    def run(batches):
        for batch in batches:
            a, b = to_bytes(batch.column(2)), to_bytes(batch.column(3))
            sets: dict[bytes, np.ndarray] = {}
            keep = []
            for i, (x, y) in enumerate(zip(a, b)):
                if len(sets) > 500:
                    sets = {k: v for k, v in sets.items() if k in (x, y)}
                for t in (x, y):
                    if t not in sets:
                        sets[t] = shingle_sets([t], plan.shingle)[0]
                if plan.reached(sets[x], sets[y]):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(keep, pa.int64())) for i in (0, 1)], names=["a", "b"])

    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _across(members: DataFrame, plan: NearDup, best: int | None, sift: bool = False) -> DataFrame:
    """Surviving pairs between the components of a bucket; ``members``: band, key, rep, component, sig, of mixed buckets.

    A bucket's largest component is not compared with itself; the others form blocks of about ``block`` members, and
    each block meets each block of the bucket in a task of its own, so no task grows with a bucket. A pair is given by the
    first band only that it has in common. ``best`` keeps the most similar partners of each member; None keeps
    all, verified in the task itself on the members' ``text``, so that only links leave it however many pairs are close.
    ``sift`` reads no texts and gives, instead of pairs, the members (key, rep) that have a surviving partner.
    """
    bounds = least_matches(plan)
    shares = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    sizes = shares.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"),
                                      F.sum("n").alias("all"), F.max("n").alias("most"))
    parts = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / plan.block)).cast("long")
    rows = members.join(sizes.select("key", "main", parts("all").alias("blocks"), F.greatest(
        F.lit(1), F.ceil((F.col("all") - F.col("most")) / plan.block)).cast("long").alias("other_blocks")), "key")
    spread = F.abs(F.xxhash64("rep", "key"))
    exact = best is None and not sift
    text = ["text"] if exact else []
    right = rows.select(*text, "key", "band", F.lit(False).alias("left"), "rep", "component", "sig", (spread % F.col("blocks")).alias("right_block"),
                        F.explode(F.sequence(F.lit(0).cast("long"), F.col("other_blocks") - 1)).alias("left_block"))
    left = rows.where("component <> main").select(
        *text, "key", "band", F.lit(True).alias("left"), "rep", "component", "sig",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("right_block"), (spread % F.col("other_blocks")).alias("left_block"))

    def run(table: pa.Table) -> pa.Table:
        rep, comp = table.column("rep").to_numpy(), table.column("component").to_numpy()
        sig, side = _matrix(table.column("sig"), plan.size), table.column("left").to_numpy()
        lefts, rights, out, band = np.flatnonzero(side), np.flatnonzero(~side), [], table.column("band")[0].as_py()
        near = np.zeros(len(rep), dtype=bool)
        banded = sig.reshape(-1, plan.bands, plan.rows)
        sets = SetTable(shingle_sets(to_bytes(table.column("text").combine_chunks()), plan.shingle)) if exact else None
        for i in lefts:
            other = rights[comp[rights] != comp[i]]
            keep = other[survives(np.broadcast_to(sig[i], (len(other), plan.size)), sig[other], bounds)]
            keep = keep[(banded[keep] == banded[i]).all(axis=2).argmax(axis=1) == band]
            if exact:
                keep = keep[plan.enough(sets.shared(i, keep), sets.sizes[i], sets.sizes[keep])]
            elif best is not None and len(keep) > best:
                keep = keep[np.argsort(-(sig[keep] == sig[i]).sum(axis=1), kind="stable")[:best]]
            if sift:
                near[keep] = True
                near[i] |= len(keep) > 0
            else:
                out.append(np.stack([np.minimum(rep[keep], rep[i]), np.maximum(rep[keep], rep[i])]))
        if sift:
            found = np.unique(rep[near])
            return pa.table({"key": np.full(len(found), table.column("key")[0].as_py(), dtype=np.int64), "rep": found.astype(np.int64)})
        pairs = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((2, 0), dtype=np.int64)
        return pa.table({"a": pairs[0].astype(np.int64), "b": pairs[1].astype(np.int64)})

    return left.unionByName(right).groupBy("key", "left_block", "right_block").applyInArrow(
        run, "key long, rep long" if sift else "a long, b long")


def near_duplicates(docs: DataFrame, plan: NearDup = NearDup()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id reachable), kept.

    Null and empty texts have no shingles and link with nothing. Rows that share a doc_id are one node. A null doc_id
    links with nothing, gets a null component and is kept. Other columns are not read.
    """
    scratch = Scratch()
    made = scratch.stored(sketches(small_batches(docs), plan))
    classes = made.where("n_shingles > 0").groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    keyed = scratch.stored(made.join(classes, ["k1", "k2", "n_shingles"], "left").select(
        "doc_id", "n_shingles", "rep", *[F.when(F.col("doc_id") == F.col("rep"), F.col(c)).alias(c) for c in ("sig", "bands")]))
    scratch.emptied(made)
    chosen = keyed.where("sig is not null").groupBy("rep").agg(F.min(F.struct("sig", "bands")).alias("s")).select("rep", "s.*")
    buckets = scratch.stored(chosen.select("rep", F.posexplode("bands").alias("band", "key")))
    lead = buckets.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("top")).where("lead < top")
    shared = scratch.stored(buckets.join(lead, "key").select("band", "key", "rep", "lead"))
    scratch.emptied(buckets)
    signatures = scratch.stored(chosen.select("rep", "sig").join(shared.select("rep").distinct(), "rep", "left_semi"))
    pairs = shared.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    texts = scratch.stored(_texts(docs, shared))
    tried = stored(_pruned(pairs, signatures, plan))
    links = stored(_verified(tried, texts, plan))
    same = keyed.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    reach, done = stored(components(links.union(same))), 0  # done: partners of a member tried between these components
    for best in (*plan.best, None):
        if best is not None and best <= done:
            continue
        if not done:
            inside = shared.join(reach.withColumnRenamed("node", "rep"), "rep", "left").select(
                "band", "key", "rep", F.coalesce("component", "rep").alias("component"))
            mixed = inside.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
            members = scratch.stored(inside.join(mixed, "key").join(signatures, "rep"))
            if members.isEmpty():
                break
        if best is None:
            close = members.join(_across(members, plan, None, sift=True).distinct(), ["key", "rep"], "left_semi")
            links = stored(_across(stored(close).join(texts, "rep"), plan, None).distinct())
            reach = stored(joined(reach, links))
            break
        more = stored(_across(members, plan, best).distinct().join(tried, ["a", "b"], "left_anti"))
        links, tried = stored(_verified(more, texts, plan)), tried.union(more)
        if links.isEmpty():
            done = best
        else:
            reach, done = stored(joined(reach, links)), 0
    sizes = stored(keyed.select("doc_id", "n_shingles"))
    scratch.emptied()
    return sizes.join(reach.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _texts(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """The texts (rep, text) of all documents in shared buckets."""
    wanted = shared.select("rep").distinct().hint("merge")
    found = docs.select(F.col("doc_id").alias("rep"), "text").where("text is not null").join(wanted, "rep", "left_semi")
    return found.dropDuplicates(["rep", "text"])
