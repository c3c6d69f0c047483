"""Ranked lexical search with a length-stratified index.

A document's length enters its score only as the normaliser m, a whole number, so documents of equal m make up a
stratum. Inside a block of a stratum the postings of a term are ordered by tf: all documents of one tf have the same
impact, which is computed once per tf, and the last tf of a term bounds what the term can add in the block. The sum of
these bounds over an item's terms bounds every score in the block. Blocks are visited by falling bounds, and an item is
done with a task as soon as the next bound is below the score that its k-th document already has.

Three passes read the written index: the best block of each item by bound, the scores in those blocks, which give each
item a threshold to start from, and the visit of all other blocks whose bound reaches it. All scores are exact.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from loamline.llm.shared import small_batches, stored

LETTERS = bytes(b for b in range(256) if b >= 0x80 or chr(b).isalnum())
# Every byte that no term has becomes a space; A-Z become a-z.
FOLD = bytes(ord(chr(b).lower()) if b < 0x80 and b in LETTERS else b if b in LETTERS else 0x20 for b in range(256))
PART = 1 << 22
BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


@dataclass(frozen=True)
class Search:
    """``k`` results an item. ``item_terms``: distinct (item, term) pairs that are asked together; more items are asked in
    further rounds over the documents. ``block``: documents of a block of the index at most. ``seeds``: blocks that give
    an item its first threshold. ``task``: documents of a task that builds or searches the index, about."""

    k: int = 10
    item_terms: int = 1_000_000
    block: int = 4096
    seeds: int = 2
    task: int = 8192


def _parts(data: bytes) -> Iterator[bytes]:
    """A text in parts of some MB that end between terms."""
    at = 0
    while len(data) - at > PART:
        end = BREAK.search(data, at + PART)
        if end is None:
            break
        yield data[at:end.start()]
        at = end.start()
    yield data[at:] if at else data


def count_terms(data: bytes) -> Counter:
    """Term (bytes) -> occurrences in the whole text."""
    counts = Counter()
    for part in _parts(data):
        counts.update(part.translate(FOLD).split())
    return counts


def _item_terms(items: DataFrame) -> DataFrame:
    """Distinct rows (item_id, term)."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                terms = list(count_terms(text or b""))
                owner = pa.array(np.full(len(terms), i), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), pa.array(terms, pa.binary())], names=["item_id", "term"])

    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, term binary").distinct()


def _vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per document: doc_id, n (terms with repeats), and the terms it shares with ``vocabulary`` (numbers) with their tf."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shipped.value
        for batch in batches:
            ns, terms, tfs, bounds = [], [], [], [0]
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                counts = count_terms(text or b"")
                shared = counts.keys() & known.keys()
                ns.append(counts.total())
                terms.extend(map(known.__getitem__, shared))
                tfs.extend(map(counts.__getitem__, shared))
                bounds.append(len(terms))
            at = pa.array(bounds, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<long>")


INDEX = "block long, m long, docs array<{}>, term array<int>, tf array<long>, start array<int>, posting array<int>"


def build_index(vectors: DataFrame, rows: int, plan: Search = Search()) -> DataFrame:
    """Blocks of the index from rows (doc_id, m, terms, tfs): block (its number), m, docs, and for each (term, tf), in this
    order, the documents posting[start[i]:start[i + 1]], as places in docs.

    Rows are dealt by ranges of m and a hash, so a length that very many documents have is dealt to several tasks, and
    none is gathered as a group; a task cuts its sorted rows into blocks of one m. ``rows``: the number of vectors.
    """
    kind = vectors.schema["doc_id"].dataType.simpleString()

    def block(m: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        docs = table.column("doc_id").chunk(0)
        lists = table.column("terms").chunk(0)
        sizes = np.diff(lists.offsets.to_numpy())
        term, tf = lists.flatten().to_numpy(), table.column("tfs").chunk(0).flatten().to_numpy()
        owner = np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
        order = np.lexsort((owner, tf, term))
        term, tf, owner = term[order], tf[order], owner[order]
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])])
        arrays = [term[first], tf[first], np.r_[first, len(term)].astype(np.int32), owner]
        whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))
        return pa.RecordBatch.from_arrays(
            [pa.array([m], pa.int64()), whole(docs), *map(whole, arrays)], names=["m", "docs", "term", "tf", "start", "posting"])

    def run(batches):
        held, m, n = [], None, 0
        for batch in batches:
            ms = batch.column(1).to_numpy()
            for at, end in _runs(ms):
                while at < end:
                    if n and (ms[at] != m or n == plan.block):
                        yield block(m, held)
                        held, n = [], 0
                    m = int(ms[at])
                    upto = min(end, at + plan.block - n)
                    held.append(batch.slice(at, upto - at))
                    n, at = n + upto - at, upto
        if n:
            yield block(m, held)

    dealt = vectors.repartitionByRange(max(1, -(-rows // plan.task)), "m", F.xxhash64("doc_id", "terms")).sortWithinPartitions("m")
    blocks = dealt.select("doc_id", "m", "terms", "tfs").mapInArrow(run, INDEX.format(kind).removeprefix("block long, "))
    return blocks.withColumn("block", F.monotonically_increasing_id())


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True]) if len(values) else np.zeros(0, dtype=np.int64)
    return zip(edges[:-1].tolist(), edges[1:].tolist())


class Asked:
    """The items of a round: item i asks for the terms ``term[first[i]:first[i + 1]]``, each of ``weight[term]``."""

    def __init__(self, first: np.ndarray, term: np.ndarray, weight: np.ndarray):
        self.first, self.term, self.weight = first, term, weight


class Block:
    """A row of the index with the impact of each of its (term, tf)."""

    def __init__(self, batch: pa.RecordBatch, i: int, asked: Asked):
        take = lambda name: batch.column(name)[i].values
        self.docs = take("docs")
        self.posting = take("posting").to_numpy()
        term, tf, start = (take(n).to_numpy() for n in ("term", "tf", "start"))
        m = batch.column("m")[i].as_py()
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m)
        last = np.flatnonzero(np.r_[term[1:] != term[:-1], True])
        self.first = np.full(len(asked.weight), -1, dtype=np.int64)
        self.end = np.zeros(len(asked.weight), dtype=np.int64)
        self.first[term[last]], self.end[term[last]] = start[np.r_[0, last[:-1] + 1]], start[last + 1]
        self.impact = np.repeat(impact, np.diff(start))
        most = np.zeros(len(asked.weight), dtype=np.int64)
        most[term[last]] = asked.weight[term[last]] * impact[last]
        self.bounds = np.add.reduceat(most[asked.term], asked.first[:-1])

    def scores(self, item: int, asked: Asked) -> np.ndarray:
        found = np.zeros(len(self.docs), dtype=np.int64)
        for t in asked.term[asked.first[item]:asked.first[item + 1]]:
            a, b = self.first[t], self.end[t]
            if a >= 0:
                found[self.posting[a:b]] += asked.weight[t] * self.impact[a:b]
        return found

    def best(self, item: int, asked: Asked, least: int, k: int) -> tuple[np.ndarray, pa.Array]:
        """Scores and documents of the k best in the block, of a score of ``least`` at least; ties go to smaller doc_ids."""
        found = self.scores(item, asked)
        at = np.flatnonzero(found >= max(least, 1))
        if len(at) > k:
            kth = np.partition(found[at], len(at) - k)[len(at) - k]
            above, ties = at[found[at] > kth], at[found[at] == kth]
            order = pc.array_sort_indices(self.docs.take(pa.array(ties)), null_placement="at_start").to_numpy()
            at = np.r_[above, ties[order][:k - len(above)]]
        return found[at], self.docs.take(pa.array(at))


def _best_blocks(index: DataFrame, asked, n_items: int, seeds: int) -> list:
    """Rows (item, block): the blocks of the highest bound for each item. A task hands on its best for each item only."""

    def run(batches):
        top, where = np.zeros((seeds, n_items), dtype=np.int64), np.full((seeds, n_items), -1, dtype=np.int64)
        for batch in batches:
            number = batch.column("block").to_numpy()
            for i in range(batch.num_rows):
                bound, at = Block(batch, i, asked.value).bounds.copy(), np.full(n_items, number[i])
                for s in range(seeds):
                    more = bound > top[s]
                    bound[more], top[s][more] = top[s][more], bound[more]
                    at[more], where[s][more] = where[s][more], at[more]
        s, item = np.nonzero(where >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(top[s, item]), pa.array(where[s, item])], names=["item", "bound", "block"])

    found = index.mapInArrow(run, "item long, bound long, block long")
    order = W.partitionBy("item").orderBy(F.desc("bound"), "block")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= seeds).select("item", "block").collect()


def _visit(index: DataFrame, asked, least, chosen, k: int) -> DataFrame:
    """Rows (item, doc_id, score): all of the k best documents of each item, and some more. ``chosen``: block -> items
    to score there, all others being left out; None visits every block whose bound reaches ``least``."""
    kind = index.schema["docs"].dataType.elementType.simpleString()

    def run(batches):
        ask, only = asked.value, chosen.value if chosen else None
        floor = least.value.copy() if least else np.ones(len(ask.first) - 1, dtype=np.int64)
        held = [np.zeros(0, dtype=np.int64) for _ in floor]
        for batch in batches:
            number = batch.column("block").to_numpy()
            blocks = [Block(batch, i, ask) for i in range(batch.num_rows) if only is None or int(number[i]) in only]
            if not blocks:
                continue
            numbers = [int(n) for n in number if only is None or int(n) in only]
            bounds = np.stack([b.bounds for b in blocks])
            for item in range(len(floor)):
                scores, docs = [], []
                for i in np.argsort(-bounds[:, item], kind="stable"):
                    if bounds[i, item] < floor[item]:
                        break
                    if only is not None and item not in only[numbers[i]]:
                        continue
                    score, doc = blocks[i].best(item, ask, floor[item], k)
                    scores.append(score)
                    docs.append(doc)
                    held[item] = np.sort(np.r_[held[item], score])[-k:]
                    if len(held[item]) == k:
                        floor[item] = max(floor[item], held[item][0])
                if scores and sum(map(len, scores)):
                    score, doc = np.concatenate(scores), pa.concat_arrays(docs)
                    good = np.flatnonzero(score >= floor[item])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(good), item)), doc.take(pa.array(good)), pa.array(score[good])], names=["item", "doc_id", "score"])

    return index.mapInArrow(run, f"item long, doc_id {kind}, score long")


def _round(docs: DataFrame, rows: list, kind: T.DataType, plan: Search) -> DataFrame | None:
    """Rows (item_id, rank, doc_id, score) for the items of ``rows`` (item_id, term)."""
    spark = docs.sparkSession
    words = sorted({bytes(r["term"]) for r in rows})
    vocabulary = {w: i for i, w in enumerate(words)}
    ids = list({r["item_id"]: None for r in rows})
    number = {item: i for i, item in enumerate(ids)}
    pairs = np.array(sorted((number[r["item_id"]], vocabulary[bytes(r["term"])]) for r in rows), dtype=np.int64)
    vectors = stored(_vectors(docs, vocabulary))
    n, length = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n:
        return None
    normaliser = F.expr(f"10L + (90L * n * {n}L) div {length}L")
    index = stored(build_index(vectors.where(F.size("terms") > 0).withColumn("m", normaliser), n, plan))
    df = np.zeros(len(words), dtype=np.int64)
    sizes = F.zip_with(F.slice("start", F.lit(1), F.size("term")), F.slice("start", F.lit(2), F.size("term")), lambda a, b: b - a)
    held = index.select(F.explode(F.arrays_zip("term", sizes.alias("n"))).alias("p")).groupBy("p.term").agg(F.sum("p.n").alias("df"))
    for r in held.collect():
        df[r["term"]] = r["df"]
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
    first = np.r_[np.searchsorted(pairs[:, 0], np.arange(len(ids))), len(pairs)]
    share = spark.sparkContext.broadcast
    asked = share(Asked(first, pairs[:, 1], weight))
    chosen: dict[int, set[int]] = {}
    for item, block in _best_blocks(index, asked, len(ids), plan.seeds):
        chosen.setdefault(block, set()).add(item)
    best = W.partitionBy("item").orderBy(F.desc("score"))
    seeds = _visit(index.where(F.col("block").isin(list(chosen))), asked, None, share(chosen), plan.k)
    least = np.ones(len(ids), dtype=np.int64)
    for r in seeds.withColumn("_r", F.row_number().over(best)).where(F.col("_r") == plan.k).select("item", "score").collect():
        least[r["item"]] = r["score"]
    named = spark.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", kind)]))
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id"))
    found = _visit(index, asked, share(least), None, plan.k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= plan.k)
    return found.join(named, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, plan: Search = Search()) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank (from 1), doc_id, score.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are not read. Terms, weights and scores are
    those of the registered query. Every row of ``docs`` is a document of its own, so a repeated row may stand twice in a
    result, in ranks of its own; rows of ``items`` that share an item_id, null included, make up one item with the terms
    of all. Items without a term, and terms that no document has, give nothing; neither do null and empty texts. Equal
    scores go by ascending doc_id, a null doc_id first. Empty tables give an empty result.

    Memory: items are asked ``item_terms`` distinct (item, term) pairs at a time, dealt by a hash of the item, so what the
    driver and the broadcasts hold is bounded by that parameter or by one item; a task holds one batch of blocks.
    """
    kind = items.schema["item_id"].dataType
    pairs = stored(_item_terms(items))
    rounds = -(-pairs.count() // plan.item_terms)
    out = None
    for r in range(rounds):
        rows = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == r).collect()
        found = _round(small_batches(docs), rows, kind, plan) if rows else None
        if found is not None:
            out = found if out is None else out.union(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], T.StructType([
            T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()),
            T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.LongType())]))
    return out
