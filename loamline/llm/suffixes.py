"""Passages that repeat across documents, by a sparse suffix array.

Suffixes are kept only at content-selected positions: the smallest word 4-gram of every window of ``window`` word
positions, so equal passages keep equal suffixes. A passage of ``least`` words has its smallest suffix among its first
``window`` positions, so at least ``anchor`` = least - window + 1 words of that suffix lie inside it. Suffixes whose first
``anchor`` words occur in one document only are dropped, and with them every passage of ``least`` words that they stand for.

The other suffixes are sorted by their words and compared with their neighbours. A passage that begins l words before its
suffix takes least - l words of it, and suffixes that agree so far stand next to each other: the common prefix with the
neighbour ends or goes on with a run. Within a run the match is extended to the left, by a hash of the l words before the
suffix, for l from 0 to window - 1 at once, and each match gets the smallest document that has it.

Suffixes are dealt by their first ``anchor`` words, so a run is whole in one task. Where more than ``cell`` suffixes begin
alike they are dealt to several cells by a hash; each cell sorts and compares its own, and what the cells found is put
together by passage, one row per cell and passage.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from loamline.llm.shared import Scratch, small_batches, stored
from loamline.llm.words import Words, chunks, grams, mix, signed, to_bytes


@dataclass(frozen=True)
class Sparse:
    least: int = 50
    window: int = 16
    cell: int = 1 << 16

    @property
    def anchor(self) -> int:
        return self.least - self.window + 1

    @property
    def around(self) -> int:
        """Words kept before the suffix, and behind its anchor."""
        return self.window - 1


def smallest(words: Words, plan: Sparse) -> tuple[np.ndarray, np.ndarray]:
    """First words (among all words of the chunk) of the passages of ``least`` words, and the kept position of each."""
    h, w = words.hashes, plan.window
    order = grams(h, 4)
    span = len(h) - plan.least + 1
    if span <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    bits = np.uint64(max(24, int(len(h)).bit_length()))
    low = order >> bits << bits | np.arange(len(order), dtype=np.uint64)
    reach = 1
    while reach < w:
        step = min(reach, w - reach)
        low = np.minimum(low[:-step], low[step:])
        reach += step
    owner = words.owners()
    start = np.flatnonzero(owner[:span] == owner[plan.least - 1:])
    return start, (low[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def chosen(words: Words, plan: Sparse) -> tuple[np.ndarray, np.ndarray]:
    """Kept positions (among all words of the chunk) and the hash of the anchor words there."""
    at = np.unique(smallest(words, plan)[1])
    return at, grams(words.hashes, plan.anchor)[at] if len(at) else np.zeros(0, dtype=np.uint64)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc: doc_id with the lowest long for null; th tells apart texts that share a doc_id."""
    return docs.select(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).cast("long").alias("doc"), F.xxhash64("text").alias("th"), "text")


def anchors(keyed: DataFrame, plan: Sparse) -> DataFrame:
    """Rows (key, doc, th, pos): every kept suffix."""

    def run(batches):
        for batch in batches:
            doc, th, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), to_bytes(batch.column(2))
            for begin, end in chunks(texts):
                words = Words(texts[begin:end], lower=False)
                at, key = chosen(words, plan)
                own = np.searchsorted(words.first, at, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [signed(key), pa.array(doc[begin:end][own]), pa.array(th[begin:end][own]), pa.array((at - words.first[own]).astype(np.int32))],
                    names=["key", "doc", "th", "pos"])

    return keyed.mapInArrow(run, "key long, doc long, th long, pos int")


def _contexts(texts: DataFrame, plan: Sparse) -> DataFrame:
    """Rows (key, salt, right, left, reach, doc, th, pos): the suffixes at the positions ``at``, with 32 bits of each of the
    words behind the anchor and before the suffix. Bit l of reach: a passage of the text that has this suffix begins l words
    before it. salt: the cell of a key that has several, else -1. ``texts``: doc, th, text, at (pos, cells)."""
    n = plan.around

    def run(batches):
        for batch in batches:
            doc, th, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), to_bytes(batch.column(2))
            bounds, flat = batch.column(3).offsets.to_numpy().astype(np.int64), batch.column(3).values
            pos, cells = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy()
            for begin, end in chunks(texts):
                words = Words(texts[begin:end], lower=False)
                wanted = np.zeros(len(words.hashes), dtype=np.int64)
                listed = slice(bounds[begin], bounds[end])
                wanted[np.repeat(words.first[:-1], np.diff(bounds[begin:end + 1])) + pos[listed]] = cells[listed]
                start, low = smallest(words, plan)
                start, low = start[wanted[low] > 0], low[wanted[low] > 0]
                at, which = np.unique(low, return_inverse=True)
                if not len(at):
                    continue
                reach = np.bincount(which, weights=1 << (low - start)).astype(np.int32)
                short = np.concatenate([np.zeros(n, dtype=np.uint32), (words.hashes >> np.uint64(32)).astype(np.uint32), np.zeros(n, dtype=np.uint32)])
                step = np.arange(n)
                own = np.searchsorted(words.first, at, side="right") - 1
                place, text = at - words.first[own], th[begin:end][own]
                spread = mix(text.view(np.uint64) + place.astype(np.uint64)) % wanted[at].astype(np.uint64)
                yield pa.RecordBatch.from_arrays([
                    signed(grams(words.hashes, plan.anchor)[at]),
                    pa.array(np.where(wanted[at] > 1, spread.astype(np.int32), np.int32(-1))),
                    _packed(short[at[:, None] + n + plan.anchor + step]), _packed(short[at[:, None] + step]), pa.array(reach),
                    pa.array(doc[begin:end][own]), pa.array(text), pa.array(place.astype(np.int32))],
                    names=["key", "salt", "right", "left", "reach", "doc", "th", "pos"])

    return texts.select("doc", "th", "text", "at").mapInArrow(
        run, "key long, salt int, right binary, left binary, reach int, doc long, th long, pos int")


def _packed(rows: np.ndarray) -> pa.Array:
    """A binary value per row of 32-bit numbers."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1] * 4)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _unpacked(column: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(len(column), n)


NONE = np.int64((1 << 63) - 1)  # no document has a later one than itself, so it leads nothing
TIMES = np.uint64(0x9E3779B97F4A7C15)


def _compared(table: pa.Table, plan: Sparse) -> pa.RecordBatch:
    """Whole cells of sorted suffixes -> rows (passage, salt, doc, th, start, until, lead): the passages that begin at start to
    until have lead as smallest document. Passages of divided keys come one by one, with their hash and without a lead."""
    n = plan.around
    key, salt, reach, doc, th, pos = (table.column(c).to_numpy() for c in ("key", "salt", "reach", "doc", "th", "pos"))
    right, left = (_unpacked(table.column(c).combine_chunks(), n) for c in ("right", "left"))
    cut = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
    same = right[1:] == right[:-1]
    common = np.where(same.all(axis=1), n, same.argmin(axis=1))
    common[cut] = -1
    lead = np.full((len(key), n + 1), NONE)
    whole, opened = salt < 0, []
    behind = np.zeros((n + 1, len(key)), dtype=np.uint64)
    for k in range(n):
        behind[k + 1] = (behind[k] + right[:, k] + np.uint64(1)) * TIMES
    before = np.zeros(len(key), dtype=np.uint64)
    for back in range(n + 1):
        if back:
            before = (before + left[:, n - back] + np.uint64(1)) * TIMES
        has = (reach >> back & 1).astype(bool)
        rows = np.flatnonzero(has & whole)
        if len(rows):
            run = np.cumsum(np.r_[True, common < n - back]).astype(np.uint64)
            match = mix(mix(before[rows]) + run[rows])
            order = np.argsort(match)
            begin = np.flatnonzero(np.r_[True, np.diff(match[order]) != 0])
            docs = doc[rows[order]]
            least, most = np.minimum.reduceat(docs, begin), np.maximum.reduceat(docs, begin)
            lead[rows[order], back] = np.repeat(np.where(least < most, least, NONE), np.diff(np.r_[begin, len(rows)]))
        rows = np.flatnonzero(has & ~whole)
        if len(rows):
            passage = mix(mix(mix(before[rows]) + behind[n - back][rows]) + key[rows].view(np.uint64) + np.uint64(back))
            opened.append((passage.view(np.int64), rows, pos[rows] - back))
    # Neighbouring passages of a suffix mostly have the same lead: one row for all of them.
    found, edge = lead != NONE, lead[:, 1:] != lead[:, :-1]
    rim = np.ones((len(key), 1), dtype=bool)
    rows, near = np.nonzero(found & np.c_[rim, edge])
    far = np.nonzero(found & np.c_[edge, rim])[1]
    empty = np.zeros(0, dtype=np.int64)
    passage, split, place = (np.concatenate(p) for p in zip(*opened)) if opened else (empty, empty, empty)
    every = np.r_[rows, split].astype(np.int64)
    return pa.RecordBatch.from_arrays([
        pa.array(np.r_[np.zeros(len(rows), dtype=np.int64), passage]), pa.array(salt[every]), pa.array(doc[every]), pa.array(th[every]),
        pa.array(np.r_[pos[rows] - far, place].astype(np.int32)), pa.array(np.r_[pos[rows] - near, place].astype(np.int32)),
        pa.array(np.r_[lead[rows, near], np.full(len(split), NONE)])], names=["passage", "salt", "doc", "th", "start", "until", "lead"])


def _neighbours(suffixes: DataFrame, plan: Sparse) -> DataFrame:
    """What ``_compared`` finds in suffixes dealt by key and cell and sorted by their words. A task holds ``cell`` suffixes and
    the cell that it is in."""

    def run(batches):
        held, size, limit = [], 0, plan.cell
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < limit:
                continue
            table = pa.Table.from_batches(held)
            key, salt = table.column("key").to_numpy(), table.column("salt").to_numpy()
            last = int(np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])[-1])
            if last:
                yield _compared(table.slice(0, last), plan)
            held, size = table.slice(last).to_batches(), size - last
            limit = max(plan.cell, 2 * size)
        if size:
            yield _compared(pa.Table.from_batches(held), plan)

    dealt = suffixes.repartition("key", "salt").sortWithinPartitions("key", "salt", "right")
    return dealt.mapInArrow(run, "passage long, salt int, doc long, th long, start int, until int, lead long")


def matches(docs: DataFrame, plan: Sparse = Sparse()) -> DataFrame:
    """Rows (doc, th, start, until, lead): the passages of ``least`` words from the words start to until on are in more than
    one document, and lead is the smallest document that has them."""
    keyed = _keyed(small_batches(docs).where("text is not null"))
    scratch = Scratch()
    kept = scratch.stored(anchors(keyed, plan))
    cells = F.ceil(F.col("n") / plan.cell).cast("int").alias("cells")
    repeated = kept.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", cells)
    at = kept.join(repeated, "key").groupBy("doc", "th").agg(F.collect_set(F.struct("pos", "cells")).alias("at"))
    found = stored(_neighbours(_contexts(keyed.join(at, ["doc", "th"]), plan), plan))
    scratch.emptied()
    divided = found.where("salt >= 0")
    parts = stored(divided.groupBy("passage", "salt").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")))
    shared = parts.groupBy("passage").agg(F.min("lo").alias("lead"), F.max("hi").alias("_hi")).where("lead < _hi").drop("_hi")
    leads = parts.join(shared, "passage").select("passage", "salt", "lead")
    columns = ["doc", "th", "start", "until", "lead"]
    return found.where("salt < 0").select(*columns).unionByName(divided.drop("lead").join(leads, ["passage", "salt"]).select(*columns))


def _spans(found: DataFrame, plan: Sparse) -> DataFrame:
    """Rows (doc, th, start_word, end_word, later, lead): the passages ``found`` of each text, merged where they touch. later
    counts the words in passages that an earlier document has; lead is the smallest document of any passage."""
    least = plan.least

    def run(batches):
        for batch in batches:
            doc, th, every = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            bounds, flat = every.offsets.to_numpy(), every.values
            starts, untils, leads = (flat.field(k).to_numpy().astype(np.int64) for k in range(3))
            for i in range(batch.num_rows):
                # Rows that agree in doc_id and text give each passage once more.
                mine = slice(bounds[i], bounds[i + 1])
                size = untils[mine] - starts[mine] + 1
                each = np.repeat(starts[mine] - np.cumsum(size) + size, size) + np.arange(size.sum())
                start, first = np.unique(each, return_index=True)
                lead = np.repeat(leads[mine], size)[first]
                begin = np.flatnonzero(np.r_[True, np.diff(start) > least])
                early = start[lead < doc[i]]
                words = np.minimum(np.diff(np.r_[early, early[-1:] + least]), least)
                later = np.bincount(np.searchsorted(start[begin], early, side="right") - 1, weights=words, minlength=len(begin))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(begin), doc[i])), pa.array(np.full(len(begin), th[i])), pa.array(start[begin]),
                    pa.array(start[np.r_[begin[1:], len(start)] - 1] + least), pa.array(later.astype(np.int64)),
                    pa.array(np.minimum.reduceat(lead, begin))], names=["doc", "th", "start_word", "end_word", "later", "lead"])

    every = found.groupBy("doc", "th").agg(F.collect_list(F.struct("start", "until", "lead")).alias("every"))
    return every.mapInArrow(run, "doc long, th long, start_word long, end_word long, later long, lead long")


def repeated_spans(docs: DataFrame, plan: Sparse = Sparse()) -> DataFrame:
    """Per maximal repeated span of a document: doc_id, start_word, end_word (exclusive), n_words, n_later (words that a
    smaller doc_id has too, in ``least`` words in a row), first_doc_id (smallest document with ``least`` words of the span).

    A passage counts if two documents with different doc_id share at least ``least`` words in a row, case and all.
    Repeats inside one document do not count. Null and short texts give no row; rows that agree in doc_id and text count
    once. A null doc_id counts as one document before all others.
    """
    null = F.lit(-(1 << 63))
    named = lambda c: F.when(F.col(c) != null, F.col(c)).alias(c)
    return _spans(matches(docs, plan), plan).select(
        named("doc").alias("doc_id"), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"),
        F.col("later").alias("n_later"), named("lead").alias("first_doc_id"))


def drop_repeats(docs: DataFrame, plan: Sparse = Sparse()) -> DataFrame:
    """``docs`` with every passage of ``least`` words cut from all documents but the smallest doc_id that has it.

    The cut takes the passage's words and the white space behind them. A text of which nothing is left goes; other rows
    and all columns stay. A null text stays null.
    """
    spans = _spans(matches(docs, plan).where("lead < doc"), plan)
    cuts = spans.groupBy("doc", "th").agg(F.collect_list(F.struct(F.col("start_word").alias("first"), F.col("end_word").alias("last"))).alias("cuts"))
    keyed = docs.withColumns({"_doc": F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).cast("long"), "_th": F.xxhash64("text")})
    joined = keyed.join(cuts.withColumnsRenamed({"doc": "_doc", "th": "_th", "cuts": "_cuts"}), ["_doc", "_th"], "left")
    cut = joined.withColumn("text", F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(_without("text", "_cuts")))
    return cut.where(F.col("_cuts").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def _cut_texts(texts, cuts):
    out = []
    for text, spans in zip(texts.to_pylist(), cuts.to_pylist()):
        if text is None or spans is None:
            out.append(text)
            continue
        data = text.encode()
        words, pieces, at = Words([data], lower=False), [], 0
        starts = np.append(words.starts, len(data))
        for first, last in sorted((s["first"], s["last"]) for s in spans):
            begin, end = int(starts[first]), int(starts[last])
            if begin > at:
                pieces.append(data[at:begin])
            at = max(at, end)
        pieces.append(data[at:])
        out.append(b"".join(pieces).decode())
    return pa.array(out, pa.string())


# Declared nondeterministic, or the filter on its result is pushed below it with a second call: each text cut twice, and a
# second Python worker for every task.
_without = F.arrow_udf(_cut_texts, T.StringType()).asNondeterministic()
