"""Brown class n-grams: exchange clustering, class transitions and word emissions.

The probability of a text is the product over its tokens of P(class | class before) * P(word | class). Every word of the
training texts gets its class from exchange clustering on the counts of all bigrams: the driver clusters the most
frequent words one by one, which gives the classes a shape, and sweeps on Spark then move all words, each against the
matrix of class bigrams. Only words that training never saw go by their shape (last byte and whether it has bytes beyond
ASCII); words seen once tell how likely these are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loamline.llm.shared import new_folder, small_batches, stored
from loamline.llm.words import Words, chunks, signed, to_bytes

SHAPES = 10


@dataclass(frozen=True)
class ClassModel:
    """``clustered``: words that the driver clusters to begin with. ``classes``: classes of all words. ``sweeps``: sweeps at
    most, on the driver and on Spark. ``near``: words whose counts and classes every task holds; those of rarer words are
    kept in buckets of about ``bucket`` words of text. ``add``: smoothing of unseen words, ``back``: weight of the class unigram
    in transitions."""

    clustered: int = 2048
    classes: int = 64
    sweeps: int = 6
    near: int = 1 << 18
    bucket: int = 1 << 20
    add: float = 0.5
    back: float = 5.0


def shapes(words: Words) -> np.ndarray:
    """0 to 9: whether a word has a byte beyond ASCII, and if it ends in a letter, digit, full stop, comma or another byte."""
    last = words.data[np.maximum(words.ends - 1, 0)]
    kind = np.full(256, 4)
    kind[97:123], kind[128:], kind[48:58], kind[46], kind[44] = 0, 0, 1, 2, 3
    wide = np.concatenate([[0], np.cumsum(words.data >= 128)])
    return kind[last] + 5 * (wide[words.ends] > wide[words.starts])


def word_counts(docs: DataFrame) -> DataFrame:
    """Rows (word, shape, n): counts of all words of ``docs`` (text) by hash, added up per task before the shuffle."""

    def run(batches):
        for batch in batches:
            texts = to_bytes(batch.column(0))
            for begin, end in chunks(texts, 2 << 20):
                words = Words(texts[begin:end], lower=True)
                word, at, n = np.unique(words.hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([signed(word), pa.array(shapes(words)[at].astype(np.int32)), pa.array(n.astype(np.int64))],
                                                 names=["word", "shape", "n"])

    return docs.select("text").mapInArrow(run, "word long, shape int, n long").groupBy("word", "shape").agg(F.sum("n").alias("n"))


def _ids(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place of each hash among the sorted ``known``; -1 for others."""
    if not len(known):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, -1)


def symbols(words: Words, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chunk as one row of symbols: each text's words and then its end. Symbols 0 to n - 1 are the known words, then
    come the shapes, then the end. Also the place of each word in this row."""
    ids = _ids(words.hashes, known)
    ids = np.where(ids >= 0, ids, len(known) + shapes(words)) if len(ids) else ids
    place = np.arange(len(ids)) + words.owners()
    row = np.full(len(ids) + len(words.first) - 1, len(known) + SHAPES)
    row[place] = ids
    return row, place


def bigrams(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """Rows (pair, n): counts of neighbouring symbols, the start of a text standing as an end."""
    size, shared = len(known) + SHAPES + 1, docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        total = np.zeros(size * size, dtype=np.int32)
        for batch in batches:
            texts = to_bytes(batch.column(0))
            for begin, end in chunks(texts, 2 << 20):
                row, _ = symbols(Words(texts[begin:end], lower=True), shared.value)
                pair = np.concatenate([[size - 1], row[:-1]]) * size + row
                cell, n = np.unique(pair, return_counts=True)
                total[cell] += n.astype(np.int32)
            full = np.flatnonzero(total > 1 << 30)
            if len(full):
                yield _cells(full, total[full])
                total[full] = 0
        found = np.flatnonzero(total)
        for begin in range(0, len(found), 1 << 16):
            yield _cells(found[begin:begin + (1 << 16)], total[found[begin:begin + (1 << 16)]])

    return docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _cells(at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(table: np.ndarray, movable: int, classes: int, sweeps: int) -> np.ndarray:
    """Class of each symbol. The first ``movable`` symbols start dealt out by rank and are moved, one after the other, to
    the class that gives the bigrams the highest likelihood; the others keep classes of their own behind these."""
    size = len(table)
    of = np.concatenate([np.arange(movable) % classes, classes + np.arange(size - movable)])
    total = classes + size - movable
    table = table.astype(np.float64)
    onto = np.zeros((size, total))
    np.add.at(onto.T, of, table.T)
    both = np.zeros((total, total))
    np.add.at(both, of, onto)
    came = np.zeros((total, size))
    np.add.at(came, of, table)
    for _ in range(sweeps):
        moved = 0
        for w in range(movable):
            old, self_ = of[w], table[w, w]
            right, left = onto[w].copy(), came[:, w].copy()
            right[old] -= self_
            left[old] -= self_
            # Take w out of its class.
            both[old] -= right
            both[:, old] -= left
            both[old, old] -= self_
            row, col = both.sum(axis=1), both.sum(axis=0)
            c = np.arange(classes)
            diagonal = both[c, c]
            gain = (_xlogx(both[:classes] + right) - _xlogx(both[:classes])).sum(axis=1) + (
                _xlogx(both[:, :classes] + left[:, None]) - _xlogx(both[:, :classes])).sum(axis=0)
            corner = _xlogx(diagonal + right[c] + left[c] + self_) - _xlogx(diagonal + right[c]) - _xlogx(diagonal + left[c]) + _xlogx(diagonal)
            out_n, in_n = right.sum() + self_, left.sum() + self_
            cost = _xlogx(row[c] + out_n) - _xlogx(row[c]) + _xlogx(col[c] + in_n) - _xlogx(col[c])
            value = gain + corner - cost
            new = int(value.argmax())
            if value[new] <= value[old] + 1e-9:
                new = old
            both[new] += right
            both[:, new] += left
            both[new, new] += self_
            if new != old:
                of[w], moved = new, moved + 1
                onto[:, old] -= table[:, w]
                onto[:, new] += table[:, w]
                came[old] -= table[w]
                came[new] += table[w]
        if not moved:
            break
    return of


@dataclass(frozen=True)
class Fitted:
    """``known``: sorted hashes of the words in ``near``, with their counts ``near_n`` and classes ``near_class``. ``rare``: rows
    (word, class, n) of all other words, ``state``: the same packed by bucket. ``step``: log10 of the transitions, the last class being the end. ``mass``: tokens
    per class; ``once``: words seen once per shape."""

    known: np.ndarray
    near_n: np.ndarray
    near_class: np.ndarray
    rare: DataFrame
    state: DataFrame
    buckets: int
    classes: int
    step: np.ndarray
    mass: np.ndarray
    once: np.ndarray
    tokens: int
    vocabulary: int
    texts: int


def least_count(counts: DataFrame, most: int) -> int:
    """A count that at most ``most`` words reach, from a histogram of counts in eighths of powers of two."""
    step = F.floor(F.log2("n") * 8).cast("int")
    rows = sorted(((r["s"], r["k"], r["low"]) for r in counts.groupBy(step.alias("s")).agg(
        F.count("*").alias("k"), F.min("n").alias("low")).collect()), reverse=True)
    least, words = 1 << 62, 0
    for _, k, low in rows:
        words += k
        if words > most:
            break
        least = low
    return least


ROWS = "bucket int, kind int, data binary"
HELD = 1 << 21


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 8-byte numbers as one compressed value: sorted ones as differences, all of them byte by byte."""
    head, planes = [len(arrays)], []
    for a in arrays:
        u = np.ascontiguousarray(a if a.dtype.itemsize == 8 else a.astype(np.int64)).view(np.uint64)
        up = bool((u[1:] >= u[:-1]).all())
        head += [len(u), up]
        planes.append(np.ascontiguousarray((np.diff(u, prepend=np.uint64(0)) if up else u).view(np.uint8).reshape(-1, 8).T).tobytes())
    raw = np.array(head, dtype=np.int64).tobytes() + b"".join(planes)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    head, flat, at, out = np.frombuffer(raw, np.int64, 2 * count, 8).reshape(-1, 2), np.frombuffer(raw, np.uint8), 8 + 16 * count, []
    for n, up in head.tolist():
        u = np.ascontiguousarray(flat[at:at + 8 * n].reshape(8, n).T).reshape(-1).view(np.uint64)
        out.append((np.cumsum(u, dtype=np.uint64) if up else u).view(np.int64))
        at += 8 * n
    return out


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes, so words sorted by hash are sorted by bucket."""
    return ((hashes.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _deal(kind: int, bucket: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """Rows (bucket, kind, data): the columns packed per bucket. ``bucket`` is sorted."""
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][:len(bucket)])
    ends = np.r_[cuts[1:], len(bucket)]
    return _packed(bucket[cuts], kind, [pack(*[c[i:j] for c in columns]) for i, j in zip(cuts, ends)])


def _packed(bucket, kind: int, data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(bucket, pa.int32()), pa.array([kind] * len(data), pa.int32()), pa.array(data, pa.binary())], names=["bucket", "kind", "data"])


def _sums(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of n of each."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _all(parts: list, columns: int) -> list[np.ndarray]:
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(columns)]


NEAR, FAR, STATE = range(3)


def neighbours(docs: DataFrame, known: np.ndarray, near_n: np.ndarray, buckets: int) -> DataFrame:
    """Rows (bucket, kind, data) of all bigrams. NEAR: pairs of words in ``known`` or ends (place len(known)), once each, with
    the rarer of the two, so that no word has more than its rank of them: (place * 2 + side) * (len(known) + 1) + other place,
    and n; side 0 says that the other stands behind, 1 before. FAR: pairs with a rarer word, with that word: its hash, side *
    (len(known) + 2) + other place, the other's hash if it is rarer too (its place then is len(known) + 1), and n."""
    size = len(known) + 1
    shared = docs.sparkSession.sparkContext.broadcast((known, np.append(near_n, 1 << 62)))

    def near_rows(parts):
        known, often = shared.value
        a, b, n = _all(parts, 3)
        own = (often[a] < often[b]) | ((often[a] == often[b]) & (a <= b))
        key, n = _sums((np.where(own, a, b) * 2 + ~own) * size + np.where(own, b, a), n)
        return _deal(NEAR, bucket_of(known[key // (2 * size)], buckets), key, n)

    def far_rows(parts):
        word, code, other, n = _all(parts, 4)
        order = np.lexsort([code, word.view(np.uint64)])
        word = word[order]
        return _deal(FAR, bucket_of(word, buckets), word, code[order], other[order], n[order])

    def run(batches):
        near, far, held = [], [], 0
        for batch in batches:
            texts = to_bytes(batch.column(0))
            for begin, end in chunks(texts, 2 << 20):
                words = Words(texts[begin:end], lower=True)
                if not len(words.hashes):
                    continue
                own, ids = np.unique(words.hashes, return_inverse=True)
                row = np.full(len(ids) + len(words.first) - 1, len(own))
                row[np.arange(len(ids)) + words.owners()] = ids
                pair, n = np.unique(np.concatenate([[len(own)], row[:-1]]) * (len(own) + 1) + row, return_counts=True)
                at = np.append(_ids(own, shared.value[0]), size - 1)
                word = np.append(own.view(np.int64), 0)
                x, y = pair // (len(own) + 1), pair % (len(own) + 1)
                plain = (at[x] >= 0) & (at[y] >= 0) & ~((x == len(own)) & (y == len(own)))
                near.append((at[x[plain]], at[y[plain]], n[plain]))
                for side, (u, v) in enumerate(((x, y), (y, x))):
                    rare = at[u] < 0
                    u, v = u[rare], v[rare]
                    far.append((word[u], side * (size + 1) + np.where(at[v] < 0, size, at[v]), np.where(at[v] < 0, word[v], 0), n[rare]))
                held += len(pair)
                if held > HELD:
                    yield near_rows(near)
                    yield far_rows(far)
                    near, far, held = [], [], 0
        if near:
            yield near_rows(near)
            yield far_rows(far)

    return docs.select("text").mapInArrow(run, ROWS)


def _rare_rows(rare: DataFrame, buckets: int) -> DataFrame:
    """``rare`` (word, class, n) as rows (bucket, STATE, data)."""

    def run(batches):
        parts, held = [], 0

        def rows():
            word, kind, n = _all(parts, 3)
            order = np.argsort(word.view(np.uint64))
            return _deal(STATE, bucket_of(word[order], buckets), word[order], kind[order], n[order])

        for batch in batches:
            parts.append([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])
            held += batch.num_rows
            if held > HELD:
                yield rows()
                parts, held = [], 0
        if parts:
            yield rows()

    return rare.select("word", "class", "n").mapInArrow(run, ROWS)


def _pairs(rows: DataFrame, near: int) -> DataFrame:
    """Bigrams of each bucket put together: NEAR rows, and a STATE row of its rarer words: their hashes, classes, counts, pairs with
    near words as (word * 2 + side) * (near + 1) + place and n, pairs among rarer words as word * 2 + side, the other's hash and n."""
    size = near + 1

    def run(key, table):
        parts = [[], [], []]
        for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist()):
            parts[kind].append(unpack(data))
        out = []
        if parts[NEAR]:
            out.append((NEAR, pack(*_sums(*_all(parts[NEAR], 2)))))
        if parts[STATE]:
            word, kind, n = _all(parts[STATE], 3)
            order = np.argsort(word.view(np.uint64))
            word, kind, n = word[order], kind[order], n[order]
            of, code, other, k = _all(parts[FAR], 4)
            idx = np.searchsorted(word.view(np.uint64), of.view(np.uint64))
            side, place = code // (size + 1), code % (size + 1)
            plain = place < size
            cells = _sums((idx[plain] * 2 + side[plain]) * size + place[plain], k[plain])
            out.append((STATE, pack(word, kind, n, *cells, (idx * 2 + side)[~plain], other[~plain], k[~plain])))
        return pa.table({"bucket": pa.array([key[0].as_py()] * len(out), pa.int32()), "kind": pa.array([x for x, _ in out], pa.int32()),
                         "data": pa.array([x for _, x in out], pa.binary())})

    return rows.groupBy("bucket").applyInArrow(run, ROWS)


def _cell_rows(pairs: DataFrame, known: np.ndarray, near_class: np.ndarray, total: int, buckets: int) -> DataFrame:
    """What each bucket needs to count its words by cell: side * total + class, and 2 * total more if the neighbour is a rarer word,
    whose gain is reckoned apart. NEAR: place * 4 * total + cell and n, added up per task. FAR: hash, cell and n of rarer words next to rarer words. STATE as it is."""
    size = len(known) + 1
    shared = pairs.sparkSession.sparkContext.broadcast((known, np.append(near_class, total - 1)))

    def run(batches):
        known, of = shared.value
        parts, held = [], 0

        def rows():
            return _deal(NEAR, bucket_of(known[parts[0][0] // (4 * total)], buckets), *parts[0])

        for batch in batches:
            for bucket, kind, data in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if kind == NEAR:
                    key, n = unpack(data)
                    own, side, place = key // (2 * size), key // size % 2, key % size
                    parts.append((own * (4 * total) + side * total + of[place], n))
                    kinds, apart = of[own], 0
                else:
                    _, own, _, key, n, at, other, k = unpack(data)
                    side, place, kinds, apart = key // size % 2, key % size, own[key // (2 * size)], 2 * total
                    order = np.argsort(other.view(np.uint64))
                    yield _deal(FAR, bucket_of(other[order], buckets), other[order], ((3 - at % 2) * total + own[at // 2])[order], k[order])
                    yield _packed([bucket], STATE, [data])
                word = place < size - 1
                parts.append((place[word] * (4 * total) + apart + (1 - side[word]) * total + kinds[word], n[word]))
                held += len(n) * 2
                if held > HELD:
                    parts = [_sums(*_all(parts, 2))]
                    held = len(parts[0][0])
                    if held > HELD // 2:
                        yield rows()
                        parts, held = [], 0
        if parts:
            parts = [_sums(*_all(parts, 2))]
            yield rows()

    return pairs.mapInArrow(run, ROWS)


def _counted(rows: DataFrame, near_class: np.ndarray, total: int) -> DataFrame:
    """Rows (bucket, cells, state): place * 4 * total + cell and n of the near words, the same by number of the rarer words."""
    size = len(near_class) + 1
    shared = rows.sparkSession.sparkContext.broadcast(np.append(near_class, total - 1))

    def run(key, table):
        parts, state = [[], []], None
        for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist()):
            if kind == STATE:
                state = data
            else:
                parts[kind].append(unpack(data))
        near, rare = _sums(*_all(parts[NEAR], 2)), [np.zeros(0, np.int64)] * 2
        if state:
            word, _, _, far, n, _, _, _ = unpack(state)
            of, cell, k = _all(parts[FAR], 3)
            idx = np.searchsorted(word.view(np.uint64), of.view(np.uint64))
            rare = _sums(np.concatenate([far // (2 * size) * (4 * total) + far // size % 2 * total + shared.value[far % size], idx * (4 * total) + cell]), np.concatenate([n, k]))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([pack(*near, *rare)], pa.binary()),
                         "state": pa.array([state], pa.binary())})

    return rows.groupBy("bucket").applyInArrow(run, "bucket int, cells binary, state binary")


def _entries(cells: bytes, state: bytes | None, near_class: np.ndarray, total: int):
    """Of near words and of rarer ones: places or numbers, classes, and owner (place in these), cell and count of each entry."""
    near, n, rare, k = unpack(cells)
    for key, n, kinds in ((near, n, near_class), (rare, k, unpack(state)[1] if state else None)):
        of = key // (4 * total)
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]][:len(of)])
        yield of[first], kinds[of[first]] if len(first) else of, np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(of)])), key % (2 * total), n.astype(np.float64)


def _matrix(counts: DataFrame, near_class: np.ndarray, total: int) -> np.ndarray:
    """Class bigrams of ``counts`` under the classes by which its cells were made."""
    shared = counts.sparkSession.sparkContext.broadcast(near_class)

    def run(batches):
        both = np.zeros(total * total, dtype=np.int64)
        for batch in batches:
            for cells, state in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for _, kind, owner, cell, n in _entries(cells, state, shared.value, total):
                    side, other, own = cell // total, cell % total, kind[owner]
                    # What stands before a word is counted where it is a word itself; only the end has no row of its own.
                    ahead, start = side == 0, (side == 1) & (other == total - 1)
                    both += np.bincount(own[ahead] * total + other[ahead], weights=n[ahead], minlength=total * total).astype(np.int64)
                    both += np.bincount((total - 1) * total + own[start], weights=n[start], minlength=total * total).astype(np.int64)
        at = np.flatnonzero(both)
        yield _cells(at, both[at])

    cells = counts.select("cells", "state").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    both = np.zeros(total * total)
    both[cells.column("pair").to_numpy()] = cells.column("n").to_numpy()
    return both.reshape(total, total)


def _moved(counts: DataFrame, near_class: np.ndarray, both: np.ndarray, classes: int) -> DataFrame:
    """Each word in the class that gives its bigrams the highest likelihood, all else as it stands: NEAR rows of places and
    classes, STATE rows."""
    shared, total = counts.sparkSession.sparkContext.broadcast(near_class), len(both)
    # Row side * total + other: the bigrams of each class with ``other`` behind it or before it.
    table = np.concatenate([both.T, both])
    sums = np.stack([both.sum(axis=1), both.sum(axis=0)])

    def change(have, n, own):
        """Gain of adding n to each class; the word's own class gets back what it has of it."""
        gain = _xlogx(have + n[:, None]) - _xlogx(have)
        at = np.flatnonzero(own < classes)
        held = have[at, own[at]]
        gain[at, own[at]] = _xlogx(held) - _xlogx(held - n[at])
        return gain

    def best(kinds, owners, cells, ns):
        out, bounds = kinds.copy(), np.searchsorted(owners, np.r_[np.arange(0, len(kinds), 256), len(kinds)])
        for i, (begin, end) in enumerate(zip(bounds[:-1], bounds[1:])):
            kind, owner, cell, n = kinds[i * 256:(i + 1) * 256], owners[begin:end] - i * 256, cells[begin:end], ns[begin:end]
            value = np.zeros((len(kind), classes))
            for low in range(0, len(cell), 1 << 14):
                own = owner[low:low + (1 << 14)]
                gain = change(table[cell[low:low + (1 << 14)], :classes], n[low:low + (1 << 14)], kind[own])
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                value[own[first]] += np.add.reduceat(gain, first, axis=0)
            for side in (0, 1):
                size = np.bincount(owner, weights=n * (cell // total == side), minlength=len(kind))
                value -= change(np.broadcast_to(sums[side, :classes], value.shape), size, kind)
            new, inside = value.argmax(axis=1), kind < classes
            rows = np.arange(len(kind))
            stay = inside & (value[rows, new] <= value[rows, np.minimum(kind, classes - 1)] + 1e-9)
            out[i * 256:(i + 1) * 256] = np.where(stay, kind, new)
        return out

    def run(batches):
        for batch in batches:
            for bucket, cells, state in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                near, rare = _entries(cells, state, shared.value, total)
                if len(near[0]):
                    yield _packed([bucket], NEAR, [pack(near[0], best(*near[1:]))])
                if state:
                    parts = unpack(state)
                    parts[1] = parts[1].copy()
                    parts[1][rare[0]] = best(*rare[1:])
                    yield _packed([bucket], STATE, [pack(*parts)])

    return counts.mapInArrow(run, ROWS)


def _likelihood(both: np.ndarray) -> float:
    return float(_xlogx(both).sum() - _xlogx(both.sum(axis=0)).sum() - _xlogx(both.sum(axis=1)).sum())


def exchange_all(docs: DataFrame, known: np.ndarray, near_n: np.ndarray, near_class: np.ndarray, rare: DataFrame, classes: int, sweeps: int,
                 buckets: int):
    """Sweeps over all words. ``near_class`` and ``rare`` (word, class, n) hold the classes to begin with, where those from
    ``classes`` on are shapes that no word keeps. Gives the near classes and the STATE rows anew, and the matrix of class
    bigrams. The tables of a sweep take the place of those that no later one reads."""
    total = classes + SHAPES + 1
    pairs = stored(_pairs(neighbours(docs, known, near_n, buckets).union(_rare_rows(rare, buckets)), len(known)))
    near, state = pairs.where(F.col("kind") == NEAR), pairs.where(F.col("kind") == STATE)
    folders, best = [new_folder(docs.sparkSession) for _ in range(3)], None
    for sweep in range(sweeps + 1):
        counts = stored(_counted(_cell_rows(near.union(state), known, near_class, total, buckets), near_class, total), folders[2])
        both = _matrix(counts, near_class, total)
        value = _likelihood(both)
        # The first sweep gives every word a class. Words move at the same time, so a later sweep may lose: it is taken back.
        if sweep > 1 and value <= best[0]:
            break
        if sweep:
            gained = best and value - best[0]
            best = (value, near_class, state, both)
            if gained is not None and gained < 1e-3 * abs(value):
                break
        if sweep < sweeps:
            moved = stored(_moved(counts, near_class, both, classes), folders[sweep % 2])
            near_class = near_class.copy()
            for data in moved.where(F.col("kind") == NEAR).select("data").toArrow().column("data").to_pylist():
                places, kinds = unpack(data)
                near_class[places] = kinds
            state = moved.where(F.col("kind") == STATE)
    return best[1:]


def rare_words(state: DataFrame) -> DataFrame:
    """Rows (word, class, n) of STATE rows."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                word, kind, n = unpack(data)[:3]
                for i in range(0, len(word), 1 << 16):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(word[i:i + (1 << 16)]), pa.array(kind[i:i + (1 << 16)].astype(np.int32)), pa.array(n[i:i + (1 << 16)])], names=["word", "class", "n"])

    return state.select("data").mapInArrow(run, "word long, class int, n long")


def fit(docs: DataFrame, counts: DataFrame, plan: ClassModel) -> Fitted:
    """Fit on ``docs`` (text) and its word counts. The driver holds the counts and classes of ``near`` words, the bigrams of
    ``clustered`` words and those of classes, none of which grows beyond the plan's sizes."""
    texts, least = docs.count(), least_count(counts, plan.near)
    top = counts.where(F.col("n") >= least).toArrow()
    word, n, shape = (top.column(c).to_numpy() for c in ("word", "n", "shape"))
    first = np.lexsort([word, -n])
    word, n, shape = word[first].view(np.uint64), n[first], shape[first].astype(np.int64)
    order = np.argsort(word[:plan.clustered])
    known = word[:plan.clustered][order]
    size = len(known) + SHAPES + 1
    cells = bigrams(docs, known).toArrow()
    table = np.zeros(size * size, dtype=np.int64)
    table[cells.column("pair").to_numpy()] = cells.column("n").to_numpy()
    table = table.reshape(size, size)
    by_rank = np.concatenate([order.argsort(), np.arange(len(known), size)])
    classes = min(plan.classes, max(1, len(known)))
    moved = exchange(table[np.ix_(by_rank, by_rank)], len(known), classes, plan.sweeps)
    total = classes + SHAPES + 1
    sort = np.argsort(word)
    near_class = np.concatenate([moved[:len(known)], classes + shape[plan.clustered:]])[sort]
    word, n = word[sort], n[sort].astype(np.int64)
    rare = counts.where(F.col("n") < least).select("word", (F.col("shape") + classes).alias("class"), "n")
    n_words = counts.agg(F.sum("n")).first()[0] or 0
    buckets = 1 + n_words // plan.bucket
    near_class, state, both = exchange_all(docs, word, n, near_class.astype(np.int64), rare, classes, plan.sweeps, buckets)
    rare = rare_words(state)
    sums = {r["shape"]: (r["n"], r["k"], r["once"]) for r in counts.groupBy("shape").agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.count_if(F.col("n") == 1).alias("once")).collect()}
    once, mass = np.zeros(SHAPES), np.bincount(near_class, weights=n, minlength=total)
    for s, (_, _, k) in sums.items():
        once[s] = k
    for r in rare.groupBy("class").agg(F.sum("n").alias("n")).collect():
        mass[r["class"]] += r["n"]
    tokens = int(sum(m for m, _, _ in sums.values())) + texts
    uni = both.sum(axis=0) + 1
    uni[classes:-1] = 0
    step = (both + plan.back * uni / uni.sum()) / (both.sum(axis=1, keepdims=True) + plan.back)
    # Words that training never saw come as often as words seen once did.
    unseen = (once + 1) / (tokens + once.sum() + SHAPES + 1)
    step *= 1 - unseen.sum()
    step[:, classes:-1] = unseen
    return Fitted(word, n, near_class.astype(np.int16), rare, state, buckets, classes, np.log10(step), mass, once, tokens,
                  int(sum(k for _, k, _ in sums.values())) + (texts > 0), texts)


def emission(n, kind, model: Fitted, plan: ClassModel):
    """log10 P(word | class). Seen words are all in classes; a shape counts the words seen once and has room for one unseen word."""
    once = model.once[np.clip(kind - model.classes, 0, SHAPES - 1)]
    unseen = plan.add / (once + plan.add * (once + 1))
    return np.log10(np.where(kind >= model.classes, unseen, n / np.maximum(model.mass[kind], 1e-300)))


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, before int, word long, kind int"
TEXT, BETWEEN, RUN = 3, 4, 5


def _near_scores(rows: DataFrame, model: Fitted, plan: ClassModel) -> DataFrame:
    """Rows (bucket, kind, data). TEXT: scores of texts without their rare words. BETWEEN: rare words by hash, with row, shape and the
    classes before and behind them, -1 for another rare word. RUN: a rare word before another by hash, its shape, row, the other
    and its shape."""
    fixed = (model.known, model.near_n, model.near_class.astype(np.int64), model.step, emission(model.near_n, model.near_class.astype(np.int64), model, plan),
             model.tokens, model.vocabulary, model.texts)
    shared, buckets = rows.sparkSession.sparkContext.broadcast(fixed), model.buckets

    def rare_rows(parts, kind, columns):
        parts = _all(parts, columns)
        order = np.argsort(parts[0].view(np.uint64), kind="stable")
        return _deal(kind, bucket_of(parts[0][order], buckets), *[x[order] for x in parts])

    def run(batches):
        known_words, near_n, near_class, step, near_emit, tokens, vocabulary, n_texts = shared.value
        floor = np.log10(tokens + vocabulary + 1)
        near_base = np.log10(near_n + 1) - floor
        end_base = np.log10((n_texts if vocabulary else 0) + 1) - floor
        between, runs, held = [], [], 0
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), to_bytes(batch.column(1))
            for begin, end in chunks(texts, 1 << 20):
                words = Words(texts[begin:end], lower=True)
                doc, out = (batch.column(i).slice(begin, end - begin) for i in (2, 3))
                count, owner, n, own_ids = end - begin, words.owners(), words.counts, ids[begin:end]
                at = _ids(words.hashes, known_words)
                near = at >= 0
                shape = shapes(words) if len(at) else at
                kind = np.where(near, near_class[np.maximum(at, 0)], -1 - shape) if len(known_words) else -1 - shape
                text_of = np.repeat(np.arange(count), n + 1)
                row, name = np.full(len(kind) + count, len(step) - 1), np.zeros(len(kind) + count, np.int64)
                place = np.arange(len(kind)) + owner
                row[place], name[place] = kind, words.hashes.view(np.int64)
                past, past_name = np.concatenate([[len(step) - 1], row[:-1]]), np.concatenate([[0], name[:-1]])
                plain = (row >= 0) & (past >= 0)
                total = lambda who, what: np.bincount(who, weights=what, minlength=count)
                own = owner[near]
                base = total(own, near_base[at[near]]) + end_base
                score = total(text_of[plain], step[past[plain], row[plain]]) + total(own, near_emit[at[near]])
                known = np.bincount(own, minlength=count) + (1 if n_texts else 0)
                rare = np.flatnonzero(row < 0)
                between.append((name[rare], own_ids[text_of[rare]], -1 - row[rare], np.maximum(past[rare], -1), np.maximum(row[rare + 1], -1)))
                pair = rare[past[rare] < 0]
                runs.append((past_name[pair], -1 - past[pair], own_ids[text_of[pair]], name[pair], -1 - row[pair]))
                held += len(rare)
                yield _packed([int(own_ids[0]) % buckets], TEXT, [pack(
                    own_ids, doc.fill_null(0).to_numpy(), doc.is_valid().to_numpy(zero_copy_only=False), out.to_numpy(zero_copy_only=False), n + 1,
                    known, base.astype(np.float64), score.astype(np.float64))])
                if held > HELD // 2:
                    yield rare_rows(between, BETWEEN, 5)
                    yield rare_rows(runs, RUN, 5)
                    between, runs, held = [], [], 0
        if between:
            yield rare_rows(between, BETWEEN, 5)
            yield rare_rows(runs, RUN, 5)

    return rows.mapInArrow(run, ROWS)


def _rare_scores(rows: DataFrame, model: Fitted, plan: ClassModel) -> DataFrame:
    """Of ``rows`` and the STATE rows: each text's own scores, those of its rare words by bucket, and one row for each step between
    rare words, with the class before it; ``kind`` is -1 - shape of the word it leads to. Other rows have a word of their own."""
    floor, classes, buckets = float(np.log10(model.tokens + model.vocabulary + 1)), model.classes, model.buckets
    step, mass = model.step, np.maximum(model.mass, 1e-300)
    unseen = emission(np.zeros(SHAPES), classes + np.arange(SHAPES), model, plan)

    def run(key, table):
        parts = [[] for _ in range(6)]
        for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist()):
            parts[kind].append(unpack(data))
        word, kinds, ns = [x[:3] for x in parts[STATE]][0] if parts[STATE] else [np.zeros(0, np.int64)] * 3

        def look(hashes, shape):
            at = _ids(hashes.view(np.uint64), word.view(np.uint64))
            if not len(word):
                return classes + shape, np.zeros(len(hashes), np.int64)
            return np.where(at >= 0, kinds[np.maximum(at, 0)], classes + shape), np.where(at >= 0, ns[np.maximum(at, 0)], 0)

        ids, doc, valid, out, tokens, known, base, score = _all(parts[TEXT], 8)
        hashes, row, shape, before, behind = _all(parts[BETWEEN], 5)
        c, n = look(hashes, shape)
        value = np.where(n > 0, np.log10(np.maximum(n, 1) / mass[c]), unseen[np.clip(c - classes, 0, SHAPES - 1)])
        value += np.where(before >= 0, step[before, c], 0) + np.where(behind >= 0, step[c, behind], 0)
        of, place = np.unique(row, return_inverse=True)
        total = lambda what: np.bincount(place, weights=what, minlength=len(of))
        first, first_shape, pair_row, second, second_shape = _all(parts[RUN], 5)
        a, _ = look(first, first_shape)
        texts, rest = len(ids), len(of) + len(a)
        here = np.arange(texts + rest) < texts
        column = lambda x, kind: pa.array(np.concatenate([x, np.zeros(rest, x.dtype)]), kind, mask=~here)
        row = np.concatenate([ids, of, pair_row])
        steps = np.arange(len(row)) < texts + len(of)
        return pa.table({
            "row": pa.array(row), "doc_id": pa.array(np.concatenate([doc, np.zeros(rest, np.int64)]), mask=~np.concatenate([valid > 0, np.zeros(rest, bool)])),
            "held_out": column(out > 0, pa.bool_()), "n_tokens": column(tokens, pa.int64()),
            "n_known": pa.array(np.concatenate([known, total(n > 0).astype(np.int64), np.zeros(len(a), np.int64)])),
            "base_score": pa.array(np.concatenate([base.view(np.float64), total(np.log10(n + 1) - floor), np.zeros(len(a))])),
            "score": pa.array(np.concatenate([score.view(np.float64), total(value), np.zeros(len(a))])),
            "before": pa.array(np.concatenate([np.zeros(texts + len(of), np.int64), a]), pa.int32(), mask=steps),
            "word": pa.array(np.concatenate([ids, of, second])),
            "kind": pa.array(np.concatenate([np.zeros(texts + len(of), np.int64), -1 - second_shape]), pa.int32(), mask=steps)})

    return rows.groupBy("bucket").applyInArrow(run, SCORED)


def _step_scores(steps: DataFrame, model: Fitted) -> DataFrame:
    """``steps`` with the scores of the steps from class ``a`` to ``b``."""
    step = model.step

    def run(batches):
        for batch in batches:
            here = batch.column(7).is_valid().to_numpy(zero_copy_only=False)
            a, b = (batch.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in (7, 8))
            yield pa.RecordBatch.from_arrays([
                *[batch.column(i) for i in range(6)], pa.array(batch.column(6).to_numpy() + np.where(here, step[a, b], 0))],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return steps.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score_texts(docs: DataFrame, training: Column, plan: ClassModel = ClassModel()) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity.

    Learns from the rows where ``training`` is true and scores all. A null text is empty and has its end only. Words are
    lower-cased (A-Z) and known by a 64-bit hash. Scores are log10; perplexity is per token. Without training rows every
    class is equally likely.
    """
    learned = small_batches(docs).where(training).select("text")
    counts = stored(word_counts(learned))
    model = fit(learned, counts, plan)
    base = docs.select("doc_id", "text", F.coalesce(training, F.lit(False)).alias("_t")).withColumn("_row", F.monotonically_increasing_id())
    parts = _near_scores(base.select("_row", "text", F.col("doc_id").cast("long"), (~F.col("_t")).alias("held_out")), model, plan)
    parts = _rare_scores(parts.union(model.state.select("bucket", "kind", "data")), model, plan)
    steps = parts.join(model.rare.select("word", F.col("class").alias("c")), "word", "left").select(
        "row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", F.col("before").alias("a"),
        F.when(F.col("kind") < 0, F.coalesce("c", F.lit(model.classes - 1) - F.col("kind"))).alias("b"))
    joined = _step_scores(steps, model)
    scored = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *[
        F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base_score", "score")])
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
