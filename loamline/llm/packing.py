"""Best-fit packing of documents into fixed-length sequences, with conflicts.

Two pieces conflict if they share a source or a duplicate cluster (here: the same text), so no sequence holds two of
one source or two copies of one text. A document longer than the capacity is cut into pieces; none is left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loamline.llm.numbering import number_rows
from loamline.llm.sharding import Feistel
from loamline.llm.shared import stored

WORD = r"[^\x20\x09-\x0D]+"
BLANK = "\x20\x09\x0A\x0B\x0C\x0D"


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 without one. Each word and the blanks behind it become one character of a new text:
    ``regexp_count`` would hold every word of a text as an object of its own until the last is found."""
    marks = F.regexp_replace(F.ltrim(text, F.lit(BLANK)), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit("x"))
    return F.coalesce(F.char_length(marks), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Packing:
    """``capacity``: words of a sequence. ``group``: pieces that are packed together in one task."""

    capacity: int = 2048
    group: int = 4096
    seed: int = 5


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """Bin of each item (size, source bit, cluster bit; -1: conflicts with nothing), in the given order.

    Open bins are ordered by residual: a bitmap marks the residuals that some bin has, so the successor of a size is
    its lowest bit from there on. Each bin carries a bitmap of its sources and one of its clusters; the search goes on
    to the next bin, and the next residual, until neither is marked. Of equal residuals the oldest bin is taken.
    """
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    marks, sources, clusters, out = 0, [], [], []
    for size, source, cluster in items:
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        rest, found, at = marks >> size, -1, size
        while rest:
            step = (rest & -rest).bit_length() - 1
            at += step
            found = next((b for b in open_[at] if not sources[b] & s and not clusters[b] & c), -1)
            if found >= 0:
                break
            rest >>= step + 1
            at += 1
        if found < 0:
            found, at = len(sources), capacity
            sources.append(0)
            clusters.append(0)
        else:
            open_[at].remove(found)
            if not open_[at]:
                marks &= ~(1 << at)
        sources[found] |= s
        clusters[found] |= c
        out.append(found)
        left = at - size
        if left:
            held = open_[left]
            held.insert(next((i for i, b in enumerate(held) if b > found), len(held)), found)
            marks |= 1 << left
    return out


def pieces(docs: DataFrame, size: Column, plan: Packing) -> DataFrame:
    """Rows (doc_id, source, cluster, piece, start, length): each document cut at multiples of the capacity. A document
    without words is one piece of length 0."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        F.xxhash64("text").alias("cluster"), size.cast("long").alias("_size"))
    last = F.greatest(F.lit(0), F.call_function("div", F.col("_size") - 1, F.lit(plan.capacity)))
    cut = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    start = F.col("piece") * plan.capacity
    return cut.select("doc_id", "source", "cluster", "piece", start.alias("start"), F.least(
        F.col("_size") - start, F.lit(plan.capacity).cast("long")).alias("length"))


PACKED = "doc_id long, source string, cluster long, piece long, start long, length long, bin long, place long"


def pack(docs: DataFrame, plan: Packing = Packing()) -> DataFrame:
    """Rows (doc_id, source, cluster, piece, start, length, bin, place): every piece with its sequence ``bin`` and the
    word ``place`` at which it stands there. Bins hold no gaps and no more than ``capacity`` words.

    Pieces are dealt at random into groups of about ``group`` by a permutation of their row numbers, so that a hot
    source, or copies of one text, spread over all groups evenly; each group is packed on its own, largest piece first. Null
    and empty texts are one piece of length 0 with null bin and place. A null source conflicts with nothing.
    """
    # Stored, so that the texts are read and their words counted once.
    cut = stored(pieces(docs, word_count(F.col("text")), plan))
    rows = cut.where("length > 0").count()
    groups = max(1, -(-rows // plan.group))
    numbered = number_rows(cut.where("length > 0"), rows, "_row")
    dealt = numbered.withColumn("_group", Feistel(rows, plan.seed).forward(F.col("_row")) % groups)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        table = table.sort_by([("length", "descending"), *((c, "ascending") for c in ("doc_id", "source", "cluster", "piece", "_row"))])
        source, cluster = table.column("source").to_pylist(), table.column("cluster").to_pylist()
        length = table.column("length").to_pylist()
        of = {x: i for i, x in enumerate(dict.fromkeys(x for x in source if x is not None))}
        seen: dict[int, int] = {}
        for x in cluster:
            seen[x] = seen.get(x, 0) + 1
        bit = {x: i for i, x in enumerate(x for x, n in seen.items() if n > 1)}
        bins = best_fit([(n, of.get(s, -1), bit.get(c, -1)) for n, s, c in zip(length, source, cluster)], plan.capacity)
        filled: dict[int, int] = {}
        place = []
        for b, n in zip(bins, length):
            place.append(filled.get(b, 0))
            filled[b] = place[-1] + n
        return pa.table({**{c: table.column(c) for c in ("doc_id", "source", "cluster", "piece", "start", "length")},
                         "bin": pa.array([b * groups + group for b in bins], pa.int64()), "place": pa.array(place, pa.int64())})

    packed = dealt.groupBy("_group").applyInArrow(run, PACKED)
    return packed.union(cut.where("length = 0").withColumns({"bin": F.lit(None).cast("long"), "place": F.lit(None).cast("long")}))


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: bin, n_words, n_pieces and its parts (place, doc_id, start, length) in order."""
    parts = F.array_sort(F.collect_list(F.struct("place", "doc_id", "start", "length")))
    return packed.where("bin is not null").groupBy("bin").agg(
        F.sum("length").alias("n_words"), F.count("*").alias("n_pieces"), parts.alias("parts"))
