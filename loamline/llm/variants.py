"""Spelling variants of words, by asymmetric q-chunks.

Two words are near if one inserted, deleted or replaced code point turns one into the other. Of a pair, the word that is
no longer contributes two disjoint chunks, each of half its length; the other one contributes positional grams of that
length. One edit touches one chunk at most, so the other chunk stands in the partner as a gram: the first at the same
place, the second at the same place if a code point was replaced, and one further on if one was inserted before it. The
join is therefore an equality of length, kind of edit, chunk number and gram, with the second chunk shifted by one where
the partner is longer; grams at places that no chunk can reach are not emitted. The edit distance verifies each pair.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loamline.llm.shared import small_batches, stored

LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
PART = 1 << 20
OUTSIDE = re.compile(r"[^A-Za-zÀ-ÿ]")


@dataclass(frozen=True)
class Spelling:
    """``least``: code points of a word at least; ``seen``: occurrences at least; ``ratio``: a form occurs this many times as
    often as its variant at least."""

    least: int = 7
    seen: int = 2
    ratio: int = 10


def _parts(text: str) -> Iterator[str]:
    """A text in parts of about a million characters that end between runs of letters."""
    at = 0
    while len(text) - at > PART:
        end = OUTSIDE.search(text, at + PART)
        if end is None:
            break
        yield text[at:end.start()]
        at = end.start()
    yield text[at:] if at else text


def word_counts(docs: DataFrame, plan: Spelling = Spelling(), slip: int | None = None) -> DataFrame:
    """Rows (word, n): the runs of letters A-Z, a-z and U+00C0 to U+00FF of all whole texts, only A-Z lower-cased, of at
    least ``least`` code points, with their occurrences, at least ``seen``.

    With ``slip``, runs lose a letter by a fixed rule: where ``slip`` divides h, the unsigned crc32 of the doc_id, a colon
    and the lower-cased run, the code point h % length goes, before lengths are looked at. A null doc_id is empty there. Null
    texts have no words. Counts are added up per batch before the shuffle, so a frequent word is a row per batch.
    """
    run_of = re.compile(f"[a-zÀ-ÿ]{{{plan.least},}}").findall

    def run(batches):
        for batch in batches:
            counts = Counter()
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for doc, text in zip(ids, texts):
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for part in _parts((text or b"").translate(LOWER).decode()):
                    found = run_of(part)
                    if slip is None:
                        counts.update(found)
                        continue
                    for word, n in Counter(found).items():
                        h = zlib.crc32(word.encode(), start)
                        if h % slip == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < plan.least:
                                continue
                        counts[word] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = small_batches(docs).select("doc_id", "text").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= plan.seen)


def near_pairs(words: DataFrame) -> DataFrame:
    """Rows (a, n_a, b, n_b): each unordered pair of near words once, b the longer one, or the later one of equal length.

    A pair that both chunks find belongs to the first. ``words``: word (distinct) and n; a word of one code point has no
    chunk and is near nothing.
    """
    sized = words.select("word", "n", F.char_length("word").alias("len")).where("len > 1")
    half = F.floor(F.col("len") / 2).cast("int")
    piece = lambda at, size: F.substring(F.col("word"), at + 1, size)
    key = lambda grown, number, at, size: F.struct(F.lit(grown).alias("grown"), F.lit(number).alias("number"), piece(at, size).alias("gram"))
    zero = F.lit(0)
    chunks = sized.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("len"), F.explode(F.array(
        key(0, 0, zero, half), key(0, 1, half, half), key(1, 0, zero, half), key(1, 1, half, half))).alias("k")).select("a", "n_a", "len", "k.*")
    short = F.floor((F.col("len") - 1) / 2).cast("int")
    grams = sized.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("len"), F.explode(F.array(
        key(0, 0, zero, half), key(0, 1, half, half), key(1, 0, zero, short), key(1, 1, short + 1, short))).alias("k")).select(
            "b", "n_b", (F.col("len") - F.col("k.grown")).alias("len"), "k.*")
    q = F.floor(F.col("len") / 2).cast("int")
    one = lambda c: F.substring(F.col(c), F.lit(1), q)
    once = (F.col("number") == 0) | (one("a") != one("b"))
    ordered = (F.col("grown") == 1) | (F.col("a") < F.col("b"))
    found = chunks.join(grams, ["len", "grown", "number", "gram"]).where(ordered & once & (F.levenshtein("a", "b", 1) == 1))
    return found.select("a", "n_a", "b", "n_b")


def variants(words: DataFrame, plan: Spelling = Spelling()) -> DataFrame:
    """``words`` (word, n) with n_near (near words), form, form_n and root.

    The form is the near word of largest n, the smallest in code-point order among equals, if it occurs at least ``ratio``
    times as often, else null; the root is the end of the chain of forms, or the word itself. Forms grow by ``ratio`` a
    step, so a chain is shorter than the logarithm of the largest n, and following pointers of pointers takes the
    logarithm of that in rounds. Each round is written to the shared folder.
    """
    words = stored(words)
    pairs = stored(near_pairs(words))
    both = pairs.union(pairs.select("b", "n_b", "a", "n_a")).toDF("word", "n", "near", "m")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("best"))
    good = -F.col("best.less") >= plan.ratio * F.col("n")
    known = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.near")).alias("form"),
        F.when(good, -F.col("best.less")).alias("form_n")))
    links = known.where("form is not null").select("word", F.col("form").alias("root"))
    longest = words.agg(F.max("n")).first()[0] or 1
    steps = 0
    while plan.ratio ** (steps + 1) <= longest:
        steps += 1
    for _ in range(max(0, steps - 1).bit_length()):
        beyond = links.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        links = stored(links.join(beyond, "root", "left").select("word", F.coalesce("_further", "root").alias("root")))
    return known.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame, plan: Spelling = Spelling(), slip: int | None = None) -> DataFrame:
    """The words of ``docs`` (doc_id, text) with their near words' number, form and root: see ``word_counts`` and ``variants``.

    Repeated rows count as often as they stand; extra columns are not read; an empty table gives no row.
    """
    if plan.ratio < 2:
        raise ValueError("ratio must be 2 or more, so that chains of forms end")
    return variants(word_counts(docs, plan, slip), plan)
