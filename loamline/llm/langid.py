"""Language identification by bit-sliced Bloom filters of character n-grams.

One filter serves all languages: each slot holds a bit per language, so reading an n-gram's slots and AND-ing them
gives the languages that contain it. A text's hits per language are popcounts of these answers; the hits that false
positives alone would give are taken off before the languages are compared.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from loamline.llm.shared import listed, small_batches, stored
from loamline.llm.words import chunks, mix, to_bytes


@dataclass(frozen=True)
class Filters:
    """``slots`` bounds the model (8 bytes per slot and 64 languages); an n-gram belongs to a language if it makes up at
    least ``share`` of the rate it has in the language where it is most frequent and is seen ``seen`` times there."""

    slots: int = 1 << 20
    hashes: int = 3
    share: float = 0.3
    seen: int = 3


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray
    false: np.ndarray
    common: str


def letters(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """4-grams of bytes as numbers, and the text each comes from. A-Z count as a-z; ASCII bytes other than letters are
    blanks; n-grams with a blank in the middle or of blanks at both ends carry little and are left out."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]).lower(), dtype=np.uint8)
    letter = (data >= 128) | ((data >= 97) & (data <= 122))
    clean = np.where(letter, data, 32).astype(np.uint32)
    if len(clean) < 4:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    gram = clean[:-3] << 24 | clean[1:-2] << 16 | clean[2:-1] << 8 | clean[3:]
    good = letter[1:-2] & letter[2:-1]
    at = np.flatnonzero(good)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    return gram[at], np.searchsorted(ends, at, side="right")


def places(grams: np.ndarray, plan: Filters) -> np.ndarray:
    """Slots of each n-gram, one row per hash function."""
    h = mix(grams.astype(np.uint64))
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return np.stack([((low + np.uint64(i) * high) % np.uint64(plan.slots)).astype(np.int64) for i in range(plan.hashes)])


def gram_counts(docs: DataFrame) -> DataFrame:
    """Rows (lang, gram, n): n-gram counts of all labelled texts, counted per task before the shuffle."""

    def run(batches):
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), to_bytes(batch.column(1))
            own: dict[str, list[bytes]] = {}
            for lang, text in zip(langs, texts):
                own.setdefault(lang, []).append(text)
            for lang, group in own.items():
                for begin, end in chunks(group, 2 << 20):
                    gram, n = np.unique(letters(group[begin:end])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))],
                        names=["lang", "gram", "n"])

    found = small_batches(docs).where("lang is not null and text is not null").select("lang", "text")
    return found.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, plan: Filters = Filters()) -> Model:
    """Fit on every row of ``docs`` (text, lang) with a language. What reaches the driver is bounded by the number of
    slots, not by the corpus: one mask per slot, and a row per language."""
    spark = docs.sparkSession
    sizes = {r["lang"]: r["n"] for r in docs.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), np.zeros((1, 1), dtype=np.uint64), np.zeros(0), "und")
    words = -(-len(languages) // 64)
    number = listed(spark, [(lang, i // 64, 1 << (i % 64) if i % 64 < 63 else -(1 << 63)) for i, lang in enumerate(languages)],
                    pa.schema([("lang", pa.string()), ("word", pa.int32()), ("bit", pa.int64())]))
    counts = stored(gram_counts(docs))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))
    best = rates.groupBy("gram").agg(F.max("rate").alias("best"), F.collect_list(F.struct("lang", "n", "rate")).alias("all"))
    kept = best.select("gram", "best", F.explode("all").alias("x")).select("gram", "best", "x.*").where(
        (F.col("n") >= plan.seen) & (F.col("rate") >= plan.share * F.col("best"))).join(F.broadcast(number), "lang")

    def slots(batches):
        for batch in batches:
            at = places(batch.column(0).to_numpy(), plan)
            for row in at:
                yield pa.RecordBatch.from_arrays([pa.array(row), batch.column(1), batch.column(2)], names=["slot", "word", "bit"])

    masks = kept.select("gram", "word", "bit").mapInArrow(slots, "slot long, word int, bit long").groupBy("slot", "word").agg(
        F.bit_or("bit").alias("mask")).toArrow()
    table = np.zeros((plan.slots, words), dtype=np.uint64)
    table[masks.column("slot").to_numpy(), masks.column("word").to_numpy()] = masks.column("mask").to_numpy().view(np.uint64)
    filled = np.array([np.count_nonzero(table[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(languages))])
    common = min(languages, key=lambda lang: (-sizes[lang], lang))
    return Model(languages, table, (filled / plan.slots) ** plan.hashes, common)


def hits(gram: np.ndarray, owner: np.ndarray, texts: int, model: Model, plan: Filters) -> tuple[np.ndarray, np.ndarray]:
    """Per text: n-grams, and hits per language."""
    at = places(gram, plan)
    answer = model.table[at[0]]
    for row in at[1:]:
        answer = answer & model.table[row]
    total = np.bincount(owner, minlength=texts).astype(float)
    found = np.zeros((texts, len(model.languages)))
    for i in range(len(model.languages)):
        bit = (answer[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(float)
        found[:, i] = np.bincount(owner, weights=bit, minlength=texts)
    return total, found


def predict(docs: DataFrame, model: Model, plan: Filters = Filters()) -> DataFrame:
    """All columns of ``docs`` but its own lang_pred, score and lang_share, with lang_pred, score and lang_share (0 to 1).

    lang_share is the winner's share of corrected hits, above 0 for a tie too, whose score is 0. lang_pred is the language with the largest share of corrected hits, equal ones by name; score is that share scaled
    by the lead over the runner-up. A null text, one without a letter, and any text if no language was learned give
    `und` and 0; a text without any hit gives the most frequent language and 0.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "lang_share")]
    at = keep.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decide(texts: list[bytes | None]) -> tuple[list[str], list[float], list[float]]:
        m, langs, scores, shares = shared.value, [], [], []
        plain = [t or b"" for t in texts]
        for begin, end in chunks(plain):
            total, found = hits(*letters(plain[begin:end]), end - begin, m, plan) if m.languages else (np.zeros(end - begin), None)
            for i in range(end - begin):
                if not m.languages or not any(c.isalpha() for c in plain[begin + i].decode("utf-8", "replace")):
                    langs.append("und")
                    scores.append(0.0)
                    shares.append(0.0)
                    continue
                right = np.maximum(0, (found[i] - total[i] * m.false) / np.maximum(1e-9, 1 - m.false)) / max(1.0, total[i])
                best = int(right.argmax())
                second = float(np.delete(right, best).max(initial=0.0))
                langs.append(m.languages[best] if right[best] > 0 else m.common)
                scores.append(float(min(1.0, right[best]) * (right[best] - second) / right[best]) if right[best] > 0 else 0.0)
                shares.append(float(min(1.0, right[best])))
        return langs, scores, shares

    def run(batches):
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            langs, scores, shares = decide(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.float64())],
                                             names=[*keep, "lang_pred", "score", "lang_share"])

    out = T.StructType([*docs.select(*keep).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                        T.StructField("lang_share", T.DoubleType())])
    return small_batches(docs).select(*keep).mapInArrow(run, out)


def identify(docs: DataFrame, plan: Filters = Filters()) -> DataFrame:
    """Learn from the rows whose crc32(doc_id as text) mod 4 is not 2 and predict all; adds held_out."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    model = learn(docs.where(~held).select("text", "lang"), plan)
    return predict(docs.withColumn("held_out", held), model, plan)
