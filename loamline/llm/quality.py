"""Quality rules as a short-circuit cascade, with DataFrame functions only."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPACES = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``reject`` is true for rows to be rejected; null counts as false."""

    name: str
    reject: Column


@dataclass(frozen=True)
class Measured:
    """A rule with what the sample shows: seconds for 1000 rows and the share that it rejects."""

    rule: Rule
    cost: float
    rejects: float


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPLIT), lambda w: w != "")


def word_chars(text: Column) -> Column:
    return F.char_length(F.translate(text, SPACES, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def with_windows(df: DataFrame, words_column: str, width: int = 3, out: str = "n_repeat_words") -> DataFrame:
    """Adds ``out``: words in windows of ``width`` words that the row has twice or more, the first included.

    Windows are 64-bit hashes. Only rows in which a hash repeats, which a hash set shows in one pass, sort the hashes
    with their places; runs of equal hashes then give the places, and sorted places the words they cover.
    """
    w = F.col(words_column)
    n = F.size(w)
    hashed = F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(
        *[F.get(w, i + k) for k in range(width)]))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_h", hashed)
    repeats = F.size("_h") > F.size(F.array_distinct("_h"))
    pairs = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_p", F.when(repeats, pairs))
    m = F.size("_p")
    equal = lambda i, j: F.get("_p", i)["h"] == F.get("_p", j)["h"]
    hit = F.filter("_p", lambda p, i: ((i > 0) & equal(i, i - 1)) | ((i < m - 1) & equal(i, i + 1)))
    df = df.withColumn("_at", F.sort_array(F.transform(hit, lambda p: p["i"])))
    covered = F.aggregate(
        F.transform("_at", lambda x, i: F.least(F.lit(width), F.coalesce(F.get("_at", i + 1) - x, F.lit(width)))),
        F.lit(0).cast("long"), lambda acc, x: acc + x)
    return df.withColumn(out, F.coalesce(covered, F.lit(0)).cast("long")).drop("_h", "_p", "_at")


def sampled(df: DataFrame, rows: int = 2000, seed: int = 3) -> DataFrame:
    """At most ``rows`` rows from all over ``df``. The share follows from the count, so few rows more are shuffled."""
    return df.sample(fraction=min(1.0, 2 * rows / max(1, df.count())), seed=seed).limit(rows)


def measured(sample: DataFrame, rules: list[Rule]) -> list[Measured]:
    """Each rule on ``sample``, which decides the order of the rules alone, never a verdict."""
    sample = sample.persist()
    try:
        n = max(1, sample.count())
        found = []
        for rule in rules:
            hits = sample.agg(F.count(F.when(rule.reject, 1)).alias("n"))
            hits.collect()
            start = time.perf_counter()
            rejected = hits.first()["n"]
            found.append(Measured(rule, (time.perf_counter() - start) * 1000 / n, rejected / n))
        return found
    finally:
        sample.unpersist()


def ordered(found: list[Measured]) -> list[Rule]:
    """Most rejections per second first; rules that reject nothing in the sample come last, the cheap ones first."""
    return [m.rule for m in sorted(found, key=lambda m: (-m.rejects / max(m.cost, 1e-9), m.cost, m.rule.name))]


def cascade(df: DataFrame, rules: list[Rule], out: str = "rejected_by") -> DataFrame:
    """Adds ``out``: a rule that rejects the row, null if none does. A row that one rule rejects does not meet the next."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(F.coalesce(rule.reject, F.lit(False)), F.lit(rule.name)).otherwise(verdict)
    return df.withColumn(out, verdict)


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the whole text (null: empty).
    Columns of these names are replaced."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.withColumn("_words", words(text)).withColumns({
        "n_words": F.size("_words").cast("long"), "word_chars": word_chars(text), "n_symbols": n_symbols(text), "n_dup_lines": n_dup_lines(text)})
    return with_windows(base, "_words").drop("_words")


def prose_rules() -> list[Rule]:
    """Rules over the features and ``text``. The bounds leave prose alone in any language with spaces between words."""
    n, text = F.greatest(F.col("n_words"), F.lit(1)), F.coalesce(F.col("text"), F.lit(""))
    lines = F.size(F.split(text, "\n"))
    return [
        Rule("short", F.col("n_words") < 50),
        Rule("repeated_windows", 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        Rule("symbols", F.col("n_symbols") > 0.2 * n),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n)),
        Rule("duplicate_lines", (F.col("n_dup_lines") > 2) & (F.col("n_dup_lines") > 0.3 * lines)),
        Rule("few_letters", F.char_length(F.regexp_replace(text, r"[^\p{L}]+", "")) < 0.5 * F.col("word_chars")),
    ]


def judge(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with its features, rejected_by and kept; the rules run in the order that a sample finds cheapest.

    Null and empty texts have zero features and are rejected as short. Very long texts are read whole, repeated rows are
    judged one by one, an empty table stays empty.
    """
    order = ordered(measured(features(sampled(docs)), rules or prose_rules()))
    return cascade(features(docs), order).withColumn("kept", F.col("rejected_by").isNull())
