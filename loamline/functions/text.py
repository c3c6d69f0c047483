"""Text, identifier and parsing expressions."""

from __future__ import annotations

import html
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loamline.functions.climate import col


def squeeze(c, cap: int | None = None) -> Column:
    """Collapse white space; ``cap`` is the stored length limit of the field."""
    out = F.trim(F.regexp_replace(col(c), r"\s+", " "))
    return F.substring(out, 1, cap) if cap else out


def compact(c) -> Column:
    return F.regexp_replace(col(c), r"\s+", "")


def district_key(c) -> Column:
    """Match key of a district name: the Thai prefix and all white space removed."""
    return compact(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"^(?:อำเภอ|อ\.)\s*", ""))


@F.pandas_udf(StringType())
def unicode_text(c: pd.Series) -> pd.Series:
    """Entity unescape and compatibility normalisation, which have no built-in form."""
    plain = c.map(html.unescape, na_action="ignore").str.normalize("NFKC")
    return plain.str.split().str.join(" ")


def to_number(c) -> Column:
    """Lenient: anything that is not a finite number is null."""
    value = col(c).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def number_issue(c) -> Column:
    """``blank`` for missing input, ``bad`` for text or a non-finite number, null when usable."""
    text = F.trim(F.regexp_replace(col(c).cast("string"), ",", ""))
    return F.when(text.isNull() | (text == ""), "blank").when(to_number(text).isNull(), "bad")


def strict_number(c) -> Column:
    """Blank is null; text and non-finite numbers stop the query."""
    text = F.trim(F.regexp_replace(col(c).cast("string"), ",", ""))
    return F.when(
        number_issue(c) == "bad", F.raise_error(F.concat(F.lit("Not a finite number: "), text)).cast("double")
    ).otherwise(to_number(text))


OFFSET_PATTERN = r"(Z|[+-]\d\d:\d\d)$"


def parse_instant(c) -> Column:
    """Only a text with an explicit offset is an instant; a naive time is null."""
    return F.when(col(c).rlike(OFFSET_PATTERN), col(c).try_cast("timestamp"))


def stable_id(prefix: str, *columns, length: int = 20) -> Column:
    """Digest of the JSON form of the columns in the given order."""
    payload = F.to_json(F.struct(*[col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)]),
                        {"ignoreNullFields": "false"})
    return F.concat(F.lit(prefix), F.substring(F.sha2(payload, 256), 1, length))


def landuse_kind(code, wanted: str) -> Column:
    """pure when the code is the wanted class alone, mixed when it is one of a slash list."""
    code = F.trim(col(code))
    return F.when(code == wanted, "pure").when(F.array_contains(F.split(code, "/"), wanted), "mixed")


@dataclass(frozen=True)
class UnitRule:
    """A mapped unit gets ``tag`` if its code is one of ``codes``, or its code or name contains one of the marks."""

    tag: str
    codes: tuple[str, ...] = ()
    code_marks: tuple[str, ...] = ()
    name_marks: tuple[str, ...] = ()

    def fits(self, code: Column, name: Column) -> Column:
        marks = [code.contains(m) for m in self.code_marks] + [name.contains(m) for m in self.name_marks]
        return reduce(Column.__or__, marks, code.isin(*self.codes))


# Codes and words of the soil map.
SOIL_RULES = (
    UnitRule("water", ("W",)),
    UnitRule("terrain_misc_unit", ("SC", "ES", "RL", "RC", "AC")),
    UnitRule("complex_or_association", code_marks=("-", "/"), name_marks=("เชิงซ้อน", "สัมพันธ์")),
    UnitRule("unidentified", ("", "(ไม่ระบุ)")),
)


def soil_tag(code, name, rules: tuple[UnitRule, ...] = SOIL_RULES, nameless: str = "unidentified",
             other: str = "named_single_unit_candidate") -> Column:
    """Resolution tag of a mapped unit: the first rule that fits, else ``nameless`` without a name, else ``other``."""
    code, name = F.coalesce(col(code), F.lit("")), F.coalesce(col(name), F.lit(""))
    tags = F.array_compact(F.array(*[F.when(r.fits(code, name), r.tag) for r in rules]))
    return F.coalesce(F.get(tags, F.lit(0)), F.when(name == "", nameless).otherwise(other))


# Phase names of the monthly climate bulletins, plain and as printed.
PHASES = {"el nino": "El Niño", "la nina": "La Niña", "enso-neutral": "ENSO-neutral"}

OBSERVING = ("consistent with", "reflect", "indicat", "remain", "continu", "persist", "present", "prevail", "emerg", "observed")
OUTLOOK = ("outlook", "forecast", "expect", "favor", "favour", "watch", "chance", "likely", "predict", "probab", "could", "may ")
ABOUT = ("about", "approximately", "around", "roughly", "nearly")


def _any_of(text: Column, words) -> Column:
    return reduce(Column.__or__, [text.contains(w) for w in words])


def bulletin_issue_date(text) -> Column:
    """The first written-out date within 400 characters of the header's issuing note; a month check is left to the caller."""
    text = col(text)
    at = F.instr(F.lower(text), "issued by")
    header = F.when(at > 0, F.substring(text, at, F.lit(400)))
    written = F.regexp_extract(header, r"\b[0-9]{1,2}\s+\p{L}+\s+[0-9]{4}\b", 0)
    parts = F.split(F.initcap(written), r"\s+")
    return F.when(written != "", F.try_to_timestamp(F.array_join(parts, " "), F.lit("d MMMM yyyy")).cast("date"))


def plain_phases(text) -> Column:
    """Lower case with the accents and hyphens of phase names repaired."""
    return F.regexp_replace(F.translate(F.lower(col(text)), "ñ\u2010\u2011\u2013", "n---"), "enso[ -]+neutral", "enso-neutral")


def observed_states(df: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """(key, state) of the texts that have one: the phase named first in the first clause that observes and does not look
    ahead. Clauses are rows, so every test is a plain expression. ``key`` is unique."""
    clauses = df.select(*key, F.posexplode(F.split(plain_phases(text), r"[.;:,]\s+")).alias("_at", "_clause"))
    observed = clauses.where(_any_of(F.col("_clause"), PHASES) & _any_of(F.col("_clause"), OBSERVING) & ~_any_of(F.col("_clause"), OUTLOOK))
    places = [F.when(F.instr("_clause", plain) > 0, F.struct(F.instr("_clause", plain).alias("at"), F.lit(name).alias("name"))) for plain, name in PHASES.items()]
    first = F.least(*[F.coalesce(p, F.struct(F.lit(1 << 30).alias("at"), F.lit("").alias("name"))) for p in places])
    return observed.select(*key, "_at", first["name"].alias("_state")).groupBy(*key).agg(F.min_by("_state", "_at").alias("state"))


def probability_mentions(df: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """(key, mentions: array<struct<low, high, approximate, evidence>>) of the texts that have any: the shares in sentences
    that speak of a chance, in order, equal ones once.

    A share is the last word before a percent sign: a number, or two joined by a dash or `to`; a word for "about" before it,
    or a tilde, marks it as approximate. Sentences and shares are rows until the last step. ``key`` is unique.
    """
    ends = F.regexp_replace(col(text), r"([.!?])\s+([A-Z])", "$1\n$2")
    sentences = df.select(*key, F.posexplode(F.split(ends, "\n")).alias("_at", "evidence"))
    sentences = sentences.where(_any_of(F.lower("evidence"), ("chance", "probabilit")) & F.col("evidence").contains("%"))
    parts = sentences.withColumn("_parts", F.split("evidence", "%")).select(
        *key, "_at", "evidence", F.size("_parts").alias("_n"), F.posexplode("_parts").alias("_no", "_before")).where("_no < _n - 1")
    words = F.split(F.regexp_replace(F.trim("_before"), r"\s*(?:\bto\b|-|–)\s*", "-"), r"\s+")
    shares = parts.withColumn("_words", words).withColumn("_last", F.element_at("_words", -1))
    shares = shares.withColumn("_bounds", F.split(F.ltrim("_last", F.lit("~(")), "-")).select(
        *key, "_at", "_no", F.get("_bounds", F.lit(0)).try_cast("double").alias("low"), F.element_at("_bounds", -1).try_cast("double").alias("high"),
        (F.coalesce(F.lower(F.get("_words", F.size("_words") - 2)).isin(*ABOUT), F.lit(False)) | F.col("_last").contains("~")).alias("approximate"), "evidence")
    good = shares.where(F.col("low").between(0, 100) & F.col("high").between(F.col("low"), 100))
    found = good.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_at", "_no", "low", "high", "approximate", "evidence"))).alias("_found"))
    plain = F.transform("_found", lambda m: F.struct(*[m[c].alias(c) for c in ("low", "high", "approximate", "evidence")]))
    return found.select(*key, F.array_distinct(plain).alias("mentions"))
