"""URL filters by path templates of each host, with DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loamline.llm.shared import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Templates:
    """``z``: standard errors by which the labels of a branch differ from those of its siblings if it stays literal. ``few``:
    labelled pages that a branch and its siblings each need to be compared. ``values``: distinct branches from which a level
    without enough labels is variable. ``prior``: smoothing weight on both sides. ``block``: smoothed share of blocked labels
    from which a template is rejected."""

    z: float = 2.6
    few: int = 5
    values: int = 8
    prior: float = 1.0
    block: float = 0.9


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; empty without `://`."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Behind the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Rule:
    """`block` or `allow` for a host with its subdomains and the paths that start with ``path`` (with its slash)."""

    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, verdict: str, text: str) -> "Rule":
        host, slash, path = text.partition("/")
        return cls(verdict, host, slash + path)

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def longest(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits; null if none does."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = rule.fits(host, path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def shape(path: Column) -> Column:
    """Segments of a path with the variable ones generalised: digits, long hexadecimal runs and segments mixing many digits
    become wildcards that keep a file ending."""
    segment = lambda s: F.when(s.rlike(r"^[0-9]+(\.[a-z0-9]{1,5})?$") | s.rlike(r"^[0-9a-fA-F-]{8,}$") | s.rlike(r"[0-9].*[0-9].*[0-9].*[0-9]"),
                               F.lit("*")).otherwise(s)
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, segment)


def templates(pages: DataFrame, plan: Templates = Templates()) -> DataFrame:
    """Rows (host, shape, template, labelled, blocked, purity) from ``pages`` (host, shape, label: block, allow or null).

    Level by level, the branches of a parent are compared by their labels alone: a branch whose share of blocked labels
    differs from that of its siblings together by more than ``z`` standard errors of the difference stays literal; the
    others are similar and merge into a wildcard, or stay one literal if it is the same segment on all of them. Where a
    branch or its siblings have fewer than ``few`` labels, the number of distinct branches decides: ``values`` or more
    make a variable segment, fewer stay literal. A template's purity is its smoothed share of blocked labels. Everything
    after the first aggregation works on distinct shapes, which generalising keeps few, not on pages; each level is
    written to the shared folder.
    """
    counted = pages.groupBy("host", "shape").agg(
        F.count("label").alias("labelled"), F.count(F.when(F.col("label") == "block", 1)).alias("blocked"))
    state, ended, level = stored(counted.withColumn("template", F.lit(""))), [], 0
    while not state.isEmpty():
        at = state.withColumn("_s", F.get("shape", F.lit(level)))
        branch = at.where("_s is not null").groupBy("host", "template", "_s").agg(F.sum("labelled").alias("_n"), F.sum("blocked").alias("_b"))
        parent = branch.groupBy("host", "template").agg(F.sum("_n").alias("_pn"), F.sum("_b").alias("_pb"), F.count("*").alias("_k"))
        joined = branch.join(parent, ["host", "template"])
        rest, rest_blocked = F.col("_pn") - F.col("_n"), F.col("_pb") - F.col("_b")
        pool = F.col("_pb") / F.nullif(F.col("_pn"), F.lit(0))
        error = F.sqrt(pool * (1 - pool) * (1 / F.nullif(F.col("_n"), F.lit(0)) + 1 / F.nullif(rest, F.lit(0))))
        apart = F.abs(F.col("_b") / F.nullif(F.col("_n"), F.lit(0)) - rest_blocked / F.nullif(rest, F.lit(0))) > plan.z * error
        known = (F.col("_n") >= plan.few) & (rest >= plan.few)
        literal = F.when(F.col("_k") == 1, True).when(known, apart).otherwise(F.col("_k") < plan.values)
        decided = joined.select(
            F.col("host").alias("_h"), F.col("template").alias("_t"), F.col("_s").alias("_q"),
            F.when(literal, F.concat(F.lit("/"), "_s")).otherwise("/*").alias("_step"))
        level += 1
        state = stored(at.join(decided, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")) & (F.col("_s") == F.col("_q")), "left").select(
            "host", "shape", "labelled", "blocked", F.concat("template", F.coalesce("_step", F.lit(""))).alias("template")))
        # A shape with a template to itself, whose branches can only be single from here on, ends at once, like one without
        # further segments; so the levels are those on which shapes still meet, not the longest path.
        alone = state.groupBy("host", "template").agg(F.count("*").alias("_k"), F.max(F.size("shape")).alias("_deep"))
        met = state.join(alone.where((F.col("_k") > 1) & (F.col("_deep") > level)).select("host", "template"), ["host", "template"], "left_semi")
        over = state.join(alone.where((F.col("_k") == 1) | (F.col("_deep") <= level)).select("host", "template"), ["host", "template"], "left_semi")
        left = F.slice("shape", F.lit(level + 1), F.greatest(F.size("shape") - level, F.lit(0)))
        ended.append(over.withColumn("template", F.concat("template", F.array_join(F.transform(left, lambda x: F.concat(F.lit("/"), x)), ""))).select(*state.columns))
        state = stored(met.select(*state.columns))
    state = reduce(DataFrame.unionByName, ended) if ended else state
    whole = state.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    purity = (F.col("blocked") + plan.prior) / (F.col("labelled") + 2 * plan.prior)
    return state.select("host", "shape", "template").join(whole, ["host", "template"]).withColumn("purity", purity)


def judge(pages: DataFrame, rules: list[Rule], plan: Templates = Templates()) -> DataFrame:
    """``pages`` (url) with host, path, rule, template, purity and verdict; columns of these names are replaced.

    A rule that fits decides, the longest first; the pages that rules decide are the labels. Other pages are blocked if
    their template's smoothed share of blocked labels is at least ``block``, so a template without labels is allowed.
    Null urls and urls without `://` have an empty host and path and are allowed unless a rule fits.
    """
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "template", "purity", "verdict")]
    split = pages.select(*keep, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, label = longest(rules, F.col("host"), F.col("path"))
    made = split.withColumns({"rule": rule, "_label": label, "_shape": shape(F.col("path"))})
    found = templates(made.select("host", F.col("_shape").alias("shape"), F.col("_label").alias("label")), plan)
    known = found.select(F.col("host").alias("_host"), F.col("shape").alias("_known"), "template", "purity")
    joined = made.join(known, (F.col("host") == F.col("_host")) & (F.col("_shape") == F.col("_known")), "left")
    method = F.when(F.col("purity") >= plan.block, F.lit("block")).otherwise(F.lit("allow"))
    return joined.select(*keep, "host", "path", "rule", "template", "purity", F.coalesce("_label", method).alias("verdict"))
