"""Ordered scans that stay parallel inside one entity.

A window over ``partitionBy(entity)`` puts every row of an entity in one task. Here an entity's
series is cut into time slices. Each slice is scanned by its own window partition, one summary row
per (entity, slice) is folded over the slices, and the folded value is handed back to the rows of
the slice. The summary join and the row window share the (entity, slice) hash partitioning, so the
rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.session import cut_lineage

SLICE = "_slice"


@dataclass(frozen=True)
class Series:
    """How the rows of a frame form ordered series: entity columns, time column, unique tie-break."""

    by: tuple[str, ...]
    time: str
    tie: tuple[str, ...] = ()
    bounds: tuple[float, ...] = ()
    slice_seconds: int = 86400
    numeric: bool = False

    @property
    def key(self) -> Column:
        return F.struct(self.time, *self.tie)

    def position(self) -> Column:
        """The order column as a number: microseconds for a time column."""
        c = F.col(self.time)
        return c.cast("double") if self.numeric else F.unix_micros(c.cast("timestamp"))

    def cut(self, df: DataFrame) -> DataFrame:
        """Add the slice number. It grows with time, so slices of an entity are ordered."""
        if SLICE in df.columns:
            return df
        if not self.bounds:
            width = self.slice_seconds * (1 if self.numeric else 1_000_000)
            return df.withColumn(SLICE, F.floor(self.position() / F.lit(width)).cast("long"))
        splits = [float("-inf"), *self.bounds, float("inf")]
        staged = df.withColumn("_micros", self.position().cast("double"))
        cut = Bucketizer(splits=splits, inputCol="_micros", outputCol=SLICE).transform(staged)
        return cut.withColumn(SLICE, F.col(SLICE).cast("long")).drop("_micros")

    def rows(self) -> Window:
        return Window.partitionBy(*self.by, SLICE).orderBy(self.time, *self.tie)

    def slices(self) -> Window:
        return Window.partitionBy(*self.by).orderBy(SLICE)


def balanced(df: DataFrame, series: Series, slices: int = 0, error: float = 0.001) -> Series:
    """Cut at quantiles of the time column, so that no slice holds more than its share of all rows
    even when one entity, or a short period, holds a large part of them. Reads one column."""
    if slices <= 0:
        slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if slices < 2:
        return series
    micros = df.select(series.position().cast("double").alias("m"))
    probs = [i / slices for i in range(1, slices)]
    cuts = sorted(set(micros.approxQuantile("m", probs, error)))
    return replace(series, bounds=tuple(cuts))


def _folded(df: DataFrame, s: Series, summaries: dict[str, Column], folds: dict[str, Column]) -> DataFrame:
    """One row per (entity, slice) with the folded columns only."""
    edges = df.groupBy(*s.by, SLICE).agg(*[c.alias(n) for n, c in summaries.items()])
    for name, column in folds.items():
        edges = edges.withColumn(name, column)
    return edges.select(*s.by, SLICE, *folds)


def _attach(df: DataFrame, s: Series, edges: DataFrame) -> DataFrame:
    return df.join(edges, [*s.by, SLICE], "left")


def previous(df: DataFrame, s: Series, columns: dict[str, str]) -> DataFrame:
    """``columns`` maps an input column to the name of its value in the preceding row."""
    df = s.cut(df)
    packed = F.struct(*[F.col(c).alias(n) for c, n in columns.items()])
    edges = _folded(df, s, {"_scan_last": F.max_by(packed, s.key)}, {"_scan_before": F.lag("_scan_last").over(s.slices())})
    out = _attach(df, s, edges)
    out = out.withColumn("_scan_prev", F.coalesce(F.lag(packed).over(s.rows()), F.col("_scan_before")))
    for name in columns.values():
        out = out.withColumn(name, F.col("_scan_prev")[name])
    return out.drop("_scan_before", "_scan_prev")


def last_where(df: DataFrame, s: Series, flag: Column, value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """Value of the latest row at or before (or strictly before) this one where ``flag`` holds."""
    df = s.cut(df).withColumn("_scan_hit", F.when(flag, F.struct(value.alias("v"))))
    before = s.slices().rowsBetween(Window.unboundedPreceding, -1)
    edges = _folded(
        df, s, {"_scan_last": F.max_by("_scan_hit", F.when(F.col("_scan_hit").isNotNull(), s.key))},
        {"_scan_before": F.last("_scan_last", ignorenulls=True).over(before)},
    )
    frame = s.rows().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    hit = F.coalesce(F.last("_scan_hit", ignorenulls=True).over(frame), F.col("_scan_before"))
    return _attach(df, s, edges).withColumn(name, hit["v"]).drop("_scan_hit", "_scan_before")


def running_sum(df: DataFrame, s: Series, value: Column, name: str) -> DataFrame:
    """Sum of the whole numbers ``value`` up to and including this row; null counts as zero."""
    df = s.cut(df).withColumn("_scan_one", F.coalesce(value, F.lit(0)))
    before = s.slices().rowsBetween(Window.unboundedPreceding, -1)
    edges = _folded(
        df, s, {"_scan_sum": F.sum("_scan_one")}, {"_scan_base": F.coalesce(F.sum("_scan_sum").over(before), F.lit(0))}
    )
    frame = s.rows().rowsBetween(Window.unboundedPreceding, 0)
    return (
        _attach(df, s, edges)
        .withColumn(name, (F.sum("_scan_one").over(frame) + F.col("_scan_base")).cast("long"))
        .drop("_scan_one", "_scan_base")
    )


def running_count(df: DataFrame, s: Series, flag: Column, name: str) -> DataFrame:
    """Number of rows up to and including this one where ``flag`` holds."""
    return running_sum(df, s, F.when(flag, 1).otherwise(0), name)


def runs(df: DataFrame, s: Series, lagged: dict[str, str], broken: Column,
         ahead: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """Runs of consecutive rows, with one summary per slice for everything that is asked of them.

    A row where ``broken`` holds begins a run. ``broken`` reads the columns of ``lagged`` (the time column among them) and,
    by their new names, their values in the preceding row, which are null on the first row of an entity; it is never null.
    Adds these values and ``_break``; ``_run``: key of the latest break at or before the row; ``_next``: key of the earliest
    break after it and the time ``before`` that break; ``_last_at``: the last time of the entity. ``ahead`` maps a name to
    (flag, value): the value at the earliest row, from this one on, where the flag holds.

    The first row of a slice cannot see its predecessor, so its break is decided when the summaries are folded, from the
    first row of the slice and the last one of the slice before. Columns that nobody reads are pruned by the optimiser.
    """
    ahead, was = ahead or {}, lagged[s.time]
    packed = F.struct(*[F.col(c).alias(n) for c, n in lagged.items()])
    df = s.cut(df).withColumn("_scan_prev", F.lag(packed).over(s.rows()))
    for name, (flag, value) in ahead.items():
        df = df.withColumn(f"_hit_{name}", F.when(flag, F.struct(value.alias("v"))))
    unpack = {n: F.col("_scan_prev")[n] for n in lagged.values()}
    inner = df.withColumns(unpack).withColumn("_inner", F.when(F.col("_scan_prev").isNotNull() & broken, s.key))
    edges = inner.groupBy(*s.by, SLICE).agg(
        F.min_by(F.struct(s.key.alias("_key"), *lagged), s.key).alias("_first"), F.max_by(packed, s.key).alias("_last"), F.max("_inner").alias("_inner"),
        F.min_by(F.struct(F.col("_inner").alias("key"), F.col(was).alias("before")), F.col("_inner")).alias("_early"),
        *[F.min_by(f"_hit_{n}", F.when(F.col(f"_hit_{n}").isNotNull(), s.key)).alias(f"_hit_{n}") for n in ahead])
    edges = edges.withColumn("_scan_before", F.lag("_last").over(s.slices()))
    edges = edges.withColumns({n: F.col("_scan_before")[n] for n in lagged.values()}).withColumns({c: F.col("_first")[c] for c in lagged})
    first = F.struct(F.col("_first._key").alias("key"), F.col(was).alias("before"))
    edges = edges.withColumns({
        "_own": F.coalesce(F.col("_inner"), F.when(broken, F.col("_first._key"))), "_early": F.when(broken, first).otherwise(F.col("_early"))})
    past, later = s.slices().rowsBetween(Window.unboundedPreceding, -1), s.slices().rowsBetween(1, Window.unboundedFollowing)
    edges = edges.select(
        *s.by, SLICE, "_scan_before", F.last("_own", ignorenulls=True).over(past).alias("_scan_run"),
        F.first("_early", ignorenulls=True).over(later).alias("_scan_next"), F.max(F.col("_last")[was]).over(Window.partitionBy(*s.by)).alias("_last_at"),
        *[F.first(f"_hit_{n}", ignorenulls=True).over(later).alias(f"_scan_{n}") for n in ahead])
    out = _attach(df, s, edges).withColumn("_scan_prev", F.coalesce("_scan_prev", "_scan_before")).withColumns(unpack).withColumn("_break", broken)
    back, on = s.rows().rowsBetween(Window.unboundedPreceding, 0), s.rows().rowsBetween(0, Window.unboundedFollowing)
    after = s.rows().rowsBetween(1, Window.unboundedFollowing)
    here = F.struct(s.key.alias("key"), F.col(was).alias("before"))
    out = out.withColumns({
        "_run": F.coalesce(F.last(F.when(F.col("_break"), s.key), ignorenulls=True).over(back), F.col("_scan_run")),
        "_next": F.coalesce(F.first(F.when(F.col("_break"), here), ignorenulls=True).over(after), F.col("_scan_next")),
        **{n: F.coalesce(F.first(f"_hit_{n}", ignorenulls=True).over(on), F.col(f"_scan_{n}"))["v"] for n in ahead}})
    return out.drop("_scan_prev", "_scan_before", "_scan_run", "_scan_next", *[f"_{k}_{n}" for n in ahead for k in ("hit", "scan")])


def done(df: DataFrame) -> DataFrame:
    return df.drop(SLICE)


# Doubles have 64 bits; the rounds of the selection settle so many of them together.
RADIX = (22, 43, 64)


def order_bits(df: DataFrame, v: Column, out: str) -> DataFrame:
    """``df`` with ``out``, a long that orders like the double ``v``: its sign, exponent and fraction bits. NaN comes after
    infinity; both zeros are 0. Built in steps, so that no step is evaluated more than once."""
    tiny = 2.0**-1022
    df = df.withColumn("_v", v).withColumn("_size", F.abs("_v"))
    df = df.withColumn("_e", F.least(F.greatest(F.floor(F.log2("_size")), F.lit(-1022)), F.lit(1023)).cast("int"))
    df = df.withColumn("_m", F.col("_size") / F.pow(F.lit(2.0), F.col("_e").cast("double")))
    # The logarithm may be off by one next to a power of two.
    off = F.when(F.col("_m") >= 2.0, 1).when(F.col("_m") < 1.0, -1).otherwise(0)
    df = df.withColumns({"_off": off, "_f": F.when(F.col("_m") >= 2.0, F.col("_m") / 2).when(F.col("_m") < 1.0, F.col("_m") * 2).otherwise(F.col("_m")) - 1.0})
    normal = (F.col("_e") + F.col("_off") + 1023).cast("long") * F.lit(1 << 52) + (F.col("_f") * float(1 << 52)).cast("long")
    bits = (F.when(F.col("_size") == 0.0, F.lit(0)).when(F.isnan("_v"), F.lit((2047 << 52) + 1)).when(F.col("_size") == float("inf"), F.lit(2047 << 52))
            .when(F.col("_size") < tiny, (F.col("_size") / tiny * float(1 << 52)).cast("long")).otherwise(normal))
    df = df.withColumn("_size", bits.cast("long"))
    return df.withColumn(out, F.when(F.col("_v") < 0, -F.col("_size")).otherwise(F.col("_size"))).drop("_v", "_size", "_e", "_m", "_off", "_f")


def bits_order(bits: Column) -> Column:
    """The double of ``order_bits``."""
    size = F.abs(bits)
    exponent = F.shiftright(size, 52).cast("int")
    fraction = size.bitwiseAND(F.lit((1 << 52) - 1)).cast("double") / float(1 << 52)
    value = F.when(exponent == 0, fraction * F.lit(2.0**-1022)).otherwise(
        (fraction + 1.0) * F.pow(F.lit(2.0), F.least(exponent - 1023, F.lit(1023)).cast("double")))
    value = F.when(size == 2047 << 52, F.lit(float("inf"))).when(size > 2047 << 52, F.lit(float("nan"))).otherwise(value)
    return F.when(bits < 0, -value).otherwise(value)


def _holding(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """The histogram bins that hold their rank, which is counted from the start of the bin from here on."""
    start = F.col("_end") - F.col("_c")
    return found.where((F.col("_rank") >= start) & (F.col("_rank") < F.col("_end"))).select(
        *by, "_n", "i", "j", (F.col("_rank") - start).alias("_rank"), "_at")


def grouped_quantiles(df: DataFrame, by: Sequence[str], column: str, probs: dict[str, float],
                      weight: str | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles per group without holding a group in one task: (by, n, names of ``probs``).

    Radix selection for all groups and quantiles at once: a histogram over the first bits of the values tells which bin
    holds each wanted rank, the next round looks at the next bits of the values in these bins only, and after three rounds
    a bin is one value. Equal values are counted before they are shuffled, and dealt by group and value, so a group of any
    size is spread over all tasks; each round sends on histogram rows only. ``weight`` counts a row so many times. Null
    values are left out; groups whose key holds a null too.
    """
    by = list(by)
    v = F.col(column).cast("double")
    times = F.sum(weight) if weight else F.count("*")
    plain = df.where(v.isNotNull()).select(*by, v.alias("_value"), *([weight] if weight else []))
    # Written once and read by each round: the distinct values of a group with their counts.
    counted = cut_lineage(order_bits(plain, F.col("_value"), "_bits").groupBy(*by, "_bits").agg(times.alias("_c")))
    prefix = lambda settled: F.shiftright("_bits", 64 - settled) if settled < 64 else F.col("_bits")
    # The first histogram also gives the ranks; every later one is taken per rank, in the bin that holds it.
    first = counted.groupBy(*by, prefix(RADIX[0]).alias("_at")).agg(F.sum("_c").alias("_c"))
    order = Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    first = first.withColumns({"_end": F.sum("_c").over(order), "_n": F.sum("_c").over(Window.partitionBy(*by))})
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(p).alias("p")) for i, p in enumerate(probs.values()) for j in (0, 1)])
    # The rank after the last one is never weighed in; the last one stands for it.
    rank = F.least(F.floor(F.col("w.p") * (F.col("_n") - 1)) + F.col("w.j"), F.col("_n") - 1)
    state = first.withColumn("w", F.explode(wanted)).withColumns({"i": F.col("w.i"), "j": F.col("w.j"), "_rank": rank})
    for before, settled in zip(RADIX, RADIX[1:]):
        state = _holding(state, by)
        rows = counted.withColumn("_at", prefix(before)).join(state, [*by, "_at"])
        keys = [*by, "_n", "i", "j", "_rank"]
        found = rows.groupBy(*keys, prefix(settled).alias("_at")).agg(F.sum("_c").alias("_c"))
        order = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        state = found.withColumn("_end", F.sum("_c").over(order))
    state = _holding(state, by)
    low = [F.max(F.when((F.col("i") == i) & (F.col("j") == 0), F.col("_v"))).alias(f"_l{i}") for i in range(len(probs))]
    high = [F.max(F.when((F.col("i") == i) & (F.col("j") == 1), F.col("_v"))).alias(f"_h{i}") for i in range(len(probs))]
    got = state.withColumn("_v", bits_order(F.col("_at"))).groupBy(*by, "_n").agg(*low, *high)
    out = []
    for i, (name, p) in enumerate(probs.items()):
        rank = F.lit(p) * (F.col("_n") - 1)
        fraction = rank - F.floor(rank)
        a, b = F.col(f"_l{i}"), F.col(f"_h{i}")
        out.append(F.when(fraction == 0, a).otherwise(a + fraction * (b - a)).alias(name))
    return got.select(*by, F.col("_n").alias("n"), *out)
