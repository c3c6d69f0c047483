"""Runs, episodes, lags and ranks.

Sensor series use the sliced scans, so one device is never one task. Daily, monthly and annual panels
have one row per entity and period; their windows hold at most one entity's calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.operators.joins import elapsed
from loamline.operators.scan import (
    Series, balanced, done, previous, running_count, runs,
)


def gap_delta(df: DataFrame, s: Series, value: str, max_gap_s: float) -> DataFrame:
    """``gap_minutes`` to the previous row; ``delta`` only across a gap within the limit."""
    out = done(previous(df, s, {s.time: "_at", value: "_was"}))
    gap = elapsed(s.time, "_at")
    return out.withColumn("gap_minutes", gap / 60).withColumn(
        "delta", F.when(gap <= max_gap_s, F.col(value) - F.col("_was"))).drop("_at", "_was")


def _mark_runs(df: DataFrame, s: Series, signature: Sequence[str], max_gap_s: float | None) -> DataFrame:
    """``runs`` of an unchanged signature, with ``_complete`` and ``run_start``.

    A null in the signature differs from everything, itself included.
    """
    names = {c: f"_p_{c}" for c in signature}
    same = F.lit(True)
    complete = F.lit(True)
    for c, p in names.items():
        same = same & F.coalesce(F.col(c) == F.col(p), F.lit(False))
        complete = complete & F.col(c).isNotNull()
    if max_gap_s is not None:
        same = same & F.coalesce(elapsed(s.time, "_prev_at") <= max_gap_s, F.lit(False))
    marked = runs(df, s, {**names, s.time: "_prev_at"}, ~same)
    return marked.withColumns({"_complete": complete, "run_start": F.col("_run")[s.time]}).drop(*names.values(), "_prev_at", "_break", "_run")


def stale_runs(df: DataFrame, s: Series, signature: Sequence[str], minutes: float,
               max_gap_s: float | None = None) -> DataFrame:
    """``stale_minutes`` since the signature last changed and the ``stale`` flag."""
    out = done(_mark_runs(df, s, signature, max_gap_s)).drop("_next", "_last_at")
    in_run = elapsed(s.time, "run_start") / 60
    return out.withColumns({
        "stale_minutes": F.when(F.col("_complete"), in_run),
        "stale": F.col("_complete") & (in_run >= minutes),
    }).drop("_complete", "run_start")


def flatline_online(df: DataFrame, s: Series, signature: Sequence[str], minutes: float = 60,
                    max_gap_s: float = 1800) -> DataFrame:
    """Causal form: only rows at least ``minutes`` into the run are flagged, earlier rows never change."""
    return stale_runs(df, s, signature, minutes, max_gap_s).withColumnRenamed("stale", "flatline_online").drop(
        "stale_minutes")


def flatline_offline(df: DataFrame, s: Series, signature: Sequence[str], minutes: float = 60,
                     max_gap_s: float = 1800) -> DataFrame:
    """Hindsight form: every row of a run that lasts at least ``minutes`` is flagged, its first row included."""
    marked = _mark_runs(df, s, signature, max_gap_s)
    # The run ends at the row before the next break, or at the last row of the entity.
    end = F.coalesce(F.col("_next.before"), F.col("_last_at"))
    length = (elapsed(end, "run_start")) / 60
    return done(marked).withColumns({"run_end": end, "flatline_offline": F.col("_complete") & (length >= minutes)}).drop(
        "_complete", "_next", "_last_at")


def run_table(flagged: DataFrame, s: Series) -> DataFrame:
    """One row per flagged run of ``flatline_offline``."""
    return flagged.where("flatline_offline").groupBy(*s.by, "run_start", "run_end").agg(F.count("*").alias("rows"))


def _hours(ts: str) -> Column:
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / 3600)


def lag_delta_full(df: DataFrame, by: Sequence[str], ts: str, value: str, lag: int, name: str) -> DataFrame:
    """Change over ``lag`` hours, only when every hour in between is present. One row per (entity, hour)."""
    w = Window.partitionBy(*by).orderBy("_h")
    out = df.withColumn("_h", _hours(ts))
    full = F.count(value).over(w.rangeBetween(-lag, 0)) == lag + 1
    return out.withColumn(name, F.when(full, F.col(value) - F.max(value).over(w.rangeBetween(-lag, -lag)))).drop("_h")


def lead_target_full(df: DataFrame, by: Sequence[str], ts: str, value: str, lead: int, name: str) -> DataFrame:
    """Value ``lead`` hours ahead, only when the whole path to it is present."""
    w = Window.partitionBy(*by).orderBy("_h")
    out = df.withColumn("_h", _hours(ts))
    full = F.count(value).over(w.rangeBetween(0, lead)) == lead + 1
    return out.withColumn(name, F.when(full, F.max(value).over(w.rangeBetween(lead, lead)))).drop("_h")


def pct_change(df: DataFrame, by: Sequence[str], period: str, value: str, name: str = "pct_change") -> DataFrame:
    """Percent change to the previous row of the entity; a null is not filled."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(period))
    return df.withColumn(name, 100 * (F.col(value) / F.nullif(before, F.lit(0.0)) - 1))


def global_rank(df: DataFrame, value: str, tie: Sequence[str], name: str) -> DataFrame:
    """Descending rank over all rows without a single-task window."""
    keyed = df.withColumn("_neg", -F.col(value))
    s = balanced(keyed, Series((), "_neg", tuple(tie), numeric=True))
    return done(running_count(keyed, s, F.lit(True), name)).drop("_neg")


def rank_select_regions(df: DataFrame, region: str, value: str, tie: Sequence[str], national: int = 12,
                        regional: int = 3) -> DataFrame:
    """National and regional rank, the rows within either limit and the reason they are in."""
    ranked = global_rank(df, value, tie, "national_rank")
    w = Window.partitionBy(region).orderBy(F.desc(value), *tie)
    ranked = ranked.withColumn("regional_rank", F.row_number().over(w).cast("long"))
    a, b = F.col("national_rank") <= national, F.col("regional_rank") <= regional
    reason = F.when(a & b, "national_and_regional").when(a, "national").when(b, "regional")
    return ranked.withColumn("selection_reason", reason).where("selection_reason is not null")


def trailing_mean(df: DataFrame, by: Sequence[str], period: str, value: str, n: int = 5, name: str = "trailing_mean"
                  ) -> DataFrame:
    """Mean of the n previous rows; null until there are n values."""
    w = Window.partitionBy(*by).orderBy(period).rowsBetween(-n, -1)
    return df.withColumn(name, F.when(F.count(value).over(w) == n, F.avg(value).over(w)))


def _days(by: Sequence[str], day: str) -> Window:
    return Window.partitionBy(*by).orderBy(F.unix_date(day))


def rolling_sum(df: DataFrame, by: Sequence[str], day: str, value: str, k: int, name: str) -> DataFrame:
    """Sum of the k calendar days ending here; null unless all k values are there."""
    w = _days(by, day).rangeBetween(-(k - 1), 0)
    return df.withColumn(name, F.when(F.count(value).over(w) == k, F.sum(value).over(w)))


def rx_k(df: DataFrame, by: Sequence[str], within: Sequence[str], day: str, value: str, k: int) -> DataFrame:
    """Largest k-day sum per entity and ``within`` group."""
    rolled = rolling_sum(df, [*by, *within], day, value, k, "_s")
    return rolled.groupBy(*by, *within).agg(F.max("_s").alias(f"rx{k}"))


def longest_run(df: DataFrame, by: Sequence[str], day: str, condition: Column, name: str) -> DataFrame:
    """Length of the longest run of consecutive days that meet the condition, zero when none does."""
    marked = df.select(*by, F.unix_date(day).alias("_d"), F.coalesce(condition, F.lit(False)).alias("_ok"))
    hits = marked.where("_ok").withColumn(
        "_island", F.col("_d") - F.row_number().over(Window.partitionBy(*by).orderBy("_d")))
    runs = hits.groupBy(*by, "_island").agg(F.count("*").alias("_n")).groupBy(*by).agg(F.max("_n").alias(name))
    return df.select(*by).distinct().join(runs, list(by), "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def dry_triggers(df: DataFrame, by: Sequence[str], day: str, rain: str, limit: float = 1.0, width: int = 15,
                 reset_mm: float | None = None, reset_days: int = 31) -> DataFrame:
    """Days on which the trailing mean falls below the limit. ``trigger`` needs a known, not-dry day before;
    ``rejected`` marks triggers followed by heavy rain; ``dry`` is null where the window is incomplete."""
    w = _days(by, day)
    mean = w.rangeBetween(-(width - 1), 0)
    out = df.withColumn("dry", F.when(F.count(rain).over(mean) == width, F.avg(rain).over(mean) < limit))
    yesterday = F.bool_and("dry").over(w.rangeBetween(-1, -1))
    out = out.withColumn("_crossing", F.coalesce(F.col("dry") & ~yesterday, F.lit(False)))
    ahead = w.rangeBetween(0, reset_days - 1)
    heavy = F.lit(False) if reset_mm is None else F.coalesce(F.max(rain).over(ahead) > reset_mm, F.lit(False))
    return out.withColumn("rejected", F.col("_crossing") & heavy).withColumn(
        "trigger", F.col("_crossing") & ~F.col("rejected")).drop("_crossing")


def trigger_search(triggers: DataFrame, searches: DataFrame, by: Sequence[str], day: str) -> DataFrame:
    """Triggers inside each search period (entity, search id, start, end). The first day of a search can
    only be left-censored: a dry spell already running there is not a new trigger."""
    days = searches.withColumn(day, F.explode(F.sequence("start", "end")))
    joined = days.join(triggers.select(*by, day, "dry", "trigger", "rejected"), [*by, day], "left")
    inside = F.col(day) > F.col("start")
    keys = [c for c in searches.columns if c not in by]
    return joined.groupBy(*by, *keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("trigger") & inside, F.col(day)))).alias("triggers"),
        F.count_if(F.col("rejected") & inside).alias("rejected_rain_reset"),
        F.coalesce(F.bool_or(F.col("dry") & ~inside), F.lit(False)).alias("left_censored"),
        F.count_if(F.col("dry").isNull()).alias("incomplete_days"))


def rain_after_dry(df: DataFrame, by: Sequence[str], day: str, rain: str, rain_mm: float = 10, dry_mm: float = 1,
                   dry_days: int = 7, name: str = "rain_after_dry") -> DataFrame:
    """Days with heavy rain right after a full week of dry days; null when the week is incomplete."""
    w = _days(by, day).rangeBetween(-dry_days, -1)
    known = (F.count(rain).over(w) == dry_days) & F.col(rain).isNotNull()
    return df.withColumn(name, F.when(known, (F.max(rain).over(w) < dry_mm) & (F.col(rain) >= rain_mm)))


def regime_streak(df: DataFrame, by: Sequence[str], index: str, value: str, warm: float = 0.5, cold: float = -0.5,
                  persistent: int = 5) -> DataFrame:
    """Regime, length of the current streak and the label reached so far. ``index`` numbers consecutive
    seasons; ``sequence_ok`` is false where a season is missing or repeated."""
    w = Window.partitionBy(*by).orderBy(index)
    regime = F.when(F.col(value) >= warm, "warm").when(F.col(value) <= cold, "cold").when(F.col(value).isNotNull(), "neutral")
    out = df.withColumn("regime", regime)
    out = out.withColumn("_new", (~F.col("regime").eqNullSafe(F.lag("regime").over(w))).cast("int"))
    out = out.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.row_number().over(Window.partitionBy(*by, "_island").orderBy(index))
    out = out.withColumn("streak", F.when(F.col("regime") == "neutral", 0).otherwise(n))
    label = (
        F.when(F.col("regime") == "neutral", "neutral").when(F.col("streak") < persistent, "not_yet_persistent")
        .when(F.col("regime") == "warm", "persistent_warm").otherwise("persistent_cold"))
    step = F.col(index) - F.lag(index).over(w)
    return out.withColumns({"phase": label, "sequence_ok": F.coalesce(step == 1, F.lit(True))}).drop("_new", "_island")


def episodes(df: DataFrame, s: Series, value: str, threshold: float, max_gap_s: float) -> DataFrame:
    """Runs of consecutive rows at or above the threshold; a gap ends a run. The peak is its first maximum."""
    high = F.coalesce(F.col(value) >= threshold, F.lit(False))
    start = F.col("_high") & ~F.coalesce(F.col("_was_high") & (elapsed(s.time, "_at") <= max_gap_s), F.lit(False))
    marked = runs(df.withColumn("_high", high), s, {s.time: "_at", "_high": "_was_high"}, start)
    found = done(marked).where("_high").withColumnRenamed("_run", "_episode")
    peak = F.struct(F.col(s.time).alias("at"), F.col(value).alias("value"))
    out = found.groupBy(*s.by, "_episode").agg(
        F.min(s.time).alias("start_at"), F.max(s.time).alias("end_at"), F.count("*").alias("rows"),
        F.min_by(peak, F.struct((-F.col(value)).alias("v"), s.time, *s.tie)).alias("_peak"))
    return out.select(*s.by, "start_at", "end_at", "rows", F.col("_peak.at").alias("peak_at"),
                      F.col("_peak.value").alias("peak_value"))


def prior_interval(errors: DataFrame, by: Sequence[str], year: str, error: str, years_back: int = 5,
                   level: float = 0.8) -> DataFrame:
    """Half-width of the band of a year: an order statistic of the largest absolute error of each of the
    preceding years; null with fewer years."""
    yearly = errors.groupBy(*by, year).agg(F.max(F.abs(error)).alias("_m"))
    spread = yearly.withColumn("_to", F.explode(F.sequence(F.col(year) + 1, F.col(year) + years_back)))
    past = spread.groupBy(*by, F.col("_to").alias(year)).agg(F.array_sort(F.collect_list("_m")).alias("_past"))
    rank = F.ceil((F.size("_past") + 1) * F.lit(level)).cast("int")
    radius = F.when((F.size("_past") >= years_back) & (rank <= F.size("_past")), F.try_element_at("_past", rank))
    return errors.join(past, [*by, year], "left").withColumn("radius", radius).drop("_past")


def dedupe_last(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key: one hash aggregation with map-side combine, no window over a hot key."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*key, *[F.col("_row")[c].alias(c) for c in rest])


def switches(df: DataFrame, by: Sequence[str], year: str, choice: str) -> DataFrame:
    """How often the choice differs from the year before."""
    was = F.lag(choice).over(Window.partitionBy(*by).orderBy(year))
    return df.withColumn("_changed", was.isNotNull() & (was != F.col(choice))).groupBy(*by).agg(
        F.count_if(F.col("_changed")).alias("switches"))


def _reference(df: DataFrame, by: Sequence[str], year: str, columns: Sequence[str], cutoff: int) -> DataFrame:
    aggs = [F.count("*").alias("_rows")]
    for c in columns:
        aggs += [F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"), F.count(c).alias(f"_n_{c}")]
    return df.where(F.col(year) <= cutoff).groupBy(*by).agg(*aggs)


def train_zscore(df: DataFrame, by: Sequence[str], year: str, columns: Sequence[str], cutoff: int,
                 min_years: int = 4) -> DataFrame:
    """z-scores by the mean and population deviation of the years up to the cutoff (zero deviation -> 1).
    Null when the entity has too few complete years."""
    ref = _reference(df, by, year, columns, cutoff)
    joined = df.join(ref, list(by), "left")
    out = {}
    for c in columns:
        ok = (F.col("_rows") >= min_years) & (F.col(f"_n_{c}") == F.col("_rows"))
        sd = F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))
        out[f"z_{c}"] = F.when(ok, (F.col(c) - F.col(f"_m_{c}")) / sd)
    return joined.withColumns(out).drop(*[c for c in ref.columns if c not in by])


def train_anomaly(df: DataFrame, by: Sequence[str], year: str, differences: Sequence[str], percents: Sequence[str],
                  cutoff: int) -> DataFrame:
    """Anomaly against the training mean of the entity: a difference, or percent of it."""
    columns = [*differences, *percents]
    ref = _reference(df, by, year, columns, cutoff)
    joined = df.join(ref, list(by), "left")
    out = {f"anomaly_{c}": F.col(c) - F.col(f"_m_{c}") for c in differences}
    out |= {f"anomaly_pct_{c}": F.when(F.col(f"_m_{c}") > 0, 100 * (F.col(c) / F.col(f"_m_{c}") - 1)) for c in percents}
    return joined.withColumns(out).drop(*[c for c in ref.columns if c not in by])


def stable_sort(df: DataFrame, *keys) -> DataFrame:
    """Total order: the caller ends the key list with a unique column."""
    return df.orderBy(*keys)


def topk(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows per group. Spark also applies the rank limit before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def argmin_config(df: DataFrame, by: Sequence[str], score: str, config: str) -> DataFrame:
    """Configuration with the smallest score; a tie goes to the first in declared order."""
    best = df.where(F.col(score).isNotNull()).groupBy(*by).agg(F.min(F.struct(score, config)).alias("_b"))
    return best.select(*by, F.col("_b")[config].alias(config), F.col("_b")[score].alias(score))


def rank_select(df: DataFrame, by: Sequence[str], score: str, spread: str, features: str, complexity: str, config: str,
                slack: float = 0.02) -> DataFrame:
    """Among configurations within the slack of the best score: the steadiest, then the fewest features,
    then the simplest, then the first."""
    best = df.groupBy(*by).agg(F.max(score).alias("_best"))
    near = df.join(best, list(by)).where(F.col(score) >= F.col("_best") - slack - 1e-12)
    pick = near.groupBy(*by).agg(F.min_by(F.struct(config, score, spread), F.struct(spread, features, complexity, config)).alias("_p"))
    return pick.select(*by, "_p.*")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], condition: Column | None = None) -> DataFrame:
    """Latest row per key among those that meet the condition."""
    return dedupe_last(df if condition is None else df.where(condition), keys, order)


def last_valid(df: DataFrame, by: Sequence[str], ts: str, tie: str, valid: Column, age: str, values: Sequence[str],
               now: Column, max_age: float = 3600) -> DataFrame:
    """Latest usable reading per device: flagged valid, age known and in range, not in the future, some value."""
    some = F.coalesce(*[F.col(v) for v in values]).isNotNull()
    usable = valid.eqNullSafe(F.lit(True)) & F.col(age).between(0, max_age) & (F.col(ts) <= now) & some
    return latest_per_key(df, by, [ts, tie], usable)


def concat(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def missing_from(expected: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expected.select(*keys).distinct().join(seen, list(keys), "left_anti")


def common_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def distinct_rows(*frames: DataFrame) -> DataFrame:
    return concat(*frames).distinct()
