"""Checked, consecutive-period, as-of, vintage, interval and band joins.

Every join has an equality key. Time-range conditions are turned into ordered scans (as-of, first
crossing), shared hours or days (vintages, intervals) or time buckets (bands), so no plan falls back
to a nested loop and no step emits all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.operators.quality import require_unique
from loamline.operators.scan import Series, done, last_where, runs


def micros(c) -> Column:
    """Microseconds of a timestamp with or without zone, as an exact long."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))


def elapsed(later, earlier) -> Column:
    """Seconds between two timestamps. The difference is taken in whole microseconds, so limits such as
    exactly one hour compare exactly."""
    return (micros(later) - micros(earlier)) / F.lit(1_000_000.0)


def checked_join(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "inner", validate: str = "m:1") -> DataFrame:
    """Join that stops when a side that must be unique repeats a key."""
    if validate not in ("1:1", "m:1", "1:m"):
        raise ValueError("validate must be 1:1, m:1 or 1:m")
    if validate in ("1:1", "1:m"):
        a = require_unique(a, on)
    if validate in ("1:1", "m:1"):
        b = require_unique(b, on)
    return a.join(b, list(on), how)


def left_with_flag(a: DataFrame, b: DataFrame, on: Sequence[str], flag: str) -> DataFrame:
    """Unmatched left rows stay, with nulls and a false flag."""
    return checked_join(a, b.withColumn(flag, F.lit(True)), on, "left").withColumn(
        flag, F.coalesce(F.col(flag), F.lit(False)))


def lookup_or_report(a: DataFrame, lookup: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(matched rows, keys without a match and how often they occur)."""
    matched = checked_join(a, lookup, on)
    unmatched = a.join(lookup, list(on), "left_anti").groupBy(*on).agg(F.count("*").alias("rows"))
    return matched, unmatched


def grid(entities: DataFrame, period: str, low: Column, high: Column) -> DataFrame:
    """Entity x period grid from per-row bounds; grows with its output only."""
    return entities.withColumn(period, F.explode(F.sequence(low, high)))


def prev_period_join(df: DataFrame, keys: Sequence[str], period: str, columns: Sequence[str],
                     how: str = "inner") -> DataFrame:
    """Values of exactly the preceding period of the same entity. A gap is not bridged."""
    before = df.select(*keys, (F.col(period) + 1).alias(period), *[F.col(c).alias(f"previous_{c}") for c in columns])
    return df.join(before, [*keys, period], how)


def season_pairs(df: DataFrame) -> DataFrame:
    """Current and previous complete season of one orchard. Ratios are compared by exact cross products.

    Columns: orchard, season, harvest_year, harvested_kg, bearing_area (decimals), cultivar, status.
    """
    done_rows = df.where(F.col("status") == "complete")
    pairs = prev_period_join(done_rows, ["orchard", "season"], "harvest_year",
                             ["harvested_kg", "bearing_area", "cultivar"])
    wide = "decimal(19,6)"
    now = F.col("harvested_kg").cast(wide) * F.col("previous_bearing_area").cast(wide)
    was = F.col("previous_harvested_kg").cast(wide) * F.col("bearing_area").cast(wide)
    return pairs.withColumns({
        "increase_label": F.when(now > was, 1).when(now < was, 0),
        "cultivar_changed": ~F.col("cultivar").eqNullSafe(F.col("previous_cultivar")),
    })


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str,
              max_age_seconds: float, strict: bool = True, carry: Sequence[str] = (),
              slice_seconds: int = 30 * 86400, bounds: tuple[float, ...] = ()) -> DataFrame:
    """Latest right row before (strict) or at or before each left row, no older than the limit.

    Right rows that share a key and time are counted first, so an ambiguous match is reported rather
    than picked silently. Both sides then meet in one ordered scan: linear in rows, whatever the skew.
    ``asof_status`` is ok, none, ambiguous or stale; carried columns are null unless ok.
    """
    by = list(by)
    docs = right.groupBy(*by, right_ts).agg(F.count("*").alias("n"), F.min(F.struct(*carry)).alias("payload"))
    doc = docs.select(
        *by, F.col(right_ts).alias("_at"), F.lit(1 if strict else 0).alias("_side"),
        F.struct(F.col(right_ts).alias("at"), "n", "payload").alias("_doc"))
    rows = left.select(*by, F.col(left_ts).alias("_at"), F.lit(0 if strict else 1).alias("_side"),
                       F.struct(*[c for c in left.columns if c not in by]).alias("_row"))
    both = doc.unionByName(rows, allowMissingColumns=True)
    s = Series(tuple(by), "_at", ("_side",), bounds, slice_seconds)
    found = last_where(both, s, F.col("_doc").isNotNull(), F.col("_doc"), "_match").where(F.col("_row").isNotNull())
    age = elapsed("_at", F.col("_match")["at"])
    status = (
        F.when(F.col("_match").isNull(), "none").when(F.col("_match")["n"] > 1, "ambiguous")
        .when(age > max_age_seconds, "stale").otherwise("ok"))
    found = done(found).withColumn("asof_status", status).withColumn("_ok", F.col("asof_status") == "ok")
    return found.select(
        *by, *[F.col("_row")[c].alias(c) for c in left.columns if c not in by], "asof_status",
        F.when(F.col("_ok"), F.col("_match")["at"]).alias(f"asof_{right_ts}"),
        *[F.when(F.col("_ok"), F.col("_match")["payload"][c]).alias(f"asof_{c}") for c in carry])


def vintage_asof(origins: DataFrame, forecasts: DataFrame, by: Sequence[str], origin: str, horizon: int = 6,
                 lookback_hours: int = 24, measures: Mapping[str, Column] | None = None,
                 required: Sequence[str] = ()) -> DataFrame:
    """Latest complete forecast batch known at each hourly origin.

    A batch is (issued, source). It is usable when rows for every hour origin+1..origin+horizon became
    available (the later of issue and receipt) within the lookback window ending at the origin, with all
    required values present. A forecast hour serves only ``horizon`` origins, so each row is spread to
    those origins and counted there; batches are never mixed.
    """
    by = list(by)
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull()
    rows = forecasts.withColumn("_available", F.greatest("issued", "received")).withColumn(
        "_h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    at = F.timestamp_micros(
        F.unix_micros(F.col("valid").cast("timestamp")) - F.col("_h").cast("long") * F.lit(3_600_000_000))
    rows = rows.withColumn("_origin", at).where(
        (micros("_available") <= micros("_origin"))
        & (micros("_available") >= micros("_origin") - F.lit(lookback_hours * 3_600_000_000)))
    batch = rows.groupBy(*by, "_origin", "issued", "source").agg(
        F.count("*").alias("_rows"), F.count_distinct("_h").alias("_hours"), F.bool_and(ok).alias("_ok"),
        F.max("_available").alias("forecast_available"), *[c.alias(n) for n, c in (measures or {}).items()])
    complete = batch.where((F.col("_rows") == horizon) & (F.col("_hours") == horizon) & F.col("_ok"))
    names = ["issued", "source", "forecast_available", *(measures or {})]
    # Latest issue first; among equal issues the first source name.
    best = complete.groupBy(*by, "_origin").agg(
        F.min_by(F.struct(*names), F.struct((-micros("issued")).alias("i"), "source")).alias("_b"))
    best = best.select(*by, F.col("_origin").alias("_o"), *[F.col("_b")[n].alias(n) for n in names])
    left = origins.withColumn("_o", F.col(origin).cast("timestamp"))
    return left.join(best, [*by, "_o"], "left").drop("_o")


def dyadic_blocks(df: DataFrame, first: Column, beyond: Column) -> DataFrame:
    """Each row once per aligned block of [first, beyond): ``_l``, ``_k`` stand for the days _k * 2**_l to (_k + 1) * 2**_l - 1.

    A span of n days falls into at most 2 * log2(n) such blocks, none overlapping another. At each level the span
    shrinks to whole blocks; the outermost ones that have no partner inside the span belong to it.
    """
    spans = df.withColumns({"_a": first.cast("long"), "_b": beyond.cast("long")}).where("_a < _b")
    sides = spans.withColumn("_i", F.expr("explode(sequence(0, 2 * cast(floor(log2(cast(_b - _a as double))) as int) + 3))"))
    level = sides.withColumn("_l", F.expr("shiftright(_i, 1)")).withColumns({
        "_low": F.expr("shiftright(_a + shiftleft(1L, _l) - 1L, _l)"), "_high": F.expr("shiftright(_b, _l)")}).where("_low < _high")
    block = F.expr("case when _i & 1 = 0 then case when _low & 1L = 1L then _low end when _high & 1L = 1L then _high - 1L end")
    return level.withColumn("_k", block).where("_k is not null").drop("_a", "_b", "_i", "_low", "_high")


def interval_density(days: DataFrame, intervals: DataFrame, by: Sequence[str], start: str, end: str, value: str) -> DataFrame:
    """(by, day, n, v) for the distinct (by, day) of ``days``: how many known intervals cover the day and the sum of their
    values. Days that no interval covers are left out.

    Intervals, ends inclusive, are cut into aligned blocks and added up per block; a day reads the blocks that hold it,
    one per level. Rows grow with the logarithm of an interval's length, not with its days. Sums never take a value off
    again, which would lose small values next to large ones. NaN counts as unknown.
    """
    by = list(by)
    v = F.col(value).cast("double")
    known = intervals.where(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("_v"), F.unix_date(start).alias("_s"), F.unix_date(end).alias("_e"))
    blocks = dyadic_blocks(known, F.col("_s"), F.col("_e") + 1).groupBy(*by, "_l", "_k").agg(F.count("*").alias("_n"), F.sum("_v").alias("_v"))
    # 22 levels hold every date of a four-digit year.
    path = days.select(*by, "day").distinct().withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(21)))).withColumn(
        "_k", F.expr("shiftright(cast(unix_date(day) as bigint), _l)"))
    return path.join(blocks, [*by, "_l", "_k"]).groupBy(*by, "day").agg(F.sum("_n").alias("n"), F.sum("_v").alias("v"))


def interval_exposure(windows: DataFrame, intervals: DataFrame, by: Sequence[str], window_id: Sequence[str],
                      start: str, stop: str, value: str, interval_start: str, interval_end: str,
                      min_coverage: float = 50.0) -> DataFrame:
    """Overlap-weighted mean of interval values per window [start, stop), and the coverage percent.

    Interval ends are inclusive days. The density is looked up for the days of the windows only, each once however many
    windows share it, so the join with the window days is one to many whatever the number of intervals.
    """
    by = list(by)
    days = windows.select(*by, *window_id, F.datediff(stop, start).alias("_len"),
                          F.explode(F.sequence(F.col(start), F.date_sub(stop, 1))).alias("day"))
    daily = interval_density(days, intervals, by, interval_start, interval_end, value).select(
        *by, "day", F.col("n").alias("_n"), F.col("v").alias("_v"))
    joined = days.join(daily, [*by, "day"], "left")
    out = joined.groupBy(*by, *window_id).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("overlap_days"), F.sum("_v").alias("_sum"), F.first("_len").alias("_len"))
    coverage = 100.0 * F.col("overlap_days") / F.col("_len")
    return out.select(
        *by, *window_id, "overlap_days", coverage.alias("coverage_pct"),
        F.when(coverage >= min_coverage, F.col("_sum") / F.col("overlap_days")).alias("mean_value"))


def around(events: DataFrame, facts: DataFrame, by: Sequence[str], event_ts: str, fact_ts: str, before_s: int,
           after_s: int, aggregates: Mapping[str, Column]) -> DataFrame:
    """Aggregate the facts within a band around each event. Events spread to the buckets they touch."""
    by = list(by)
    before, after = F.lit(before_s * 1_000_000), F.lit(after_s * 1_000_000)
    width = F.lit((before_s + after_s) * 1_000_000)
    low = F.floor((micros(event_ts) - before) / width)
    high = F.floor((micros(event_ts) + after) / width)
    keys = [c for c in events.columns]
    spread = events.withColumn("_e", micros(event_ts)).withColumn("_bucket", F.explode(F.sequence(low, high)))
    names = [c for c in facts.columns if c not in by]
    side = facts.select(*by, *[F.col(c).alias(f"fact_{c}") for c in names]).withColumn(
        "_f", micros(f"fact_{fact_ts}")).withColumn("_bucket", F.floor(F.col("_f") / width))
    near = spread.join(side, [*by, "_bucket"]).where(
        (F.col("_f") >= F.col("_e") - before) & (F.col("_f") <= F.col("_e") + after))
    got = near.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return events.join(got, keys, "left")


def first_after(df: DataFrame, s: Series, is_event: Column, crossing: Column, gap: Column | float,
                within_s: float) -> DataFrame:
    """For each event row: the first row from it on that crosses within the limit, the hours to it and
    whether the path has a gap. ``gap`` marks rows that follow one, or is the limit in seconds between
    two rows. One slice summary, no join of rows."""
    if isinstance(gap, Column):
        df, lagged, follows = df.withColumn("_gap", gap), {s.time: "_before", "_gap": "_gap_before"}, F.coalesce(F.col("_gap"), F.lit(False))
    else:
        lagged, follows = {s.time: "_before"}, F.coalesce(elapsed(s.time, "_before") > gap, F.lit(False))
    found = done(runs(df, s, lagged, follows, {"_hit": (crossing, s.key)})).where(is_event)
    hours = elapsed(F.col("_hit")[s.time], s.time) / 3600
    ok = elapsed(F.col("_hit")[s.time], s.time) <= within_s
    return found.withColumns({
        "crossed_at": F.when(ok, F.col("_hit")[s.time]), "hours_to_crossing": F.when(ok, hours),
        "path_has_gap": F.when(ok, F.coalesce(F.col("_next.key") <= F.col("_hit"), F.lit(False))),
    }).drop("_hit", "_gap", *lagged.values(), "_break", "_run", "_next", "_last_at")


def at_offsets(events: DataFrame, facts: DataFrame, by: Sequence[str], ts: str, value: str,
               hours: Sequence[int]) -> DataFrame:
    """Exact values at fixed hour offsets after each event; one column per offset."""
    by = list(by)
    keys = events.columns
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    spread = events.withColumn("_h", F.explode(F.array(*[F.lit(h) for h in hours]))).withColumn(
        "_at", micros + F.col("_h").cast("long") * F.lit(3_600_000_000))
    side = facts.select(*by, micros.alias("_at"), F.col(value).alias("_v"))
    joined = spread.join(side, [*by, "_at"], "left")
    return joined.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_h") == h, F.col("_v"))).alias(f"{value}_{h}h") for h in hours])


def missing_slots(df: DataFrame, by: Sequence[str], ts: str, step_s: int) -> tuple[DataFrame, DataFrame]:
    """(grid slots without a row, rows off the grid). The grid of an entity starts at its first row."""
    by = list(by)
    sec = F.unix_seconds(F.col(ts).cast("timestamp"))
    span = df.groupBy(*by).agg(F.min(sec).alias("_lo"), F.max(sec).alias("_hi"))
    # Two explosions: the day starts, then the slots of one day, so no single array is long.
    per_day = max(1, 86400 // step_s)
    steps = F.floor((F.col("_hi") - F.col("_lo")) / step_s)
    grid_rows = (
        span.withColumn("_steps", steps)
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor(F.col("_steps") / per_day))))
        .withColumn("_k", F.explode(F.sequence(F.col("_block") * per_day, F.least(
            F.col("_steps"), F.col("_block") * per_day + per_day - 1))))
        .select(*by, (F.col("_lo") + F.col("_k") * step_s).alias("_sec"))
    )
    seen = df.select(*by, sec.alias("_sec")).distinct()
    missing = grid_rows.join(seen, [*by, "_sec"], "left_anti").withColumn("slot", F.timestamp_seconds("_sec")).drop("_sec")
    off = df.withColumn("_sec", sec).join(span.select(*by, "_lo"), by).where(
        (F.col("_sec") - F.col("_lo")) % step_s != 0).drop("_sec", "_lo")
    return missing, off


def keep_flagged(df: DataFrame, flagged: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(flagged, list(on), "left_semi")


def fk_check(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Child keys without a parent, with the number of child rows."""
    return child.join(parent, list(keys), "left_anti").groupBy(*keys).agg(F.count("*").alias("orphans"))


# Names of the stages between bloom and harvest, in order.
STAGE_NAMES = (
    "before_window", "pre_bloom_90d", "fruit_0_29d", "fruit_30_59d", "fruit_60_89d", "fruit_90_to_harvest",
    "on_or_after_harvest",
)


def stage_overlap(events: DataFrame, cohorts: DataFrame, entity: str, day: str, year: str, month: str,
                  ages: Sequence[int]) -> DataFrame:
    """Percent of the possible harvest days of a month that put the event day into each stage.

    Counted as interval lengths: the harvest days for which the age at the event lies in [a, b) form one
    interval, clipped to the month. Cohorts of the event year and the year after are joined by key.
    """
    spread = events.select(entity, day, F.explode(F.array(F.year(day), F.year(day) + 1)).alias(year))
    both = spread.join(cohorts.select(entity, F.col(year).cast("int").alias(year), month), [entity, year])
    both = both.withColumn("age", F.explode(F.array(*[F.lit(a) for a in ages])))
    first = F.unix_date(F.make_date(year, month, F.lit(1)))
    last = F.unix_date(F.last_day(F.make_date(year, month, F.lit(1))))
    both = both.withColumns({"_first": first, "_last": last, "_e": F.unix_date(day)})
    edges = [None, F.lit(-90), F.lit(0), F.lit(30), F.lit(60), F.lit(90), F.col("age"), None]
    size = F.col("_last") - F.col("_first") + 1
    out = {}
    for name, a, b in zip(STAGE_NAMES, edges, edges[1:]):
        # age at event = e - harvest + age, so harvest <= e + age - a and harvest > e + age - b.
        top = F.col("_last") if a is None else F.least(F.col("_last"), F.col("_e") + F.col("age") - a)
        low = F.col("_first") if b is None else F.greatest(F.col("_first"), F.col("_e") + F.col("age") - b + 1)
        out[name] = F.greatest(F.lit(0), top - low + 1) * 100.0 / size
    return both.withColumns(out).drop("_first", "_last", "_e")


def period_report(measures: DataFrame, phases: DataFrame, events: DataFrame, entity: str, year: str, month: str
                  ) -> DataFrame:
    """Monthly measures with the calendar phases whose month list holds the month, dated events of the
    month, and the same month of all entities side by side (count and mean)."""
    phase = phases.withColumn(month, F.explode("months")).groupBy(month).agg(
        F.array_join(F.array_sort(F.collect_set("phase")), ",").alias("phases"))
    dated = events.groupBy(entity, F.year("day").alias(year), F.month("day").alias(month)).agg(
        F.count("*").alias("events"))
    value = [c for c in measures.columns if c not in (entity, year, month)]
    peers = measures.groupBy(year, month).agg(
        F.count("*").alias("entities"), *[F.avg(c).alias(f"all_{c}") for c in value])
    return (
        measures.join(phase, [month], "left").join(dated, [entity, year, month], "left").join(peers, [year, month], "left")
        .withColumn("events", F.coalesce(F.col("events"), F.lit(0)))
    )


def compare_entities(df: DataFrame, entity: str, day: str, measure: str, a, b) -> DataFrame:
    """Two entities side by side on the days of the first; one pass, nulls kept."""
    mine = df.where(F.col(entity).isin(a, b))
    wide = mine.groupBy(day).agg(
        F.max(F.when(F.col(entity) == a, F.col(measure))).alias("value_a"),
        F.max(F.when(F.col(entity) == b, F.col(measure))).alias("value_b"),
        F.bool_or(F.col(entity) == a).alias("_has_a"))
    return wide.where("_has_a").drop("_has_a").withColumn("difference", F.col("value_b") - F.col("value_a"))
