"""Aggregations. Partial sums, counts and extremes combine before the shuffle, so a key that holds a large
part of the rows costs no more than any other. Nothing here collects the rows of a group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions.climate import close

from loamline.operators.scan import Series, grouped_quantiles
from loamline.operators.windows import stale_runs
from loamline.session import cut_lineage


def month_length(year, month) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))


def _measures(means: Sequence[str], sums: Sequence[str], extremes: Sequence[str]) -> list[Column]:
    out = [F.avg(c).alias(f"{c}_mean") for c in means]
    out += [F.sum(c).alias(f"{c}_sum") for c in sums]
    for c in extremes:
        out += [F.max(c).alias(f"{c}_max"), F.min(c).alias(f"{c}_min")]
    return out + [F.count(c).alias(f"{c}_days") for c in dict.fromkeys([*means, *sums])]


def monthly_climate(df: DataFrame, by: Sequence[str], day: str, means: Sequence[str] = (), sums: Sequence[str] = (),
                    extremes: Sequence[str] = ()) -> DataFrame:
    """Null-safe monthly means, sums and extremes with valid-day counts and the expected days."""
    out = df.groupBy(*by, F.year(day).alias("year"), F.month(day).alias("month")).agg(*_measures(means, sums, extremes))
    return out.withColumn("expected_days", month_length("year", "month"))


def annual_climate(df: DataFrame, by: Sequence[str], day: str, means: Sequence[str] = (), sums: Sequence[str] = (),
                   extremes: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.year(day).alias("year")).agg(*_measures(means, sums, extremes))


def annual_from_months(df: DataFrame, by: Sequence[str], year: str, month: str, means: Sequence[str],
                       sums: Sequence[str]) -> DataFrame:
    """Day-weighted annual means and annual sums, each only from twelve valid months."""
    rows = df.withColumn("_d", month_length(year, month))
    complete = F.lit(True)
    for c in [*means, *sums]:
        complete = complete & F.col(c).isNotNull()
    return rows.groupBy(*by, year).agg(
        *[F.when(F.count(c) == 12, F.sum(F.col(c) * F.col("_d")) / F.sum(F.when(F.col(c).isNotNull(), F.col("_d")))).alias(c)
          for c in means],
        *[F.when(F.count(c) == 12, F.sum(c)).alias(c) for c in sums],
        F.count_if(complete).alias("complete_months"))


def weighted_mean_covered(df: DataFrame, by: Sequence[str], value: str, weight: str, tol: float = 1e-7) -> DataFrame:
    """Weighted mean only when the weights with a value add to one; the covered weight is kept."""
    covered = F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))
    out = df.groupBy(*by).agg(F.coalesce(covered, F.lit(0.0)).alias("coverage"),
                              F.sum(F.col(value) * F.col(weight)).alias("_s"))
    return out.withColumn("mean", F.when(close("coverage", F.lit(1.0), tol), F.col("_s") / F.col("coverage"))).drop("_s")


def ratio_of_sums(df: DataFrame, by: Sequence[str], top: str, bottom: str, scale: float = 1000.0) -> DataFrame:
    """Ratio of sums over members with both parts; observed and total members are counted."""
    both = F.col(top).isNotNull() & F.col(bottom).isNotNull()
    a, b = F.sum(F.when(both, F.col(top))), F.sum(F.when(both, F.col(bottom)))
    return df.groupBy(*by).agg((a * scale / F.nullif(b, F.lit(0.0))).alias("ratio"), F.count_if(both).alias("observed"),
                               F.count("*").alias("members"))


def share_of_total(df: DataFrame, by: Sequence[str], value: str, name: str = "share") -> DataFrame:
    """Share of the group total. The total is aggregated and joined back, so a large group stays parallel."""
    total = df.groupBy(*by).agg(F.sum(value).alias("_t"))
    return df.join(total, list(by)).withColumn(name, F.col(value) / F.nullif(F.col("_t"), F.lit(0.0))).drop("_t")


def peak_of_group(df: DataFrame, by: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(F.col(value), *[-F.col(o) for o in order])).alias("_r"))
    return best.select(*by, "_r.*")


def climatology_anomaly(df: DataFrame, by: Sequence[str], year: str, month: str, value: str, first: int, last: int,
                        complete: Column | None = None) -> DataFrame:
    """Reference-period monthly mean from complete months only, and each month's difference to it."""
    use = F.col(year).between(first, last) & (F.lit(True) if complete is None else complete)
    normal = df.where(use).groupBy(*by, month).agg(F.avg(value).alias("normal"), F.count(value).alias("normal_years"))
    return df.join(normal, [*by, month], "left").withColumn("anomaly", F.col(value) - F.col("normal"))


def calendar_normals(df: DataFrame, targets: DataFrame, by: Sequence[str], day: str, year: str, values: Sequence[str],
                     years_back: int = 10, min_n: int = 8) -> DataFrame:
    """Calendar-day normals of each target (entity, year) from the years before it only.

    One row per (entity, year, MM-dd). A value is null with fewer than ``min_n`` observations; Feb 29 is
    the mean of Feb 28 and Mar 1. A day serves at most ``years_back`` later years, so it is spread to those.
    """
    by = list(by)
    spread = df.select(*by, F.date_format(day, "MM-dd").alias("mmdd"), *values, F.explode(F.sequence(
        F.year(day) + 1, F.year(day) + years_back)).alias(year))
    wanted = targets.select(*by, F.col(year).cast("int").alias(year)).distinct()
    stats = spread.join(wanted, [*by, year], "left_semi").where("mmdd <> '02-29'").groupBy(*by, year, "mmdd").agg(
        *[F.when(F.count(c) >= min_n, F.avg(c)).alias(c) for c in values])
    near = stats.where(F.col("mmdd").isin("02-28", "03-01"))
    leap = near.groupBy(*by, year).agg(
        *[F.when(F.count(c) == 2, F.sum(c) / 2).alias(c) for c in values]).withColumn("mmdd", F.lit("02-29"))
    return stats.unionByName(leap)


def robust_stats(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Median, MAD, quartiles and usability per feature: (by, feature, n, median, mad, q1, q3, usable)."""
    by = list(by)
    tall = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                                              for c in columns])).alias("m")).select(*by, "m.*").where("value is not null")
    keys = [*by, "feature"]
    # Equal readings are one row from here on; the deviations are taken from these rows.
    counted = cut_lineage(tall.groupBy(*keys, "value").agg(F.count("*").alias("rows")))
    # One row per feature, used three times below: written once instead of computed three times.
    quartiles = cut_lineage(grouped_quantiles(counted, keys, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75, "_low": 0.0, "_high": 1.0}, "rows"))
    centred = counted.join(quartiles.select(*keys, "median"), keys).withColumn("dev", F.abs(F.col("value") - F.col("median")))
    mad = grouped_quantiles(centred, keys, "dev", {"mad": 0.5}, "rows").drop("n")
    return quartiles.join(mad, keys).withColumn("usable", (F.col("mad") > 0) & (F.col("_low") < F.col("_high"))).drop("_low", "_high")


def daily_sensor(df: DataFrame, by: Sequence[str], ts: str, tie: str, value: str, flags: Sequence[str] = (),
                 positives: Sequence[str] = ()) -> DataFrame:
    key = F.struct(ts, tie)
    known = F.when(F.col(value).isNotNull(), key)
    return df.groupBy(*by, F.to_date(ts).alias("day")).agg(
        F.count("*").alias("rows"), F.min(value).alias("min_value"), F.max(value).alias("max_value"),
        F.min_by(value, known).alias("first_value"), F.max_by(value, known).alias("last_value"),
        *[F.count_if(F.col(c)).alias(f"{c}_rows") for c in flags],
        *[F.count_if(F.col(c) > 0).alias(f"{c}_positive_rows") for c in positives],
        *[F.count(c).alias(f"{c}_available_rows") for c in positives])


def environment_risk_daily(df: DataFrame, s: Series, signature: Sequence[str], soil: str, humidity: str, rain: str,
                           light: str, zone: str = "UTC", stale_minutes: float = 60, soil_limit: float = 43.5,
                           humidity_limit: float = 75, high: float = 0.5, medium: float = 0.2,
                           sample_hours: float = 0.25) -> DataFrame:
    """Daily risk per entity from readings that are complete and not stuck."""
    flagged = stale_runs(df, s, signature, stale_minutes)
    usable = F.col("stale_minutes").isNotNull() & ~F.col("stale")
    points = (F.coalesce(F.col(soil) >= soil_limit, F.lit(False)).cast("int")
              + F.coalesce(F.col(humidity) >= humidity_limit, F.lit(False)).cast("int")
              + (F.coalesce(F.col(rain), F.lit(0.0)) > 0).cast("int"))
    rows = flagged.withColumns({"_usable": usable, "_alert": usable & (points >= 2),
                                "day": F.to_date(F.from_utc_timestamp(s.time, zone))})

    def used(c):
        return F.when(F.col("_usable"), F.col(c))

    out = rows.groupBy(*s.by, "day").agg(
        F.count("*").alias("readings"), F.count_if("_usable").alias("usable"), F.count_if("stale").alias("stale"),
        F.avg(soil).alias("mean_soil"), F.avg(used(humidity)).alias("mean_humidity"),
        F.sum(F.coalesce(used(rain), F.lit(0.0))).alias("rain_sum"), F.avg(used(light)).alias("mean_light"),
        F.max(used(light)).alias("max_light"), (F.sum(used(light)) * sample_hours / 1000).alias("light_exposure"),
        F.count_if("_alert").alias("alerts"))
    rate = F.coalesce(F.col("alerts") / F.nullif(F.col("usable"), F.lit(0)), F.lit(0.0))
    return out.withColumn("alert_rate", rate).withColumn(
        "risk_level", F.when(F.col("alert_rate") >= high, "high").when(F.col("alert_rate") >= medium, "medium").otherwise("low"))


def hour_end(ts: str) -> Column:
    """Right-closed, right-labelled hour: a reading on the hour belongs to the bucket it closes."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return F.timestamp_seconds(F.ceil(micros / F.lit(3_600_000_000)) * 3600)


def hourly_mean(df: DataFrame, by: Sequence[str], ts: str, values: Sequence[str], min_n: int = 3,
                closed: str = "right") -> DataFrame:
    """Hourly means, null with fewer than ``min_n`` values."""
    bucket = hour_end(ts) if closed == "right" else F.date_trunc("hour", F.col(ts).cast("timestamp"))
    return df.groupBy(*by, bucket.alias("hour")).agg(
        *[F.when(F.count(c) >= min_n, F.avg(c)).alias(c) for c in values], *[F.count(c).alias(f"{c}_n") for c in values])


def history_rollup(df: DataFrame, by: Sequence[str], ts: str, tie: str, values: Sequence[str], lasts: Sequence[str] = (),
                   maxima: Sequence[str] = (), fill_grid: bool = True) -> DataFrame:
    """Daily means of hourly means (every hour counts once, not every packet), the last value of rolling
    windows, peaks, packet counts, and a gap-free day grid."""
    by = list(by)
    at = F.col(ts).cast("timestamp")
    key = F.struct(ts, tie)
    hourly = df.groupBy(*by, F.date_trunc("hour", at).alias("_h")).agg(
        F.count("*").alias("_rows"), *[F.avg(c).alias(c) for c in values], *[F.count(c).alias(f"_n_{c}") for c in values],
        *[F.max(F.when(F.col(c).isNotNull(), F.struct(key.alias("k"), F.col(c).alias("v")))).alias(f"_l_{c}") for c in lasts],
        *[F.max(c).alias(f"_x_{c}") for c in maxima])
    daily = hourly.groupBy(*by, F.to_date("_h").alias("day")).agg(
        F.sum("_rows").alias("raw_count"), *[F.avg(c).alias(f"{c}_mean") for c in values],
        *[F.sum(f"_n_{c}").alias(f"{c}_count") for c in values], *[F.max(f"_l_{c}")["v"].alias(f"{c}_last") for c in lasts],
        *[F.max(f"_x_{c}").alias(f"{c}_peak") for c in maxima])
    if not fill_grid:
        return daily
    span = daily.groupBy(*by).agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
    days = span.select(*by, F.explode(F.sequence("_a", "_b")).alias("day"))
    full = days.join(daily, [*by, "day"], "left")
    counts = ["raw_count", *[f"{c}_count" for c in values]]
    return full.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})


def error_columns(actual: str, predicted: str) -> list[Column]:
    e = F.col(predicted) - F.col(actual)
    return [F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias")]


def error_metrics(df: DataFrame, by: Sequence[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(*by).agg(*error_columns(actual, predicted))


def error_metrics_ext(df: DataFrame, by: Sequence[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Adds WAPE, R2, MAPE over positive actuals, and the median, p90 and largest absolute error."""
    by = list(by)
    a, p = F.col(actual), F.col(predicted)
    rows = df.where(a.isNotNull() & p.isNotNull()).withColumn("_abs", F.abs(p - a))
    # Centred sums keep R2 exact: the mean comes first.
    mean = rows.groupBy(*by).agg(F.avg(a).alias("_mean"))
    centred = rows.join(mean, by) if by else rows.crossJoin(F.broadcast(mean))
    base = centred.groupBy(*by).agg(
        *error_columns(actual, predicted), F.max("_abs").alias("max_abs"),
        (100 * F.sum("_abs") / F.nullif(F.sum(F.abs(a)), F.lit(0.0))).alias("wape_pct"),
        (1 - F.sum((p - a) * (p - a)) / F.nullif(F.sum((a - F.col("_mean")) * (a - F.col("_mean"))), F.lit(0.0))).alias("r2"),
        (100 * F.avg(F.when(a > 0, F.col("_abs") / a))).alias("mape_pct"))
    spread = grouped_quantiles(rows, by, "_abs", {"median_abs": 0.5, "p90_abs": 0.9}).drop("n")
    return base.join(spread, by) if by else base.crossJoin(F.broadcast(spread))


def metrics_by(df: DataFrame, grains: Sequence[Sequence[str]], keys: Sequence[str], actual: str = "actual",
               predicted: str = "predicted") -> DataFrame:
    """The same metrics at several grains in one pass; a null key means all values of it."""
    sets = [[F.col(c) for c in grain] for grain in grains]
    return df.groupingSets(sets, *keys).agg(F.grouping_id().alias("grain"), *error_columns(actual, predicted))


def paired_gain(df: DataFrame, pair: Sequence[str], by: Sequence[str], model: str, base: str, actual: str = "actual",
                predicted: str = "predicted", tie: float = 1e-9) -> DataFrame:
    """Every model against the base model on the same keys: wins, ties, losses and relative reductions."""
    e = F.col(predicted) - F.col(actual)
    errors = df.select(*pair, *by, model, F.abs(e).alias("_e"), (e * e).alias("_q"))
    left = errors.where(F.col(model) == base).select(*pair, *by, F.col("_e").alias("_eb"), F.col("_q").alias("_qb"))
    both = errors.where(F.col(model) != base).join(left, [*pair, *by]).withColumn("_gain", F.col("_eb") - F.col("_e"))
    keys = [*by, model]
    out = both.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("_gain") > tie).alias("wins"), F.count_if(F.abs("_gain") <= tie).alias("ties"),
        F.count_if(F.col("_gain") < -tie).alias("losses"), F.avg("_gain").alias("mean_gain"),
        (100 * (1 - F.avg("_e") / F.nullif(F.avg("_eb"), F.lit(0.0)))).alias("mae_reduction_pct"),
        (100 * (1 - F.sqrt(F.avg("_q")) / F.nullif(F.sqrt(F.avg("_qb")), F.lit(0.0)))).alias("rmse_reduction_pct"))
    return out.join(grouped_quantiles(both, keys, "_gain", {"median_gain": 0.5}).drop("n"), keys)


def class_metrics(df: DataFrame, by: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """Two-class confusion counts and scores; a zero denominator scores zero."""
    a, p = F.col(actual), F.col(predicted)
    out = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if((a == 1) & (p == 1)).alias("tp"), F.count_if((a == 0) & (p == 0)).alias("tn"),
        F.count_if((a == 0) & (p == 1)).alias("fp"), F.count_if((a == 1) & (p == 0)).alias("fn"))

    def ratio(x, y):
        return F.when(y > 0, x / y).otherwise(0.0)

    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    recall1, recall0 = ratio(tp, tp + fn), ratio(tn, tn + fp)
    # Balanced accuracy averages only over classes that occur.
    present = (tp + fn > 0).cast("int") + (tn + fp > 0).cast("int")
    return out.withColumns({
        "accuracy": (tp + tn) / F.col("n"), "balanced_accuracy": (recall1 + recall0) / present,
        "precision1": ratio(tp, tp + fp), "recall1": recall1, "f1_1": ratio(2 * tp, 2 * tp + fp + fn),
        "precision0": ratio(tn, tn + fn), "recall0": recall0, "f1_0": ratio(2 * tn, 2 * tn + fp + fn),
    }).withColumn("macro_f1", (F.col("f1_1") + F.col("f1_0")) / 2)


def pivot_items(df: DataFrame, by: Sequence[str], item: str, value: str, items: Sequence[str]) -> DataFrame:
    """Long measures to one column per item; the item list is fixed, so no extra pass finds it."""
    return df.groupBy(*by).pivot(item, list(items)).agg(F.first(value, ignorenulls=True))


def unpivot_metrics(df: DataFrame, ids: Sequence[str], statuses: Sequence[str], metrics: Sequence[str],
                    total: str | None = None, parts: Sequence[str] = (), tol: float = 0.051) -> DataFrame:
    """``status_metric`` columns to tidy rows; ``sums_ok`` compares the parts with the printed total."""
    cells, checks = [], {}
    for m in metrics:
        if total:
            gap = sum((F.col(f"{p}_{m}") for p in parts), F.lit(0.0)) - F.col(f"{total}_{m}")
            checks[m] = F.abs(gap) <= tol
        cells += [F.struct(F.lit(s).alias("status"), F.lit(m).alias("metric"), F.col(f"{s}_{m}").cast("double").alias("value"),
                           checks.get(m, F.lit(None).cast("boolean")).alias("sums_ok")) for s in statuses]
    return df.select(*ids, F.explode(F.array(*cells)).alias("c")).select(*ids, "c.*")


def collapse_registry(df: DataFrame, key: Sequence[str], x: str, y: str, metadata: Sequence[str], order: Sequence[str]
                      ) -> DataFrame:
    """One row per registry key: member count, whether its members disagree on the coordinate or on the
    metadata, and the first member by source order. Disagreement is seen from extremes, so no set is built."""
    def varies(c: Column) -> Column:
        return (F.min(c) != F.max(c)) | (F.count(c) != F.count("*")) & (F.count(c) > 0)

    pair = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.struct(x, y))
    conflict = F.lit(False)
    for m in metadata:
        conflict = conflict | F.coalesce(varies(F.col(m)), F.lit(False))
    rest = [c for c in df.columns if c not in key]
    out = df.groupBy(*key).agg(
        F.count("*").alias("members"), F.coalesce(varies(pair), F.lit(False)).alias("coordinate_conflict"),
        conflict.alias("metadata_conflict"), F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return out.select(*key, "members", "coordinate_conflict", "metadata_conflict", *[F.col("_row")[c].alias(c) for c in rest])


def exclusion_accounting(df: DataFrame, by: Sequence[str], reason: str, members: str) -> DataFrame:
    """Per entity: source rows, kept keys, collapsed duplicates, excluded rows, and whether they add up."""
    kept = F.col(reason).isNull()
    out = df.groupBy(*by).agg(
        F.sum(members).alias("source_rows"), F.count_if(kept).alias("kept"),
        F.coalesce(F.sum(F.when(kept, F.col(members) - 1)), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum(F.when(~kept, F.col(members))), F.lit(0)).alias("excluded"))
    return out.withColumn("adds_up", F.col("source_rows") == F.col("kept") + F.col("duplicates") + F.col("excluded"))


def shared_coordinate(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Flag keys that share their exact coordinate with another key."""
    places = df.groupBy(x, y).agg((F.min(key) != F.max(key)).alias("shared_coordinate"))
    return df.join(places, [x, y], "left").withColumn("shared_coordinate", F.coalesce("shared_coordinate", F.lit(False)))


def hazard_summary(df: DataFrame, by: Sequence[str], unit: str, value: str) -> DataFrame:
    """Repeated unit ids are quarantined; among the rest blanks, explicit zeros and positives are counted
    and known values summed (null when none is known)."""
    units = df.groupBy(*by, unit).agg(F.count("*").alias("_n"), F.max(value).alias("_v"))
    once = F.col("_n") == 1
    v = F.when(once, F.col("_v"))
    return units.groupBy(*by).agg(
        F.sum("_n").alias("source_rows"), F.coalesce(F.sum(F.when(~once, F.col("_n"))), F.lit(0)).alias("quarantined_rows"),
        F.count(v).alias("known_units"), F.count_if(once & F.col("_v").isNull()).alias("blank_units"),
        F.count_if(v == 0).alias("zero_units"), F.count_if(v > 0).alias("positive_units"), F.sum(v).alias("known_sum"))


def weighted_summary(df: DataFrame, by: Sequence[str], weight: str, values: Sequence[str]) -> DataFrame:
    """Weight-averaged values; null if any member's value is null."""
    return df.groupBy(*by).agg(F.sum(weight).alias("total_weight"), *[
        F.when(F.count(c) == F.count("*"), F.sum(F.col(weight) * F.col(c)) / F.nullif(F.sum(weight), F.lit(0.0))).alias(c)
        for c in values])


def training_seasons(df: DataFrame, by: Sequence[str], year: str, month: str, value: str, cutoff: int) -> DataFrame:
    """Three-month season around each entity's peak month of the years up to the cutoff."""
    totals = df.where(F.col(year) <= cutoff).groupBy(*by, month).agg(F.sum(value).alias("_t"))
    peak = totals.groupBy(*by).agg(F.max_by(month, F.struct("_t", -F.col(month))).alias("peak_month"))
    return peak.withColumn("season_start", F.greatest(F.lit(1), F.least(F.lit(10), F.col("peak_month") - 1)))


def peak_window(df: DataFrame, by: Sequence[str], month: str, value: str, width: int = 3) -> DataFrame:
    """Best window of consecutive months per group; the earliest wins. A missing month adds nothing."""
    last = 12 - width + 1
    starts = F.filter(F.sequence(F.col(month) - width + 1, F.col(month)), lambda s: s.between(1, last))
    spread = df.select(*by, F.col(value).alias("_v"), F.explode(starts).alias("start_month"))
    totals = spread.groupBy(*by, "start_month").agg(F.sum("_v").alias("window_total"))
    best = totals.groupBy(*by).agg(F.max_by(F.struct("start_month", "window_total"), F.struct("window_total", -F.col("start_month"))).alias("_b"))
    return best.select(*by, "_b.*")


def coverage(df: DataFrame, by: Sequence[str], day: str, columns: Sequence[str]) -> DataFrame:
    """First and last valid day, valid and missing days per parameter."""
    tall = df.select(*by, day, F.explode(F.array(*[
        F.struct(F.lit(c).alias("parameter"), F.col(c).isNotNull().alias("ok")) for c in columns])).alias("m")).select(*by, day, "m.*")
    valid = F.when(F.col("ok"), F.col(day))
    return tall.groupBy(*by, "parameter").agg(
        F.min(valid).alias("first_valid"), F.max(valid).alias("last_valid"), F.count_if("ok").alias("valid_days"),
        F.count_if(~F.col("ok")).alias("missing_days"))


def collect_attrs(df: DataFrame, by: Sequence[str], columns: Sequence[str], separator: str = " / ") -> DataFrame:
    """Distinct attribute values per class, sorted and joined. Values are reduced to distinct ones first,
    and there are as many as the attribute's vocabulary."""
    out = None
    for c in columns:
        values = df.where(F.coalesce(F.trim(F.col(c)), F.lit("")) != "").groupBy(*by, F.trim(F.col(c)).alias("_v")).agg(F.lit(1))
        part = values.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("_v")), separator).alias(c))
        out = part if out is None else out.join(part, list(by), "full_outer")
    return out


def composition(df: DataFrame, by: Sequence[str], unit: str, area: str, whole: DataFrame, whole_area: str,
                uncovered: str = "UNCOVERED") -> DataFrame:
    """Shares of each unit in the whole, with a row for the uncovered rest; the shares add to 100."""
    parts = df.groupBy(*by, unit).agg(F.sum(area).alias("area"))
    covered = parts.groupBy(*by).agg(F.sum("area").alias("_c"))
    rest = whole.join(covered, list(by), "left").select(
        *by, F.lit(uncovered).alias(unit), (F.col(whole_area) - F.coalesce("_c", F.lit(0.0))).alias("area"))
    both = parts.unionByName(rest).join(whole.select(*by, F.col(whole_area).alias("denominator")), list(by))
    return both.withColumn("share_pct", 100 * F.col("area") / F.col("denominator"))


def fixed_share_allocate(df: DataFrame, totals: DataFrame, by: Sequence[str], member: str, year: str, value: str,
                         total: str, calibration: Sequence[int], blocked: DataFrame | None = None) -> DataFrame:
    """Split each entity total by the members' mean annual share over the calibration years.

    Calibration years are never allocated; ``blocked`` lists (by, year) whose conflicts stop the allocation.
    The allocated parts conserve the total: ``conserved`` compares them.
    """
    by = list(by)
    shares = share_of_total(df.where(F.col(year).isin(*calibration)), [*by, year], value, "_s")
    weights = shares.groupBy(*by, member).agg((F.sum("_s") / len(calibration)).alias("weight"))
    targets = totals.where(~F.col(year).isin(*calibration)).select(*by, year, F.col(total).alias("_total"))
    out = targets.join(weights, by)
    if blocked is not None:
        out = out.join(blocked.select(*by, year).distinct().withColumn("_blocked", F.lit(True)), [*by, year], "left")
    else:
        out = out.withColumn("_blocked", F.lit(None).cast("boolean"))
    out = out.withColumn("allocated", F.when(F.col("_blocked").isNull(), F.col("_total") * F.col("weight")))
    sums = out.groupBy(*by, year).agg(F.sum("allocated").alias("_a"))
    return out.join(sums, [*by, year]).withColumn(
        "conserved", F.abs(F.col("_a") - F.col("_total")) <= 1e-8 * F.greatest(F.lit(1.0), F.abs("_total"))
    ).drop("_a", "_total", "_blocked")


def regime_year(df: DataFrame, by: Sequence[str], year: str, regime: str) -> DataFrame:
    counts = {r: F.count_if(F.col(regime) == r).alias(f"{r}_seasons") for r in ("warm", "cold", "neutral")}
    return df.groupBy(*by, year).agg(
        F.count("*").alias("seasons"), *counts.values(),
        F.array_join(F.array_sort(F.collect_set(regime)), ",").alias("regimes")).withColumn("complete_year", F.col("seasons") == 12)


def bbox(df: DataFrame, by: Sequence[str], x: str = "lon", y: str = "lat") -> DataFrame:
    return df.groupBy(*by).agg(
        F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"),
        F.avg(x).alias("centre_x"), F.avg(y).alias("centre_y"))


def digest_group(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Digest of the multiset of rows of each group, independent of row order.

    Row digests are added up word by word and the sums are hashed. Sums combine before the shuffle, so
    the digest of a huge group needs no sort and no list.
    """
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    hashed = df.select(*keys, row.alias("_h"))
    words = [F.sum(F.conv(F.substring("_h", 1 + 16 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"_w{i}") for i in range(4)]
    sums = hashed.groupBy(*keys).agg(F.count("*").alias("rows"), *words)
    return sums.select(*keys, "rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), *[
        F.col(f"_w{i}").cast("string") for i in range(4)]), 256).alias("digest"))


def distinct_profiles(df: DataFrame, entity: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """How many entities return exactly the same rows."""
    return digest_group(df, entity, columns).groupBy("digest").agg(F.count("*").alias("entities"), F.first("rows").alias("rows"))


def gram(df: DataFrame, columns: Sequence[str], target: str, by: Sequence[str]) -> DataFrame:
    """Sufficient statistics for least squares per group: n, sums and cross products of features and target.

    Centre large columns first (see ``ridge_fit``) so that their squares lose no digits.
    """
    names = [*columns, target]
    aggs = [F.count("*").alias("n")]
    aggs += [F.sum(c).alias(f"s_{i}") for i, c in enumerate(names)]
    aggs += [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p_{i}_{j}") for i in range(len(names)) for j in range(i, len(names))]
    return df.groupBy(*by).agg(*aggs)


def readiness(source: DataFrame, mapped: DataFrame, key: str, planted: str, pure: str, mixed: str) -> DataFrame:
    """Reported against mapped area, and the mixed fraction that would close the gap."""
    joined = source.join(mapped, key)
    p, a, b = F.col(planted), F.col(pure), F.col(mixed)
    fraction = F.when(b > 0, (p - a) / b)
    return joined.withColumns({
        "pure_pct": 100 * a / F.nullif(p, F.lit(0.0)), "all_pct": 100 * (a + b) / F.nullif(p, F.lit(0.0)),
        "mixed_fraction": fraction, "match_possible": F.coalesce(fraction.between(0, 1), F.lit(False))})


def climate_profile(df: DataFrame, by: Sequence[str], columns: Sequence[str], complete: Column) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(c).alias(f"{c}_mean") for c in columns], F.count_if(complete).alias("complete_years"))


def horizon_sums(df: DataFrame, by: Sequence[str], start: str, valid: str, value: str, hours: Sequence[int]) -> DataFrame:
    """Sum over the first n hours after the start, only when every hour is valid; wet and valid hours."""
    offset = F.round((F.unix_seconds(F.col(valid).cast("timestamp")) - F.unix_seconds(F.col(start).cast("timestamp"))) / 3600)
    rows = df.withColumn("_o", offset)
    aggs = []
    for n in hours:
        v = F.when(F.col("_o").between(1, n), F.col(value))
        aggs += [F.count(v).alias(f"valid_{n}h"), F.count_if(v > 0).alias(f"wet_{n}h"),
                 F.when(F.count(v) == n, F.sum(v)).alias(f"sum_{n}h")]
    return rows.groupBy(*by).agg(*aggs)


def week_overview(df: DataFrame, by: Sequence[str], day: str, rain: str) -> DataFrame:
    """Rain days of a forecast week; the total only for seven consecutive valid days."""
    out = df.groupBy(*by).agg(
        F.count("*").alias("days"), F.count(rain).alias("valid_days"), F.count_if(F.col(rain) > 0).alias("_wet"),
        F.sum(rain).alias("_sum"), F.datediff(F.max(day), F.min(day)).alias("_span"), F.count_distinct(day).alias("_distinct"))
    whole = (F.col("days") == 7) & (F.col("_distinct") == 7) & (F.col("_span") == 6) & (F.col("valid_days") == 7)
    return out.withColumns({"rain_days": F.when(F.col("valid_days") > 0, F.col("_wet")),
                            "total_rain": F.when(whole, F.col("_sum"))}).drop("_wet", "_sum", "_span", "_distinct")


def season_profile(df: DataFrame, annual: DataFrame, by: Sequence[str], month: str, value: str, total: str,
                   share_limit: float = 10.0, tol: float = 1.0) -> DataFrame:
    """Peak month and share, months with at least the share limit, reported months, and whether the months
    reconcile with the annual total. At most twelve months meet in a group."""
    shares = share_of_total(df, by, value, "_s").withColumn("_pct", 100 * F.col("_s"))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("_pct") >= share_limit, F.col(month)))), lambda m: m.cast("string"))
    out = shares.groupBy(*by).agg(
        F.max_by(month, F.struct("_pct", -F.col(month))).alias("peak_month"), F.max("_pct").alias("peak_share_pct"),
        F.array_join(listed, ",").alias("material_months"), F.count("*").alias("reported_months"), F.sum(value).alias("_sum"))
    return out.join(annual.select(*by, F.col(total).alias("_total")), list(by), "left").withColumn(
        "reconciled", F.coalesce(F.abs(F.col("_sum") - F.col("_total")) < tol, F.lit(False))).drop("_sum", "_total")


def status_summary(df: DataFrame, by: Sequence[str], status: str) -> DataFrame:
    counts = df.groupBy(*by, status).agg(F.count("*").alias("rows"))
    total = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    # One row per status: the window sees the vocabulary, not the data.
    return counts.withColumn("pct", F.round(100 * F.col("rows") / F.sum("rows").over(total), 2))


