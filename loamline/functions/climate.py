"""Physical and numeric column expressions. All stay inside generated JVM code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088
EARTH_RADIUS_M = 6371008.8


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c, low, high) -> Column:
    """Null stays null: ``greatest``/``least`` alone would skip it."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def non_negative(c) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def close(a, b, tol: float) -> Column:
    return F.abs(col(a) - col(b)) <= F.lit(tol)


def finite(c) -> Column:
    """NaN and infinities become null."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def saturation_kpa(t) -> Column:
    t = col(t)
    return F.lit(0.6108) * F.exp(F.lit(17.27) * t / (t + F.lit(237.3)))


def vpd(t, rh) -> Column:
    """Vapour pressure deficit in kPa, null outside -10..60 C or 0..100 %."""
    t, rh = col(t), col(rh)
    return F.when(t.between(-10, 60) & rh.between(0, 100), saturation_kpa(t) * (1 - rh / 100))


def daily_vpd(tmin, tmax, rh) -> Column:
    """Daily deficit from the mean of both saturation pressures; null for an unusable row."""
    tmin, tmax, rh = col(tmin), col(tmax), col(rh)
    ok = (tmin <= tmax) & tmin.between(-10, 60) & tmax.between(-10, 60) & rh.between(0, 100)
    return F.when(ok, (saturation_kpa(tmin) + saturation_kpa(tmax)) / 2 * (1 - rh / 100))


def daily_vpd_issue(tmin, tmax, rh) -> Column:
    """Why ``daily_vpd`` is null: a reversed range is an error, a missing value is not."""
    tmin, tmax, rh = col(tmin), col(tmax), col(rh)
    return (
        F.when(tmin.isNull() | tmax.isNull() | rh.isNull(), "missing")
        .when(tmin > tmax, "reversed_temperature")
        .when(daily_vpd(tmin, tmax, rh).isNull(), "out_of_range")
    )


def et0(tmin, tmax, rh, u2, rn, pressure) -> Column:
    """FAO-56 reference evapotranspiration in mm/day with zero daily soil heat flux."""
    tmin, tmax, rh, u2, rn, pressure = map(col, (tmin, tmax, rh, u2, rn, pressure))
    mean = (tmin + tmax) / 2
    deficit = (saturation_kpa(tmin) + saturation_kpa(tmax)) / 2 * (1 - rh / 100)
    slope = F.lit(4098.0) * saturation_kpa(mean) / ((mean + 237.3) * (mean + 237.3))
    gamma = F.lit(0.000665) * pressure
    top = F.lit(0.408) * slope * rn + gamma * F.lit(900.0) / (mean + 273) * u2 * deficit
    ok = (
        tmin.between(-50, 60) & tmax.between(tmin, F.lit(60)) & rh.between(0, 100) & u2.between(0, 60)
        & rn.between(-20, 40) & pressure.between(50, 110)
    )
    return F.when(ok, F.greatest(F.lit(0.0), top / (slope + gamma * (1 + F.lit(0.34) * u2))))


def cyclic(c, period: float) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * col(c) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(col(c)) for c in (lat1, lon1, lat2, lon2))
    half = F.sin((lat2 - lat1) / 2) ** 2 + F.cos(lat1) * F.cos(lat2) * F.sin((lon2 - lon1) / 2) ** 2
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), half)))


def slope_pct(grid, lat) -> Column:
    """Horn gradient in percent of a row-major 3x3 height array on one-arc-second cells."""
    z = [F.element_at(col(grid), i + 1).cast("double") for i in range(9)]
    dy = math.pi * EARTH_RADIUS_M / (180 * 3600)
    dx = F.lit(dy) * F.cos(F.radians(col(lat)))
    east = (z[2] + 2 * z[5] + z[8] - z[0] - 2 * z[3] - z[6]) / (8 * dx)
    north = (z[6] + 2 * z[7] + z[8] - z[0] - 2 * z[1] - z[2]) / (8 * dy)
    return F.when((F.size(col(grid)) >= 9) & (F.abs(col(lat)) < 90), 100 * F.sqrt(east * east + north * north))


def one_hot(c, vocabulary, prefix: str) -> list[Column]:
    """Fixed vocabulary: an unknown value gives zeros everywhere, a null gives nulls."""
    c = col(c)
    return [F.when(c.isNotNull(), (c == v).cast("double")).alias(f"{prefix}{v}") for v in vocabulary]


def direction(current, previous) -> Column:
    """1 when it rises, 0 when it falls, null on a tie or a missing side."""
    current, previous = col(current), col(previous)
    return F.when(current > previous, 1).when(current < previous, 0)


def sign_with_fallback(c, fallback) -> Column:
    c = col(c)
    return F.when(c > 0, 1).when(c < 0, 0).otherwise(col(fallback))


def reconstruct(raw, lag, arm) -> Column:
    """Prediction on the level scale: the delta arm adds the lag first. Never below zero."""
    raw, lag, arm = col(raw), col(lag), col(arm)
    level = F.when(arm == "delta", raw + lag).when(arm == "level", raw)
    return non_negative(level)


def adjusted_age(heat_z, rain_z, solar_z, index_c, kind, base, amplitude, low=110, high=160) -> Column:
    """Climate-shifted age in whole five-day steps. ``rint`` rounds halves to even."""
    heat = clip(heat_z, -1.0, 1.0)
    wet = clip((col(rain_z) - col(solar_z)) / 2, -1.0, 1.0)
    index = clip(index_c, -1.0, 1.0)
    kind, base = col(kind), col(base)
    driver = (
        F.when(kind == "enso", -index).when(kind == "heat", -heat).when(kind == "wet", wet)
        .when(kind == "local", (wet - heat) / 2).when(kind == "enso_local", (wet - heat - index) / 3)
    )
    moved = clip(base + 5 * F.rint(col(amplitude) * driver / 5), low, high)
    return F.when(kind == "fixed", base.cast("double")).otherwise(moved).cast("int")


def interactions(pairs) -> list[Column]:
    return [(col(a) * col(b)).alias(f"{a}_x_{b}") for a, b in pairs]
