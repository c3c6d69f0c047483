"""Pixel-band arrays through higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamline.functions.climate import col

# Quality-word layout of the 16-day vegetation product.
VALUE_RANGE = (-2000, 10000)
REJECT_BITS = (1 << 8) | (1 << 10) | (1 << 14) | (1 << 15)


def good_pixels(value, reliability, quality) -> Column:
    """array<boolean>: usable pixels by value range, reliability class and quality bits."""
    zipped = F.arrays_zip(col(value).alias("v"), col(reliability).alias("r"), col(quality).alias("q"))

    def usable(p):
        q = p["q"]
        return (
            p["v"].between(*VALUE_RANGE) & (p["r"] == 0) & q.between(0, 65534) & (q.bitwiseAND(3) == 0)
            & (F.shiftright(q, 11).bitwiseAND(7) == 1) & (F.shiftright(q, 6).bitwiseAND(3) != 3)
            & (q.bitwiseAND(REJECT_BITS) == 0)
        )

    return F.transform(zipped, usable)


def kept_values(value, mask) -> Column:
    return F.transform(
        F.filter(F.arrays_zip(col(value).alias("v"), col(mask).alias("m")), lambda p: p["m"]), lambda p: p["v"]
    )


def array_quantile(sorted_values, p: float) -> Column:
    """Linear-interpolation quantile of an ascending array of at least one element."""
    a = col(sorted_values)
    rank = F.lit(p) * (F.size(a) - 1)
    low = F.floor(rank).cast("int")
    lo = F.element_at(a, low + 1)
    hi = F.element_at(a, F.least(low + 2, F.size(a)))
    return lo + (rank - low) * (hi - lo)


def patch_stats(value, mask, scale: float, min_pct: float = 20.0) -> tuple[Column, Column, Column]:
    """Good-pixel percent, scaled mean and tenth percentile; both null below ``min_pct``."""
    kept = F.array_sort(kept_values(value, mask))
    n = F.size(kept)
    pct = F.when(F.size(col(value)) > 0, 100.0 * n / F.size(col(value)))
    usable = (pct >= min_pct) & (n > 0)
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)
    return (
        pct,
        F.when(usable, total * F.lit(scale) / n),
        F.when(usable, array_quantile(F.transform(kept, lambda x: x * F.lit(scale)), 0.1)),
    )
