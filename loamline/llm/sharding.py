"""Reproducible shuffle and shards by a Feistel permutation of global row numbers."""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

from pyspark.sql import Column, DataFrame, functions as F

from loamline.llm.numbering import number_rows


@dataclass(frozen=True)
class Feistel:
    """A permutation of 0 .. n - 1. Numbers are pairs (left, right) of a grid of ``a`` x ``b`` >= n cells; each round
    adds a hash of one half to the other. A number that leaves 0 .. n - 1 walks on along its cycle until it is back."""

    n: int
    seed: int = 0
    rounds: int = 4

    @property
    def grid(self) -> tuple[int, int]:
        """The grid near the square with the fewest cells beyond n, so that few numbers have to walk."""
        root = isqrt(max(self.n - 1, 0)) + 1
        a = min(range(root, root + 256), key=lambda side: (side * -(-self.n // side), side))
        return a, max(1, -(-self.n // a))

    def _pass(self, x: Column, back: bool) -> Column:
        a, b = self.grid
        right = x % b
        left = F.call_function("div", x - right, F.lit(b))
        sign = -1 if back else 1
        for i in reversed(range(self.rounds)) if back else range(self.rounds):
            if i % 2:
                right = F.pmod(right + sign * F.pmod(F.xxhash64(left, F.lit(self.seed * 64 + i)), F.lit(b)), F.lit(b))
            else:
                left = F.pmod(left + sign * F.pmod(F.xxhash64(right, F.lit(self.seed * 64 + i)), F.lit(a)), F.lit(a))
        return left * b + right

    def _walk(self, x: Column, back: bool) -> Column:
        a, b = self.grid
        beyond = a * b - self.n
        once = self._pass(x, back)
        if not beyond:
            return once
        # A cycle visits each of the cells beyond n once at most, which bounds the walk exactly.
        step = lambda y, _: F.when(y >= self.n, self._pass(y, back)).otherwise(y)
        return F.when(once < self.n, once).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(beyond)), once, step))

    def forward(self, x: Column) -> Column:
        return self._walk(x.cast("long"), False)

    def backward(self, y: Column) -> Column:
        return self._walk(y.cast("long"), True)


def place(number: Column, permutation: Feistel, shards: int) -> tuple[Column, Column]:
    """Shard and slot of a row number: the shards take turns along the permuted order."""
    at = permutation.forward(number)
    return (at % shards).cast("int"), F.call_function("div", at, F.lit(shards)).cast("long")


def number_at(shard: Column, slot: Column, permutation: Feistel, shards: int) -> Column:
    """The row number that a shard and slot hold: ``place`` backwards."""
    return permutation.backward(slot.cast("long") * shards + shard)


def shuffled_shards(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """``df`` with row_number, shard and slot. Shard sizes differ by one row at most and slots are gapless from 0.

    The same rows give the same result whatever their order or partitions. Equal rows are interchangeable; null columns
    are values like any other; an empty table gives an empty result. Columns of ``df`` named like the added ones are
    replaced. Columns have to be groupable (no maps).
    """
    plain = df.drop("row_number", "shard", "slot")
    rows = plain.count()
    shard, slot = place(F.col("row_number"), Feistel(rows, seed), shards)
    return number_rows(plain, rows).withColumns({"shard": shard, "slot": slot})
