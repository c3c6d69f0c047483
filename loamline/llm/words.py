"""Words of many texts at once, as NumPy arrays over the bytes of the texts.

A word is a run of bytes other than 0x20 and 0x09-0x0D, so no word is cut inside a UTF-8 character. Words are
represented by 64-bit hashes: the word's bytes as the digits of a number to an odd base, mixed afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
#: Bytes of text taken at once: each Python worker of an executor holds some ten arrays of eight bytes a byte over them.
CHUNK = 1 << 18
M64 = (1 << 64) - 1

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, made longer on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


BYTE_POWERS, WORD_POWERS = Powers(BASE), Powers(0xC2B2AE3D27D4EB4F)


def sums(values: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Running sums with a leading zero of value * base**position, and the inverse powers."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return total, down


class Words:
    """Words of a chunk of texts: ``starts`` and ``ends`` in ``data``, ``hashes``, and ``first``: text i has the words
    from first[i] to first[i + 1]; its bytes begin at ``offsets[i]``."""

    def __init__(self, texts: list[bytes], lower: bool):
        data = b" ".join(texts)
        self.data = np.frombuffer(data.lower() if lower else data, dtype=np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum(lengths, out=self.offsets[1:])
        space = np.ones(len(self.data) + 2, dtype=bool)
        space[1:-1] = SPACE[self.data]
        edges = np.flatnonzero(space[1:] != space[:-1])
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.starts, self.offsets)
        total, down = sums(self.data.astype(np.uint64) + np.uint64(1), BYTE_POWERS)
        self.hashes = mix((total[self.ends] - total[self.starts]) * down[self.starts])

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; positions with fewer words behind them are left out."""
    if len(hashes) < k:
        return np.zeros(0, dtype=np.uint64)
    total, down = sums(hashes, WORD_POWERS)
    return mix((total[k:] - total[:-k]) * down[: len(hashes) - k + 1])


def to_bytes(column: pa.Array) -> list[bytes]:
    """Texts as bytes; a null text is empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together; a longer text stands alone and whole."""
    begin = total = 0
    for i, text in enumerate(texts):
        if i > begin and total + len(text) > size:
            yield begin, i
            begin, total = i, 0
        total += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def signed(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A list per row: row i holds values[bounds[i]:bounds[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))
