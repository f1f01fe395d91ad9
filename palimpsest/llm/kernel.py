"""Vectorised text work on Arrow string columns: words, window hashes, pre-tokens.

Hashes are 64-bit polynomials over random per-symbol values, so the hash of any window is a
difference of two prefix sums. Two different windows share a hash with a chance near 2**-64.
Texts are worked on in slices of about SLICE bytes, so memory follows the largest document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19
_M = np.uint64(0x9E3779B97F4A7C15 | 1)
_MINV = np.uint64(pow(int(_M), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): each input bit reaches each output bit."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SYMBOL = mix(np.arange(256, dtype=np.uint64) + np.uint64(1 << 32))
_power = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M**i and M**-i modulo 2**64 for i < n at least."""
    global _power, _inverse
    if len(_power) < n:
        size = max(n, 1 << 16, 2 * len(_power) if len(_power) < SLICE else n)
        for base, name in ((_M, "_power"), (_MINV, "_inverse")):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps, dtype=np.uint64)
    return _power, _inverse


def prefix_sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0][: len(values)], out=out[1:], dtype=np.uint64)
    return out


def window_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of values[start:end] for each pair, from prefix_sums(values)."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(np.uint64))


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past last row, bytes, offsets from 0) of consecutive rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def byte_set(*spans: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, set within the inclusive spans."""
    out = np.zeros(256, bool)
    for low, high in spans:
        out[low : high + 1] = True
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """The words of a slice of documents: maximal runs of the bytes in a set.

    start, end: byte spans; hash: of each word; first: doc d has the words first[d]:first[d + 1].
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = True):
        self.data = data = LOWER[data] if lower else data
        flag = inside[data]
        before = np.zeros(len(flag), bool)
        before[1:] = flag[:-1]
        edges = offsets[:-1][offsets[:-1] < len(flag)]
        before[edges] = False
        self.start = np.flatnonzero(flag & ~before)
        after = np.zeros(len(flag), bool)
        after[:-1] = flag[1:]
        cut = offsets[1:] - 1
        after[cut[cut >= 0]] = False
        self.end = np.flatnonzero(flag & ~after) + 1
        self.hash = window_hash(prefix_sums(_SYMBOL[data]), self.start, self.end)
        self.first = np.searchsorted(self.start, offsets)
        self._sums: np.ndarray | None = None

    def grams(self, starts: np.ndarray, k: np.ndarray | int) -> np.ndarray:
        """Hashes of k consecutive words from each start."""
        if self._sums is None:
            self._sums = prefix_sums(self.hash)
        return window_hash(self._sums, starts, starts + k)

    def gram_starts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """All starts of k words within one document, and first[] for these."""
        counts = np.maximum(np.diff(self.first) - (k - 1), 0)
        bounds = np.concatenate(([0], np.cumsum(counts)))
        return np.arange(bounds[-1]) + np.repeat(self.first[:-1] - bounds[:-1], counts), bounds


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def sha256(data: bytes | memoryview) -> str:
    return hashlib.sha256(data).hexdigest()
