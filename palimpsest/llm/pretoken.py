"""The pre-token pattern of byte-level vocabularies, run over whole slices in numpy.

The pattern: contractions after an apostrophe, else an optional space with a run of letters, of
numbers or of other signs, else white space, whose last character is left to what follows. It
reads a character's class only, so tokens are found from the class runs of a slice at once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

from palimpsest.llm import kernel

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Entries of a worker's cache of pre-tokens, of about 60 bytes each; when full, it drops those met only once.
CACHE = 500_000


@lru_cache
def _classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, text):
            low, high = ord(m[0][0]), ord(m[0][-1])
            if high - low + 1 == len(m[0]):
                out[low : high + 1] = kind
            else:  # a run over the surrogates, which no text has
                out[[ord(c) for c in m[0]]] = kind
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of valid UTF-8 and the byte at which each starts."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, lead


def token_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Code points at which a pre-token starts; first: where each non-empty document starts, ascending."""
    n = len(points)
    kind = _classes()[points]
    new_doc = np.zeros(n, bool)
    new_doc[first] = True
    run = new_doc.copy()  # a class run starts
    run[1:] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(run)
    end = np.append(at[1:], n)
    k = kind[at]
    last_of_doc = np.append(new_doc[at[1:]], True)
    is_space = k == SPACE
    # white space before another run of its document leaves its last character to what follows
    leaves = is_space & ~last_of_doc
    tail = end[leaves] - 1
    joins = points[tail] == 0x20
    start = np.zeros(n + 1, bool)
    start[at[is_space & (~leaves | (end - at > 1))]] = True
    start[tail] = True  # alone, or as the space at the head of the next token
    word = ~is_space
    headed = np.zeros(len(at), bool)
    headed[np.flatnonzero(leaves)[joins] + 1] = True
    start[at[word & ~headed]] = True
    # contractions: a lone apostrophe that no space heads, then letters
    lone = np.flatnonzero((k == OTHER) & ~headed & (end - at == 1) & ~last_of_doc & (points[at] == 0x27))
    if len(lone):
        lone = lone[k[lone + 1] == LETTER]
        one = at[lone] + 1
        c1, c2 = points[one], np.where(end[lone + 1] - one > 1, points[np.minimum(one + 1, n - 1)], 0)
        # the order of the alternatives: s, t, re, ve, m, ll, d
        single = np.isin(c1, [ord(c) for c in "stmd"])
        double = np.zeros(len(lone), bool)
        for pair in ("re", "ve", "ll"):
            double |= (c1 == ord(pair[0])) & (c2 == ord(pair[1]))
        hit = single | double
        size = np.where(single, 1, 2)[hit]
        lone, one = lone[hit], one[hit]
        start[one] = False
        past = one + size
        more = past < end[lone + 1]
        start[past[more]] = True
    return np.flatnonzero(start[:n])


def joined(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, one list after the other, and the size of each list."""
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes


class Encoder:
    """Ids of whole texts by a function that encodes distinct pre-tokens (see joined); results are cached."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        #: keys, ascending; the place of each one's ids in the pool, and whether it has been met again
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.again = np.zeros(0, bool)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.filled = 0

    def _forget(self) -> None:
        """Keeps what has been met again, and of that only as much as leaves room for as many others."""
        kept = np.flatnonzero(self.again)[: CACHE // 2]
        ids, size = self.pool[kernel.ranges(self.at[kept], self.size[kept])], self.size[kept]
        self.keys, self.size, self.at = self.keys[kept], size, np.cumsum(size) - size
        self.again = np.zeros(len(kept), bool)
        self.filled, self.pool = len(ids), np.concatenate((ids, np.zeros(1 << 16, np.uint32)))

    def _learn(self, keys: np.ndarray, tokens: list[bytes]) -> None:
        flat, sizes = self.encode(tokens)
        while self.filled + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.filled : self.filled + len(flat)] = flat
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.at = np.insert(self.at, place, self.filled + np.cumsum(sizes) - sizes)
        self.size = np.insert(self.size, place, sizes)
        self.again = np.insert(self.again, place, False)
        self.filled += len(flat)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): document d has ids[bounds[d]:bounds[d + 1]]."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        points, lead = code_points(data)
        lead = np.append(lead, len(data))
        docs = np.searchsorted(lead, offsets)
        first = docs[:-1][np.diff(docs) > 0]
        start = lead[token_starts(points, first)]
        end = np.append(start[1:], len(data))
        keys = kernel.window_hash(kernel.prefix_sums(kernel._SYMBOL[data]), start, end)
        distinct, at, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE:
            self._forget()
        row = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = row < len(self.keys)
        known[inside] = self.keys[row[inside]] == distinct[inside]
        self.again[row[known]] = True
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            j = at[new]
            self._learn(distinct[new], [raw[x:y] for x, y in zip(start[j].tolist(), end[j].tolist(), strict=True)])
            row = np.searchsorted(self.keys, distinct)
        row = row[back]
        size = self.size[row]
        ids = self.pool[kernel.ranges(self.at[row], size)]
        sums = np.concatenate(([0], np.cumsum(size)))
        return ids, sums[np.searchsorted(start, offsets)]
