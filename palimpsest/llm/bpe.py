"""Byte-level BPE by dynamic programming over prefixes.

The encoding of a byte string by ranked merges is the one token sequence in which every two
neighbours could not have merged otherwise. Hence each prefix has one valid last token: the token
that ends there whose start is a prefix with a last token it may stand after. `Vocabulary.last`
fills that table byte by byte, so a string's table holds for all that is appended to it, and a
changed byte only asks for what follows it. Pre-tokens of a batch are taken in sorted order, and
each keeps the table rows of the prefix that it shares with the one before.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernel
from palimpsest.llm.pretoken import Encoder, joined


#: Entries of a worker's table of token pairs that may follow each other; it starts anew when full.
GOOD = 200_000


class Vocabulary:
    """Ranks of a byte-level vocabulary: bytes to id, the id also the rank of the merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes = [b""] * self.size
        for token, i in ranks.items():
            self.bytes[i] = token
        self.longest = max(map(len, ranks))
        self.split: list[tuple[int, int] | None] = [None] * self.size
        self.pairs: dict[int, int] = {}
        self.good: dict[int, bool] = {}
        #: the tokens that merging their own bytes gives
        self.reached = {t: i for t, i in ranks.items() if len(t) == 1}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                ids = self._merge(token)
                if len(ids) == 1:
                    self.reached[token] = i
        self.lengths = self._lengths()

    @classmethod
    @lru_cache
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def _merge(self, token: bytes) -> list[int]:
        """Plain merging of one vocabulary entry, which also tells its last merge."""
        parts, ranks, merged = [token[i : i + 1] for i in range(len(token))], self.ranks, None
        while len(parts) > 1:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            merged = (ranks[parts[at]], ranks[parts[at + 1]])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 1:
            self.split[ranks[token]] = merged
        return [ranks[p] for p in parts]

    def _lengths(self) -> dict[bytes, tuple[int, ...]]:
        """For each last three bytes (or two, or one), the lengths of the tokens that end so, the longest first.

        What ends in three bytes that end no longer token is told by its last two, or has one byte.
        """
        found: dict[bytes, set[int]] = {}
        for token in self.reached:
            found.setdefault(token[-3:], set()).add(len(token))
        # three bytes also end in their last two
        return {k: tuple(sorted(v | {1} | ({2} if k[-2:] in self.reached and len(k) > 1 else set()), reverse=True)) for k, v in found.items()}

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging their joined bytes gives just these two tokens."""
        key = left * self.size + right
        known = self.good.get(key)
        if known is None:
            if len(self.good) > GOOD:
                self.good.clear()
            known = self.good[key] = self._apart(left, right)
        return known

    def _apart(self, a: int, b: int) -> bool:
        """Unmerges the two sides, latest merge first; no merge across them may come before."""
        bytes_, ranks, split = self.bytes, self.ranks, self.split
        limit = self.size
        while True:
            joined = ranks.get(bytes_[a] + bytes_[b])
            if joined is not None and joined < limit:
                return False
            sa, sb = split[a], split[b]
            if sa is None and sb is None:
                return True
            if sb is None or (sa is not None and a > b):
                # the left side's last merge is the later one: before it, its right part stood here
                limit, a = a, sa[1]
            else:
                # among equal ranks the leftmost goes first, so a merge across still wins at its own rank
                limit, b = b + 1, sb[0]

    def last(self, text: bytes, table: list[int], keep: int) -> list[int]:
        """table[i]: the last token of the first i + 1 bytes; the first `keep` entries hold already."""
        del table[keep:]
        reached, lengths, may_follow = self.reached, self.lengths, self.may_follow
        for end in range(keep + 1, len(text) + 1):
            pick = -1
            some = lengths.get(text[max(0, end - 3) : end]) or lengths.get(text[end - 2 : end], (1,)) if end > 1 else (1,)
            for n in some:
                if n > end:
                    continue
                token = reached.get(text[end - n : end])
                if token is not None and (n == end or may_follow(table[end - n - 1], token)):
                    pick = token
                    break
            table.append(pick)
        return table

    def walk(self, table: list[int], end: int) -> list[int]:
        out, bytes_ = [], self.bytes
        while end:
            out.append(table[end - 1])
            end -= len(bytes_[out[-1]])
        return out[::-1]

    def encode(self, tokens: list[bytes]) -> list[list[int]]:
        """Ids of each byte string, all as one pre-token."""
        out: list[list[int]] = [[]] * len(tokens)
        before, table = b"", []
        for i in sorted(range(len(tokens)), key=tokens.__getitem__):
            text, whole = tokens[i], self.ranks.get(tokens[i])
            if whole is not None and text in self.reached:
                out[i] = [whole]
                continue
            same = 0
            for x, y in zip(before, text):  # noqa: B905
                if x != y:
                    break
                same += 1
            table = self.last(text, table, min(same, len(table)))
            before = text
            out[i] = self.walk(table, len(text))
        return out


class Pool:
    """Byte strings by id, to join those of many ids at once."""

    def __init__(self, strings: list[bytes]):
        self.size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def join(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes, and the bounds of each id's string in them."""
        size = self.size[ids]
        return self.data[kernel.ranges(self.at[ids], size)], np.concatenate(([0], np.cumsum(size)))


@lru_cache
def tools(path: str) -> tuple[Vocabulary, Encoder, Pool, Pool]:
    """Per worker: the vocabulary, the encoder with its cache, and the bytes and digits of the ids."""
    vocabulary = Vocabulary.load(path)
    digits = Pool([b"%d," % i for i in range(vocabulary.size)])
    return vocabulary, Encoder(lambda tokens: joined(vocabulary.encode(tokens))), Pool(vocabulary.bytes), digits


ENCODED = "doc_id long, n_tokens long, ids array<int>"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids. Null is empty. Other columns are not read; repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in kernel.slices(batch.column(1)):
                ids, bounds = tools(path)[1](data, offsets)
                lists = pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[low:high], pa.array(np.diff(bounds)), lists], names=["doc_id", "n_tokens", "ids"]
                )

    return documents.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id and the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1)
            flat, bounds = tools(path)[2].join(ids.flatten().to_numpy(zero_copy_only=False))
            at = bounds[np.concatenate(([0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy())))]
            raw = flat.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([raw[x:y] for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                names=["doc_id", "bytes"],
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode(), then decoding of the ids, each row with digests: of the ids as decimals joined by commas, of the bytes.

    One pass, so ids need not be stored. Null and empty texts have no ids and the digests of nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encoder, strings, digits = tools(path)
        for batch in batches:
            for low, high, data, offsets in kernel.slices(batch.column(1)):
                ids, bounds = encoder(data, offsets)
                text, at = strings.join(ids)
                shown, there = digits.join(ids)
                text, shown = memoryview(text), memoryview(shown)
                at, there = at[bounds], there[bounds]
                spans = list(zip(range(high - low), at[:-1].tolist(), at[1:].tolist(), there[:-1].tolist(), there[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[low:high],
                        pa.array(np.diff(bounds)),
                        pa.array([kernel.sha256(shown[x : max(x, y - 1)]) for _, _, _, x, y in spans], pa.string()),
                        pa.array([kernel.sha256(text[x:y]) for _, x, y, _, _ in spans], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return documents.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, DIGESTS)
