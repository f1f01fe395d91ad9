"""Fuzzy line deduplication: SimHash of normalised lines, buckets, and edit similarity.

A line is normalised to its words (letters and digits, A-Z lower-cased, each digit a 0) with single
spaces. Lines of equal normal form are one class. Two classes are linked when the edit distance of
the normal forms is at most 1 - SIMILARITY of the longer one. A candidate pair shares a bucket
and, unless a line has at most SHORT characters, has 128-bit SimHash values, over words, at
most DISTANCE bits apart. An edit changes at most 4 of a line's pairs of neighbouring characters, so
the parities of how often these occur, by hash in 128 counts, differ in at most 4 times as many bits
as there are edits: this bound loses no pair, and rules out nearly all that meet by chance.

Buckets are not blocks of the SimHash: the links need a DISTANCE of 24 (see the README for recall by
distance), and of 25 blocks of 128 bits one that agrees has 5 bits, which nearly all lines share.
Instead each of BANDS buckets takes the least values of VALUES hashes of a line's pairs of words, in
lines of up to SHORT characters of its windows of WIDTH bytes; an edit that leaves the lines similar
leaves one of them, nearly always. Lines of LONG to SHORT characters, which may be linked to either,
have both.

Of each connected group the first occurrence stays, by document id, then line. Lines without a word
are no one's copies and always stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernel
from palimpsest.llm.common import Scratch, asked, named, slot_table
from palimpsest.llm.components import link_buckets
from palimpsest.llm.pretoken import code_points

DISTANCE, SIMILARITY = 24, 0.9
#: Buckets of a line, and least values in each.
BANDS, VALUES = 10, 3
LONG, SHORT, WIDTH = 54, 60, 4
#: Characters up to which lines have parities: beyond, so many edits are allowed that they rule little out.
EVEN = 200
#: Lines of a large bucket that the second round compares with all others of it.
CENTRES = 16
WORD_BYTES = kernel.byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
_FACTORS = kernel.mix(np.arange(BANDS * VALUES, dtype=np.uint64)) | np.uint64(1)
#: The bits of a byte, first to last, as bytes.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)).reshape(256, 8).view(np.uint64).reshape(-1)
_NORMAL = kernel.LOWER.copy()
_NORMAL[0x30:0x3A] = 0x30


class Lines:
    """The lines of a slice: doc[i] and number[i] of each, its words, and how many there are by document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = _NORMAL[data]
        cuts = np.flatnonzero(data == 0x0A) + 1
        self.offsets = np.sort(np.concatenate((offsets, cuts)))  # an end that is a start too counts twice
        self.words = kernel.Words(data, self.offsets, WORD_BYTES, lower=False)
        start = self.offsets[:-1]
        # an offset of the slice opens a document, the next ones, at line ends, its further lines
        per_doc = np.searchsorted(cuts, offsets[1:], "right") - np.searchsorted(cuts, offsets[:-1], "right") + 1
        self.count = per_doc
        self.doc = np.repeat(np.arange(len(per_doc)), per_doc)
        self.number = np.arange(len(start)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        n = np.diff(self.words.first)
        self.some = np.flatnonzero(n > 0)
        self.node = self.words.grams(self.words.first[:-1][self.some], n[self.some])

    @cached_property
    def lengths(self) -> np.ndarray:
        """Characters of the normal forms of the lines with words."""
        lead = np.concatenate(([0], np.cumsum((self.words.data & 0xC0) != 0x80)))
        sums = np.concatenate(([0], np.cumsum(lead[self.words.end] - lead[self.words.start])))
        low, high = self.words.first[:-1][self.some], self.words.first[1:][self.some]
        return sums[high] - sums[low] + (high - low - 1)

    def simhash(self) -> np.ndarray:
        """Of the lines with words two columns of 64 bits, each bit as most of the words' hashes have it."""
        out, step = np.zeros((len(self.some), 2), np.uint64), 1 << 12
        low, high = self.words.first[:-1][self.some], self.words.first[1:][self.some]
        for at in range(0, len(self.some), step):
            a, b = low[at : at + step], high[at : at + step]
            # eight counts of a byte in each sum, so of at most 255 words
            parts = -(-(b - a) // 255)
            part = kernel.ranges(a, parts)
            starts = np.repeat(a, parts) + 255 * (part - np.repeat(a, parts))
            own = self.words.hash[a[0] : b[-1]]
            for half, hashes in enumerate((own, kernel.mix(own))):
                lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8)]
                sums = np.add.reduceat(lanes, starts - a[0], axis=0).view(np.uint8).reshape(-1, 64)
                sums = np.add.reduceat(sums, np.cumsum(parts) - parts, axis=0, dtype=np.int32)
                out[at : at + step, half] = np.packbits(2 * sums > (b - a)[:, None], axis=1).view(np.uint64).reshape(-1)
        return out

    @cached_property
    def normal(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the normal forms of the lines with words, and where each starts and the last ends."""
        w = self.words
        data, keep = w.data.copy(), WORD_BYTES[w.data]
        inner = np.ones(len(w.start), bool)
        inner[w.first[1:][self.some] - 1] = False
        between = w.end[inner]  # no word's byte, as another word of the line follows
        data[between], keep[between] = 0x20, True
        sums = np.concatenate(([0], np.cumsum(keep)))
        return data[keep], np.append(sums[w.start[w.first[:-1][self.some]]], sums[-1])

    def parity(self) -> np.ndarray:
        """Of the lines with words two columns of 64 bits: which of 128 counts of pairs of characters are odd.

        Lines of more than EVEN characters have none.
        """
        out = np.zeros((len(self.some), 2), np.uint64)
        own = np.flatnonzero(self.lengths <= EVEN)
        if not len(own):
            return out
        data, at = self.normal
        size = at[own + 1] - at[own]
        points, lead = code_points(data[kernel.ranges(at[own], size)])
        start = np.searchsorted(lead, np.cumsum(size) - size)
        mixed = points * np.uint32(0x9E3779B1)
        mixed[:-1] += points[1:] * np.uint32(0x85EBCA77)
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE3D)
        bit = np.uint64(1) << ((mixed >> np.uint32(25)) & np.uint32(63)).astype(np.uint64)
        bit[np.append(start[1:], len(points)) - 1] = 0  # a line's last character heads no pair
        high = mixed >> np.uint32(31) == 1
        for half, part in enumerate((~high, high)):
            out[own, half] = np.bitwise_xor.reduceat(np.where(part, bit, np.uint64(0)), start)
        return out

    def buckets(self) -> tuple[np.ndarray, np.ndarray]:
        """(index into some, bucket), BANDS for each line, or twice as many; by line."""
        length = self.lengths
        words = np.flatnonzero(length >= LONG)
        low, n = self.words.first[:-1][self.some[words]], np.diff(self.words.first)[self.some[words]]
        some = np.maximum(n - 1, 1)
        grams = self.words.grams(kernel.ranges(low, some), np.repeat(np.minimum(n, 2), some))
        kinds = [(words, grams, some)]
        short = np.flatnonzero(length <= SHORT)
        data, at = self.normal
        n = at[short + 1] - at[short]
        some, sums = np.maximum(n - (WIDTH - 1), 1), kernel.prefix_sums(kernel._SYMBOL[data])
        start = kernel.ranges(at[short], some)
        kinds.append((short, kernel.window_hash(sums, start, start + np.repeat(np.minimum(n, WIDTH), some)), some))
        lines, found = [], []
        for kind, (own, values, some) in enumerate(kinds):
            if not len(own):
                continue
            first = np.cumsum(some) - some
            for band in range(BANDS):
                key = np.full(len(own), kernel.mix(np.array([kind * BANDS + band], np.uint64))[0])
                for factor in _FACTORS[band * VALUES : (band + 1) * VALUES]:
                    key = kernel.mix(key ^ np.minimum.reduceat(values * factor, first))
                lines.append(own)
                found.append(key)
        if not lines:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        line, bucket = np.concatenate(lines), np.concatenate(found)
        order = np.argsort(line, kind="stable")
        return line[order], bucket[order]


SIGNED = "doc_id long, key long, number long, node long, sketch long, other long, odd long, odder long, length long, buckets array<long>"


def sign(docs: DataFrame) -> DataFrame:
    """Each line with words of (doc_id, key, text); the buckets of a normal form come once in a slice, else none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in kernel.slices(batch.column(2)):
                lines = Lines(data, offsets)
                row = pa.array(lines.doc[lines.some])
                own, bucket = lines.buckets()
                once = np.zeros(len(lines.some), bool)
                once[np.unique(lines.node, return_index=True)[1]] = True
                bucket = bucket[once[own]]
                bounds = np.concatenate(([0], np.cumsum(np.bincount(own, once[own], len(lines.some))))).astype(np.int32)
                sketch, odd = kernel.signed(lines.simhash()), kernel.signed(lines.parity())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[low:high].take(row),
                        batch.column(1)[low:high].take(row),
                        pa.array(lines.number[lines.some]),
                        pa.array(kernel.signed(lines.node)),
                        pa.array(sketch[:, 0].copy()),
                        pa.array(sketch[:, 1].copy()),
                        pa.array(odd[:, 0].copy()),
                        pa.array(odd[:, 1].copy()),
                        pa.array(lines.lengths),
                        pa.ListArray.from_arrays(bounds, pa.array(kernel.signed(bucket))),
                    ],
                    names=["doc_id", "key", "number", "node", "sketch", "other", "odd", "odder", "length", "buckets"],
                )

    return docs.mapInArrow(run, SIGNED)


def in_buckets(lines: DataFrame, buckets: DataFrame) -> DataFrame:
    """(bucket, node, c): the lines' rows of some buckets, and few more; c is the node."""
    table, n = slot_table(buckets, "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(1)
            size = own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            bucket = own.flatten().to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(asked(table.value, n, bucket))
            row = np.searchsorted(np.cumsum(size), hit, "right")
            node = batch.column(0).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[hit]), node, node], names=["bucket", "node", "c"])

    return lines.select("node", "buckets").where("size(buckets) > 0").mapInArrow(run, "bucket long, node long, c long")


def normal_forms(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, line): the normal forms of some classes."""
    table, n = slot_table(nodes, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in kernel.slices(batch.column(0)):
                lines = Lines(data, offsets)
                node, first = np.unique(kernel.signed(lines.node), return_index=True)
                hit = asked(table.value, n, node)
                (flat, at), own = lines.normal, first[hit]
                flat = flat.tobytes()
                texts = [flat[x:y].decode("utf-8", "replace") for x, y in zip(at[own].tolist(), at[own + 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(texts, pa.string())], names=["node", "line"])

    return docs.select("text").mapInArrow(run, "node long, line string").join(nodes, "node").groupBy("node").agg(F.first("line").alias("line"))


def edits(a: str, b: str, most: int | None = None) -> int:
    """The edit distance, by Myers' bit vectors over what is left between equal ends.

    Of more than `most` edits it is only told that there are more.
    """
    same = 0
    for x, y in zip(a, b):  # noqa: B905
        if x != y:
            break
        same += 1
    a, b, same = a[same:], b[same:], 0
    for x, y in zip(reversed(a), reversed(b)):  # noqa: B905
        if x != y:
            break
        same += 1
    a, b = a[: len(a) - same], b[: len(b) - same]
    if not a or not b:
        return len(a) + len(b)
    # out falls by at most one with each character that is left of b
    room = len(b) + (len(a) + len(b) if most is None else most)
    if abs(len(a) - len(b)) > room - len(b):
        return room - len(b) + 1
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, len(a) - 1
    plus, minus, out = full, 0, len(a)
    for y in b:
        met = at.get(y, 0)
        zero = (((met & plus) + plus) ^ plus) | met | minus
        up, down = minus | ~(zero | plus) & full, plus & zero
        out += (up >> top & 1) - (down >> top & 1)
        room -= 1
        if out > room:
            return out
        up = up << 1 & full | 1
        plus, minus = (down << 1 | ~(zero | up)) & full, up & zero
    return out


def confirm(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, la, lb) of similar lines, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                most = int((1 - SIMILARITY) * max(len(x), len(y)) + 1e-9)
                if edits(x, y, most) <= most:
                    good.append(i)
            kept = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept)], names=["a", "b"])

    return pairs.select("a", "b", "la", "lb").mapInArrow(run, "a long, b long")


def repeated_lines(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, key, numbers): for each document of (doc_id, key, text) the lines that others stand for."""
    lines = scratch.keep(sign(docs), "lines")
    same = ["node", "sketch", "other", "length"]  # 64 bits of a hash, 128 of the SimHash and the length
    # counts and longs only, which a hash aggregation can hold
    classes = scratch.keep(lines.groupBy(*same).agg(F.min("odd").alias("odd"), F.min("odder").alias("odder"), F.count("*").alias("n")), "classes")
    nodes = classes.select("node", F.lit(0).alias("rank"), F.struct("sketch", "other", "odd", "odder", "length").alias("x"))
    texts: list[DataFrame] = []

    def deal(_: int, component: DataFrame | None, rest: DataFrame | None) -> DataFrame:
        if rest is None:
            return lines.select(F.explode("buckets").alias("bucket"), "node", F.col("node").alias("c"))
        if component is None:
            return rest
        return rest.drop("c").join(component, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("c"))

    def may_link(x: str, y: str) -> str:
        # a word is too much of a short line's SimHash
        close = f"(bit_count({x}.sketch ^ {y}.sketch) + bit_count({x}.other ^ {y}.other) <= {DISTANCE} or least({x}.length, {y}.length) <= {SHORT})"
        longer = f"greatest({x}.length, {y}.length)"
        odd = f"bit_count({x}.odd ^ {y}.odd) + bit_count({x}.odder ^ {y}.odder) <= 4 * cast({1 - SIMILARITY!r}D * {longer} + 1e-9D as int)"
        return f"({longer} > {EVEN} or {odd}) and {close} and least({x}.length, {y}.length) >= {SIMILARITY} * {longer}"

    def verify(pairs: DataFrame, rest: DataFrame) -> DataFrame:
        if not texts:  # for later rounds too, whose buckets are among these
            texts.append(scratch.keep(normal_forms(docs, scratch.keep(rest.select("node").distinct(), "nodes")), "texts"))
        known = texts[0]
        both = pairs.join(known.selectExpr("node as a", "line as la"), "a").join(known.selectExpr("node as b", "line as lb"), "b")
        return confirm(both)

    component = link_buckets(deal, nodes, may_link, verify, scratch, rounds=2, centres=CENTRES, sift=lambda buckets: in_buckets(lines, buckets))
    # a class without links is told by all of `same`, so that others join it by no chance
    grouped = classes.join(component, "node", "left").select(
        *same, "n", F.coalesce("component", "node").alias("c"),
        *[F.when(F.col("component").isNull(), F.col(x)).otherwise(0).alias(f"own_{x}") for x in same[1:]],
    )
    group = ["c", *[f"own_{x}" for x in same[1:]]]
    counted = grouped.groupBy(*group).agg(F.sum("n").alias("n")).where("n > 1").drop("n")
    copies = grouped.join(counted, group).select(*same, *group)
    here = ["doc_id", "key", "number"]
    copied = scratch.keep(lines.select(*same, *here).join(copies, same).select(*group, *here), "copied")
    first = copied.groupBy(*group).agg(F.min(F.struct(*here)).alias("first")).select(*[F.col(f"first.{x}").alias(f"first_{x}") for x in here])
    # by the line, not the group, whose lines may be very many
    again = copied.join(first, F.expr(" and ".join(f"{x} <=> first_{x}" for x in here)), "left_anti")
    return again.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(F.col("number").cast("int"))).alias("numbers"))


def deduplicate(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, with the text that is left, and removed_lines (array of line numbers from 0).

    A column named removed_lines in the input is replaced; any other name may occur. Null and empty
    texts stay as they are. Rows of equal id and text are one document and keep the same lines; of
    one id with several texts each is a document. Null ids come first, as one id.
    """
    scratch = Scratch(documents.sparkSession, "lines")
    id_, key = named(id_col).cast("long").alias("doc_id"), F.xxhash64(named(text_col)).alias("key")
    docs = documents.select(id_, key, named(text_col).alias("text"))
    gone = scratch.keep(repeated_lines(docs, scratch), "gone").withColumnsRenamed({"doc_id": "gone_id", "key": "gone_key"})
    own = [c for c in documents.columns if c != "removed_lines"]
    rows = documents.select(F.struct(*map(named, own)).alias("row"), id_, key, named(text_col).alias("text"))
    out = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left")
    left = F.expr("array_join(filter(split(text, '\\n'), (x, i) -> not array_contains(numbers, i)), '\n')")
    left = F.when(F.col("numbers").isNull(), F.col("text")).otherwise(left)
    return out.select(
        *[left.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in own],
        F.coalesce("numbers", F.array().cast("array<int>")).alias("removed_lines"),
    )


def report(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_removed, removed (line numbers, comma-joined), text_sha256 of the text left."""
    done = deduplicate(documents.select("doc_id", "text"))
    return done.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size("removed_lines").cast("long").alias("n_removed"),
        F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )
