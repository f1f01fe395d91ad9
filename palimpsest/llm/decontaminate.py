"""Benchmark decontamination by winnowing.

Of every W consecutive K-gram hashes of a text the smallest is kept (the rightmost of equal ones),
so two texts that share W + K - 1 words share a fingerprint within them: with K = 5 and W = 6 no
shared window of 10 words is missed. A document's fingerprints are looked up among those of the
items, and each hit is extended word by word to both sides, as far as a window over it can reach.
Items of fewer words are one window each; for these all runs of that many words are looked up.

The items are sent to the executors in blocks of at most about BLOCK_BYTES of text, one pass over
the documents for each block, so what is broadcast has a bound however large the benchmark is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernel
from palimpsest.llm.common import named, numbered

WINDOW, K = 10, 5
W = WINDOW - K + 1
BLOCK_BYTES = 16 << 20
#: 0-9, a-z and all bytes above ASCII, after A-Z is lower-cased.
WORD_BYTES = kernel.byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def winnow(words: kernel.Words) -> tuple[np.ndarray, np.ndarray]:
    """(word positions, hashes) of the kept K-grams of all documents of a slice."""
    starts, bounds = words.gram_starts(WINDOW)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    hashes = words.grams(np.arange(max(0, len(words.hash) - K + 1)), K)
    best = hashes[starts + W - 1]
    at = starts + W - 1
    for back in range(W - 2, -1, -1):
        other = hashes[starts + back]
        less = other < best
        best = np.where(less, other, best)
        at = np.where(less, starts + back, at)
    at = np.unique(at)
    return at, hashes[at]


class Index:
    """Fingerprints of a block of items, and all their words' hashes."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.names = np.array([i for i, _ in items], object)
        texts = pa.array([t for _, t in items], pa.string())
        hashes, first, prints, places, owner = [], [0], [], [], []
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        short: dict[int, list[tuple[int, int]]] = {}
        base = 0
        for low, high, data, offsets in kernel.slices(texts):
            words = kernel.Words(data, offsets, WORD_BYTES)
            at, found = winnow(words)
            prints.append(found)
            places.append(at + base)
            hashes.append(words.hash)
            owner.append(np.repeat(np.arange(low, high), np.diff(words.first)))
            for d in np.flatnonzero((np.diff(words.first) < WINDOW) & (np.diff(words.first) > 0)).tolist():
                n = int(words.first[d + 1] - words.first[d])
                short.setdefault(n, []).append((int(words.grams(words.first[d : d + 1], n)[0]), low + d))
            base += len(words.hash)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.hash, self.owner = join(hashes, np.uint64), join(owner, np.int64)
        prints, places = join(prints, np.uint64), join(places, np.int64)
        order = np.argsort(prints, kind="stable")
        self.prints, self.first = np.unique(prints[order], return_index=True)
        self.first = np.append(self.first, len(order))
        self.places = places[order]
        for n, rows in short.items():
            rows.sort()
            self.short[n] = (np.array([h for h, _ in rows], np.uint64), np.array([i for _, i in rows]))

    def hits(self, words: kernel.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, item) of the runs of words that hold a window of an item."""
        out = []
        at, found = winnow(words)
        if len(self.prints) and len(at):
            row = np.minimum(np.searchsorted(self.prints, found), len(self.prints) - 1)
            met = self.prints[row] == found
            at, row = at[met], row[met]
            n = self.first[row + 1] - self.first[row]
            p, q = np.repeat(at, n), self.places[kernel.ranges(self.first[row], n)]
            d = np.searchsorted(words.first, p, "right") - 1
            left, right = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
            low, high, own = words.first[d], words.first[d + 1], self.owner[q] if len(q) else q
            for reach, sign in ((left, -1), (right, 1)):
                alive = np.ones(len(p), bool)
                for step in range(W):
                    i, j = (p - step, q - step) if sign < 0 else (p + K - 1 + step, q + K - 1 + step)
                    inside = alive & (i >= low) & (i < high) & (j >= 0) & (j < len(self.hash))
                    i, j = np.where(inside, i, 0), np.where(inside, j, 0)
                    alive = inside & (self.owner[j] == own) & (words.hash[i] == self.hash[j])
                    reach[alive] = step
            good = left + right + K >= WINDOW
            # a K-gram that only shares the hash has no equal words at its own ends
            out.append((p[good] - left[good], p[good] + K + right[good], own[good]))
        for n, (keys, items) in self.short.items():
            starts, _ = words.gram_starts(n)
            grams = words.grams(starts, n)
            low, high = np.searchsorted(keys, grams), np.searchsorted(keys, grams, "right")
            met = high > low
            n_items = (high - low)[met]
            s = np.repeat(starts[met], n_items)
            out.append((s, s + n, items[kernel.ranges(low[met], n_items)]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


FOUND = "doc_id long, text_key long, n_words long, starts array<long>, ends array<long>, items array<long>"


def _scan(docs: DataFrame, index) -> DataFrame:
    """Per document of (doc_id, text_key, text): merged hit spans, in words, and the items found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Index = index.value
        for batch in batches:
            for low, high, data, offsets in kernel.slices(batch.column(2)):
                words = kernel.Words(data, offsets, WORD_BYTES)
                start, end, item = known.hits(words)
                rows = high - low
                doc = np.searchsorted(words.first, start, "right") - 1
                change = np.zeros(len(words.hash) + 1, np.int64)
                np.add.at(change, start, 1)
                np.add.at(change, end, -1)
                inside = np.cumsum(change[:-1]) > 0
                edge = np.zeros(len(inside) + 1, bool)
                edge[words.first[:-1][words.first[:-1] < len(inside)]] = True
                opens = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
                ends = np.flatnonzero(inside & (np.append(edge[1:-1], True) | ~np.append(inside[1:], False))) + 1
                bounds = np.searchsorted(opens, words.first).astype(np.int32)
                base = np.repeat(words.first[:-1], np.diff(bounds))
                pairs = np.unique(np.column_stack((doc, item)), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
                names = pa.array(known.names[pairs[:, 1].astype(np.int64)].tolist(), pa.int64())
                counts = np.searchsorted(pairs[:, 0], np.arange(rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[low:high],
                        batch.column(1)[low:high],
                        pa.array(np.diff(words.first)),
                        pa.ListArray.from_arrays(bounds, pa.array(opens - base)),
                        pa.ListArray.from_arrays(bounds, pa.array(ends - base)),
                        pa.ListArray.from_arrays(counts, names),
                    ],
                    names=["doc_id", "text_key", "n_words", "starts", "ends", "items"],
                )

    return docs.mapInArrow(run, FOUND)


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[Broadcast]:
    """Indexes of the items' distinct (item_id, text), in blocks by the text of about block_bytes each."""
    items = items.where("text is not null").distinct()
    # the ids of one text come together, so that a text is sent once
    texts = items.groupBy("text").agg(F.collect_set("item_id").alias("ids"), F.max(F.col("item_id").isNull()).alias("nameless"))
    size = texts.agg(F.sum(F.octet_length("text") + 8 * F.size("ids"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    for i in range(blocks):
        own = texts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == i).collect()
        yield items.sparkSession.sparkContext.broadcast(Index([(x, r.text) for r in own for x in [*r.ids, *[None] * r.nameless]]))


def without_hits(
    documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The rows of documents, all columns, that hold no window of an item; see find(). Ids are not read."""
    items = benchmark.select(named(item_col).cast("long").alias("item_id"), named(item_text_col).alias("text"))
    column, rows = documents.columns.index(text_col), numbered(documents)
    for index in _blocks(items, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], index: Broadcast = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low, high, data, offsets in kernel.slices(batch.column(column)):
                    words = kernel.Words(data, offsets, WORD_BYTES)
                    clean = np.ones(high - low, bool)
                    clean[np.searchsorted(words.first, index.value.hits(words)[0], "right") - 1] = False
                    yield batch.slice(low, high - low).filter(pa.array(clean))

        rows = rows.mapInArrow(run, rows.schema)
    return rows.toDF(*documents.columns)


def find(
    documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document: doc_id, n_words, spans (array of word start, end) and items (array of item ids).

    A window is WINDOW consecutive words of an item, or all words of a shorter one. Null texts and
    items have no words; items with a null id count as hits but are not listed. Repeated rows of
    documents stay, repeated items count once. Other columns are not read.
    """
    docs = documents.select(
        named(id_col).cast("long").alias("doc_id"), F.xxhash64(named(text_col)).alias("text_key"), named(text_col).alias("text")
    )
    items = benchmark.select(named(item_col).cast("long").alias("item_id"), named(item_text_col).alias("text"))
    parts = [_scan(docs, index) for index in _blocks(items, block_bytes)]
    if len(parts) == 1:
        out = parts[0]
    else:
        rest = parts[0]
        for part in parts[1:]:
            rest = rest.unionByName(part)
        merged = rest.where("size(starts) > 0").groupBy("doc_id", "text_key").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))))).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        )
        merge = """aggregate(spans, cast(array() as array<struct<starts: bigint, ends: bigint>>), (acc, s) ->
            if(size(acc) > 0 and element_at(acc, -1).ends >= s.starts,
               concat(slice(acc, 1, size(acc) - 1), array(named_struct('starts', element_at(acc, -1).starts,
                      'ends', greatest(element_at(acc, -1).ends, s.ends)))),
               concat(acc, array(s))))"""
        merged = merged.withColumn("spans", F.expr(merge)).selectExpr(
            "doc_id as d", "text_key as t", "spans.starts as s", "spans.ends as e", "items as i"
        )
        out = parts[0].select("doc_id", "text_key", "n_words").join(
            merged, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left"
        ).selectExpr(
            "doc_id", "n_words", "coalesce(s, array()) as starts", "coalesce(e, array()) as ends", "coalesce(i, array()) as items"
        )
    return out.select(
        "doc_id", "n_words", F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")).alias("spans"),
        F.array_sort(F.array_distinct(F.filter("items", lambda x: x.isNotNull()))).alias("items"),
    )


def report(found: DataFrame) -> DataFrame:
    """find() as a digest per document."""
    return found.select(
        "doc_id",
        "n_words",
        F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
