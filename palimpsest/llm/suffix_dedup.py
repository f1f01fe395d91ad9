"""Repeated passages by sparse suffix arrays over words.

A text's suffixes are kept only where they start with a minimiser: the smallest K-word hash of
some window of LENGTH words. Two texts that share LENGTH words keep the same suffixes within them.
Kept suffixes are brought in the order of their first K words, and one whose neighbours differ
there is dropped: nothing repeats around it. Around those left, the match is extended to the left
and right: each window of LENGTH words that holds the suffix's head is compared with the windows
that start alike, by its hash. Hence exactly the words are found that lie in LENGTH words in a row
that occur twice, and a passage that many documents share costs a row for each of its windows and
occurrences, never pairs of these.

Copies of a whole text are told by a hash of the text and enter the array once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernel
from palimpsest.llm.common import Scratch

LENGTH, K = 50, 20
WORD_BYTES = ~kernel.byte_set((0x20, 0x20), (0x09, 0x0D))


def minimisers(words: kernel.Words, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(word positions, hashes) of the smallest K-gram, the rightmost of equals, of each window of a document."""
    starts, _ = words.gram_starts(length)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    grams = words.grams(np.arange(len(words.hash) - k + 1), k)
    at = starts + (length - k)
    best = grams[at]
    for back in range(length - k - 1, -1, -1):
        other = grams[starts + back]
        less = other < best
        best = np.where(less, other, best)
        at = np.where(less, starts + back, at)
    at = np.unique(at)
    return at, grams[at]


def _suffixes(docs: DataFrame) -> DataFrame:
    """(gram, key, pos) of the kept suffixes of (doc_id, key, text); pos counts words in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in kernel.slices(batch.column(1)):
                words = kernel.Words(data, offsets, WORD_BYTES, lower=False)
                at, grams = minimisers(words)
                doc = np.searchsorted(words.first, at, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kernel.signed(grams)), batch.column(0)[low:high].take(pa.array(doc)), pa.array((at - words.first[doc]).astype(np.int32))],
                    names=["gram", "key", "pos"],
                )

    return docs.select("key", "text").mapInArrow(run, "gram long, key long, pos int")


def _windows(texts: DataFrame) -> DataFrame:
    """(window, doc_id, key, start): the windows over the heads at `heads` of (doc_id, key, text, heads)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in kernel.slices(batch.column(2)):
                words = kernel.Words(data, offsets, WORD_BYTES, lower=False)
                heads = batch.column(3)[low:high]
                size = heads.value_lengths().to_numpy()
                doc = np.repeat(np.arange(high - low), size)
                head = heads.flatten().to_numpy() + words.first[doc]
                first = np.maximum(head - (LENGTH - K), words.first[doc])
                last = np.minimum(head, words.first[doc + 1] - LENGTH)
                first, last = first[last >= first], last[last >= first]
                open_ = np.zeros(len(words.hash) + 2, np.int64)
                np.add.at(open_, first, 1)
                np.add.at(open_, last + 1, -1)
                starts = np.flatnonzero(np.cumsum(open_) > 0)
                doc = np.searchsorted(words.first, starts, "right") - 1
                row = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(kernel.signed(words.grams(starts, LENGTH))),
                        batch.column(0)[low:high].take(row),
                        batch.column(1)[low:high].take(row),
                        pa.array((starts - words.first[doc]).astype(np.int32)),
                    ],
                    names=["window", "doc_id", "key", "start"],
                )

    return texts.select("doc_id", "key", "text", "heads").mapInArrow(run, "window long, doc_id long, key long, start int")


def _counts(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in kernel.slices(batch.column(2)):
                n = np.diff(kernel.Words(data, offsets, WORD_BYTES, lower=False).first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[low:high], batch.column(1)[low:high], pa.array(n)], names=["doc_id", "key", "n_words"]
                )

    return docs.mapInArrow(run, "doc_id long, key long, n_words long")


def _spans(starts: str) -> str:
    """SQL: starts, ascending, of windows as merged spans."""
    return f"""aggregate({starts}, cast(array() as array<struct<start:int,end:int>>), (acc, s) ->
        if(size(acc) > 0 and element_at(acc, -1).end >= s,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', s + {LENGTH}))),
           concat(acc, array(named_struct('start', s, 'end', s + {LENGTH})))))"""


def repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, repeated, again (arrays of word start, end), sources (doc_ids).

    repeated: spans of words in LENGTH words in a row that occur elsewhere or twice in the text;
    again: those of them that occur earlier, by doc_id, then place: without them each passage is
    left once; sources: the other documents with the first occurrences. Texts of fewer words have no
    spans; null is empty. Of equal texts the first is compared with others, the rest are repeated as
    a whole. Rows of equal id and text are such copies too, but the first of them is their own source.
    """
    scratch = Scratch(documents.sparkSession, "suffixes")
    docs = documents.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")
    )
    rows = scratch.keep(_counts(docs), "rows")
    suffixes = scratch.keep(_suffixes(docs), "array")
    where = F.struct("key", "pos")
    alike = suffixes.groupBy("gram").agg(F.min(where).alias("low"), F.max(where).alias("high")).where("low <> high").select("gram")
    heads = suffixes.join(alike, "gram").groupBy("key").agg(F.sort_array(F.collect_set("pos")).alias("heads"))
    texts = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    texts = scratch.keep(texts, "texts")
    wanted = scratch.keep(heads.join(texts, "key").select("key", "doc_id", "heads"), "heads")
    found = docs.join(wanted, ["doc_id", "key"])
    windows = scratch.keep(_windows(found), "windows")
    place = F.struct("doc_id", "key", "start")
    twice = windows.groupBy("window").agg(F.min(place).alias("first"), F.max(place).alias("high")).where("first <> high")
    met = windows.join(twice.select("window", "first"), "window")
    is_first = (F.col("first.key") == F.col("key")) & (F.col("first.start") == F.col("start"))
    by_text = met.groupBy("key").agg(
        F.sort_array(F.collect_set("start")).alias("starts"),
        F.sort_array(F.collect_set(F.when(~is_first, F.col("start")))).alias("later"),
        F.sort_array(F.collect_set(F.when(~is_first, F.col("first.doc_id")))).alias("sources"),
    )
    by_text = scratch.keep(
        texts.withColumnRenamed("doc_id", "first_id").join(by_text, "key", "left").select(
            "key", "first_id", "copies", F.expr(_spans("coalesce(starts, array())")).alias("own"),
            F.expr(_spans("coalesce(later, array())")).alias("own_again"), F.coalesce("sources", F.array().cast("array<bigint>")).alias("own_sources"),
        ),
        "spans",
    )
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    copied = (F.col("copies") > 1) & (F.col("n_words") >= LENGTH)
    copy = copied & (F.col("doc_id") != F.col("first_id"))
    return rows.join(by_text, "key").select(
        F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")).alias("doc_id"),
        "n_words",
        F.when(copied, whole).otherwise(F.col("own")).alias("repeated"),
        F.when(copy, whole).otherwise(F.col("own_again")).alias("again"),
        F.when(copy, F.array("first_id")).otherwise(F.array_remove("own_sources", F.col("doc_id"))).alias("sources"),
    )


def report(found: DataFrame) -> DataFrame:
    """repeats() with counts and strings."""

    def words(name: str) -> str:
        return f"aggregate({name}, 0L, (n, s) -> n + s.end - s.start)"

    return found.select(
        "doc_id",
        "n_words",
        F.expr(words("repeated")).alias("n_repeated"),
        F.expr(words("again")).alias("n_again"),
        F.expr("array_join(transform(repeated, s -> concat(s.start, ':', s.end)), ',')").alias("spans"),
        F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"),
    )
