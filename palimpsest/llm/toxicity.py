"""Toxicity: obfuscated words restored by a noisy channel, then scored by learned word features.

Channel: a writer may put a look-alike sign for a letter, repeat a letter, or space a word out.
Spans that could be so written are found in numpy; each gets a lattice of what every sign may
stand for (a letter, or nothing at an end of the span or between separators), of separators (within
a word or between two) and of repeats, and Viterbi decoding under a character trigram model picks the reading. The
trigrams are counted over all texts of the corpus. All other text stays as it is.

Scoring: features are the words of the restored text and their first 3 to 6 bytes. Their counts
by label are learned from at most `bound` labelled documents; those that go with the label far
beyond chance are kept, and a document has the odds of its strongest one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from palimpsest.llm import kernel
from palimpsest.llm.common import named, numbered

#: Signs and the letters they are drawn for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il"}
#: At most so many labelled documents are learned from, the first by a hash of their ids.
BOUND = 8000
#: A feature needs so many documents of label 1, and so many standard deviations above chance.
SUPPORT, DEVIATIONS = 4, 5.5
#: A feature's log odds of label 1, drawn towards the overall rate, are at least so high: a mere lean is none.
LEAN = 0.8
CUT = 0.3

WORD_BYTES = kernel.byte_set((0x61, 0x7A), (0x80, 0xFF))
PREFIXES = (3, 4, 5, 6)
#: a-z are 1 to 26, all other letters 27, what is no letter 0.
SYMBOLS = 28
_UNIT, _NEAR, _GAPS = r"(?:[^\W_]|[@$!|])", r"[\w@$!|]", " .-_*"
_SPACED = re.compile(rf"(?<!{_NEAR}){_UNIT}(?:[ .\-_*]{_UNIT}){{2,}}(?!{_NEAR})")
_SIGNED = re.compile(rf"(?<!{_NEAR})(?=[^\W\d_]*[0-9@$!|])(?=[0-9@$!|]*[^\W\d_]){_UNIT}{{3,}}(?!{_NEAR})")
_LONG = re.compile(r"(?<![^\W\d_])[^\W\d_]*?([^\W\d_])\1\1+[^\W\d_]*(?![^\W\d_])")

_CODE = np.zeros(256, np.int64)
_CODE[0x61:0x7B] = np.arange(1, 27)
_CODE[0x80:] = 27


class Model:
    """Log probabilities of a letter after two others, from trigram counts with a uniform share."""

    def __init__(self, counts: np.ndarray):
        cube = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        pair = cube.sum(0) + 1.0
        pair /= pair.sum(1, keepdims=True)
        mixed = cube + 5.0 * pair[None]
        self.table = np.log(mixed / mixed.sum(2, keepdims=True)).tolist()

    def decode(self, text: str) -> str:
        """The likeliest reading of a span as written: letters, and what stands for none as it is."""
        code = lambda c: ord(c) - 96 if "a" <= c <= "z" else 27
        edge = "".join(LOOKALIKES) + _GAPS
        first, last = len(text) - len(text.lstrip(edge)), len(text.rstrip(edge))
        # by the last two letters: (score, (reading so far, its last sign)); no letter is (0, 0)
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        before = ""
        for i, sign in enumerate(text):
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            gap = sign in _GAPS
            alone = text[i - 1 : i] in _GAPS and text[i + 1 : i + 2] in _GAPS
            plain = gap or (sign in LOOKALIKES and (i < first or i >= last or alone))
            reads = [] if gap else [(c, -0.7 * (sign in LOOKALIKES)) for c in LOOKALIKES.get(sign, sign)]
            for (p, q), (score, out) in states.items():
                found = [(score + cost + self.table[p][q][code(c)], (out, c), (q, code(c))) for c, cost in reads]
                if plain:  # it ends the word, if there is one
                    found.append((score + (self.table[p][q][0] if q else 0.0), (out, sign), (0, 0)))
                if gap and q:  # it spaces the word out
                    found.append((score - 0.3, out, (p, q)))
                if sign == before and q:  # a repeat of the letter before, written once too often
                    found.append((score - 1.0, out, (p, q)))
                for s, o, key in found:
                    if key not in after or after[key][0] < s:
                        after[key] = (s, o)
            states, before = after, before if gap else sign
        out = max(((score + (self.table[p][q][0] if q else 0.0), out) for (p, q), (score, out) in states.items()), key=lambda x: x[0])[1]
        letters = []
        while out:
            out, c = out
            letters.append(c)
        return "".join(reversed(letters))


class Restorer:
    def __init__(self, model: Model):
        self.model = model
        self.cache: dict[str, str] = {}

    def _read(self, m: re.Match) -> str:
        text = m[0]
        known = self.cache.get(text)
        if known is None:
            if len(self.cache) > 100_000:
                self.cache.clear()
            known = self.cache[text] = self.model.decode(text)
        return known

    def __call__(self, text: str) -> str:
        for pattern in (_SPACED, _SIGNED, _LONG):
            text = pattern.sub(self._read, text)
        return text


_LETTER = kernel.byte_set((0x61, 0x7A), (0x80, 0xFF))
_SIGN = kernel.byte_set(*[(ord(c), ord(c)) for c in LOOKALIKES])
_GAP = kernel.byte_set(*[(ord(c), ord(c)) for c in _GAPS])
_WORD = _LETTER | _SIGN | kernel.byte_set((0x30, 0x39))


def suspicious(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents of a slice of lower-cased bytes that may hold an obfuscated word."""
    lead = (data & 0xC0) != 0x80  # a letter of several bytes counts as its first
    data, offsets = data[lead], np.concatenate(([0], np.cumsum(lead)))[offsets]
    letter, sign, gap, word = _LETTER[data], _SIGN[data], _GAP[data], _WORD[data]
    hit = np.zeros(len(data), bool)
    if len(data) > 2:
        hit[1:] |= (letter[1:] & sign[:-1]) | (sign[1:] & letter[:-1])
        hit[2:] |= letter[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    if len(data) > 4:
        hit[4:] |= word[4:] & gap[3:-1] & word[2:-2] & gap[1:-3] & word[:-4]
    sums = np.concatenate(([0], np.cumsum(hit)))
    return np.flatnonzero(sums[offsets[1:]] > sums[offsets[:-1]])


def restore(data: np.ndarray, offsets: np.ndarray, restorer: Restorer) -> tuple[np.ndarray, np.ndarray]:
    """A slice with the texts that need it restored (in lower case); the others are as they were."""
    data = kernel.LOWER[data]
    rows = suspicious(data, offsets)
    if not len(rows):
        return data, offsets
    raw, parts, size, at = data.tobytes(), [], np.diff(offsets), 0
    for d in rows.tolist():
        own = restorer(raw[offsets[d] : offsets[d + 1]].decode("utf-8")).encode("utf-8")
        parts += [raw[at : offsets[d]], own]
        size[d], at = len(own), offsets[d + 1]
    parts.append(raw[at:])
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum(size)))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of all words of a slice."""
    words = kernel.Words(data, offsets, WORD_BYTES)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
    sums = kernel.prefix_sums(kernel._SYMBOL[words.data])
    size = words.end - words.start
    docs, found = [doc], [words.hash]
    for n in PREFIXES:
        long = size > n
        start = words.start[long]
        docs.append(doc[long])
        found.append(kernel.mix(kernel.window_hash(sums, start, start + n) ^ np.uint64(n)))
    return np.concatenate(docs), np.concatenate(found)


def trigrams(texts: DataFrame) -> DataFrame:
    """(gram, n) over all words of all texts, two starts and an end included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for _, _, data, offsets in kernel.slices(batch.column(0)):
                code = _CODE[kernel.LOWER[data]]
                # a multi-byte letter counts once, and what follows the end of a text is no letter
                lead = (data & 0xC0) != 0x80
                ends = np.zeros(len(data), bool)
                ends[offsets[1:-1][offsets[1:-1] < len(data)]] = True
                code = np.insert(code[lead], np.flatnonzero(ends[lead]), 0) if ends.any() else code[lead]
                code = np.concatenate(([0, 0], code, [0, 0]))
                first = code[:-2] * (code[1:-1] > 0)
                total += np.bincount((first * SYMBOLS + code[1:-1]) * SYMBOLS + code[2:], minlength=SYMBOLS**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])

    return texts.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def score(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bound: int = BOUND
) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Learned from labelled rows whose crc32(id as text) mod 4 is not 2, of a label that is not null;
    several labels of an id count each. Null is an empty text and has the score of a document
    without features, as all have if nothing can be learned. Repeated rows stay; a row with a null
    id is not held out and never learned from. Other columns are not read.
    """
    docs = documents.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    found = with_score(docs, labels.withColumnRenamed(id_col, "doc_id"), "doc_id", "text", label_col, bound)
    return found.select(
        "doc_id",
        F.coalesce(_remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )


def _remainder(id_: Column) -> Column:
    return F.crc32(id_.cast("long").cast("string").cast("binary")) % 4


def with_score(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bound: int = BOUND
) -> DataFrame:
    """All rows and columns of documents, and score (which replaces a column of that name); see score().

    A row's score comes with the row in one pass, so rows with null or repeated ids have their own.
    """
    spark = documents.sparkSession
    docs = documents.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    counts = np.zeros(SYMBOLS**3, np.int64)
    for gram, n in trigrams(docs.select("text")).collect():  # at most SYMBOLS ** 3 rows
        counts[gram] = n
    model = spark.sparkContext.broadcast(Restorer(Model(counts)))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where("doc_id is not null and label is not null").where(_remainder(F.col("doc_id")) != 2)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(bound)
    known = spark.createDataFrame(known.collect(), "doc_id long, label int")  # at most `bound` rows
    sample = docs.join(F.broadcast(known), "doc_id").select("label", "text")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in kernel.slices(batch.column(1)):
                doc, found = features(*restore(data, offsets, model.value))
                label = batch.column(0)[low:high].to_numpy()
                order = np.lexsort((found, doc))
                doc, found = doc[order], found[order]
                first = np.ones(len(doc), bool)
                first[1:] = (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])
                distinct, back = np.unique(found[first], return_inverse=True)
                ones = np.bincount(back, label[doc[first]], len(distinct)).astype(np.int64)
                every = np.bincount(back, minlength=len(distinct))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kernel.signed(distinct)), pa.array(ones), pa.array(every)], names=["feature", "ones", "n"]
                )

    n, ones = sample.agg(F.count("*"), F.sum("label")).first()
    rate = ((ones or 0) + 0.1) / (n + 1)  # with no labels at all, a document is rather clean
    by_feature = sample.mapInArrow(learn, "feature long, ones long, n long").groupBy("feature").agg(
        F.sum("ones").alias("ones"), F.sum("n").alias("n")
    )
    above = (F.col("ones") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    kept = by_feature.where(F.col("ones") >= SUPPORT).withColumn("z", above).where(F.col("z") >= DEVIATIONS)
    # odds with two documents' worth of the overall rate
    odds = F.log((F.col("ones") + 2 * rate) / (F.col("n") - F.col("ones") + 2 * (1 - rate)))
    rows = kept.withColumn("odds", odds).where(F.col("odds") >= LEAN).collect()  # of at most `bound` documents
    weight = {r.feature: r.odds for r in rows}
    keys = np.array(sorted(weight), np.int64)
    table = spark.sparkContext.broadcast((keys, np.array([weight[k] for k in keys.tolist()])))

    def strongest(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        keys, odds = table.value
        out = np.full(len(offsets) - 1, -np.inf)
        if len(keys):
            doc, found = features(*restore(data, offsets, model.value))
            at = np.minimum(np.searchsorted(keys, kernel.signed(found)), len(keys) - 1)
            met = keys[at] == kernel.signed(found)
            np.maximum.at(out, doc[met], odds[at[met]])
        return out

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in kernel.slices(batch.column(1)):
                plain = np.isneginf(strongest(data, offsets))
                label = batch.column(0)[low:high].to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([int(plain.sum())]), pa.array([int(label[plain].sum())])], names=["n", "ones"])

    n, ones = sample.mapInArrow(rest, "n long, ones long").agg(F.sum("n"), F.sum("ones")).first()
    base = ((ones or 0) + 0.5 * rate) / ((n or 0) + 0.5)

    rows = documents.drop("score")
    column = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in kernel.slices(batch.column(column)):
                odds = strongest(data, offsets)
                found = np.where(np.isneginf(odds), base, 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], names=[*part.schema.names, "score"])

    numbers = numbered(rows)
    schema = StructType([*numbers.schema.fields, StructField("score", DoubleType())])
    return numbers.mapInArrow(run, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rows.columns)], "score")
