"""Near-duplicate documents: banded MinHash candidates, Bayesian pruning, exact verification.

1. Each document's set of word shingles is hashed in numpy and signed by MinHash. Documents of equal
   sets (by 128 bits of a hash) are one class, so copies never meet each other.
2. Classes that share a band meet in its bucket (see components.link_buckets). The first round deals
   FIRST bands only, which link most of what is near; later rounds deal all bands, but look only at
   buckets that still hold several components, so a large group of near copies makes few pairs.
   Set sizes and low bits of the signatures, compared within the join, rule most pairs out.
3. Large buckets that still hold several components after that are not compared in pairs: their
   documents are joined on the shingles of their prefixes, the rarest ones of each set. Two sets of
   similarity t share one of the first (1 - t) n + 1 shingles in any common order, and the places of
   the first one bound what they share, so this is exact, and a document with many shingles of its
   own meets no one.
4. Signatures of candidates are compared batch by batch. After each batch the posterior chance,
   from a uniform prior, that the similarity reaches the threshold is bounded: below `miss` the pair
   is given up.
5. Survivors are confirmed on full shingle sets.

A pair at the threshold itself misses all bands with a chance under 3e-5 at the defaults, and is
pruned, by low bits or batches, with a chance of `miss` each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm import kernel
from palimpsest.llm.common import Scratch, asked, named, slot_table
from palimpsest.llm.components import link_buckets

ROWS, BANDS, FIRST, BATCH, SHINGLE = 5, 40, 8, 40, 5
#: Values of a signature, all of them in bands; each is kept as 16 bits.
TOTAL = ROWS * BANDS
#: Bits of each value that are compared within the join, and longs that hold one bit of all values.
PLANES, WORDS = 2, -(-TOTAL // 64)
MISS = 1e-5
#: All but white space of ASCII.
WORD_BYTES = ~kernel.byte_set((0x20, 0x20), (0x09, 0x0D))


@lru_cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = kernel.mix(np.arange(2 * n, dtype=np.uint64))
    return seeds[:n] | np.uint64(1), seeds[n:]


def shingle_hashes(words: kernel.Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's shingles, with repeats, and their bounds by document.

    A document of fewer than k words, but not none, has its whole sequence as the one shingle.
    """
    n = np.diff(words.first)
    counts = np.where(n >= k, n - (k - 1), (n > 0).astype(n.dtype))
    bounds = np.concatenate(([0], np.cumsum(counts)))
    starts = kernel.ranges(words.first[:-1], counts)
    return words.grams(starts, np.repeat(np.minimum(n, k), counts)), bounds


def signatures(hashes: np.ndarray, bounds: np.ndarray, n: int = TOTAL) -> np.ndarray:
    """MinHash of each document, 16 bits a value; documents without shingles get the largest value."""
    out = np.full((len(bounds) - 1, n), 0xFFFF, np.uint16)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        at = bounds[:-1][full]
        for i, (a, b) in enumerate(zip(*_permutations(n), strict=True)):
            out[full, i] = np.minimum.reduceat(hashes * a + b, at) >> np.uint64(8)
    return out


def low_bits(sig: np.ndarray) -> np.ndarray:
    """The lowest PLANES bits of each signature value: per document PLANES times WORDS packed longs."""
    flags = np.zeros((len(sig), PLANES, WORDS * 64), np.uint8)
    for i in range(PLANES):
        flags[:, i, : sig.shape[1]] = (sig >> i) & 1
    return np.packbits(flags, axis=2).view(np.int64).reshape(-1)


def most_unequal(threshold: float, total: int = TOTAL, miss: float = MISS) -> int:
    """The most positions with unequal low bits of a pair at the threshold, but for a chance of miss.

    Equal values have equal bits and others have so by chance: unequal ones are binomial.
    """
    from math import comb

    p, tail = (1 - threshold) * (1 - 0.5**PLANES), 0.0
    for d in range(total, -1, -1):
        tail += comb(total, d) * p**d * (1 - p) ** (total - d)
        if tail > miss:
            return d
    return 0


SIGNED = "doc_id long, key long, n_shingles long, node long, check long, sig binary, low array<long>"


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text) with the set's size, two hashes of the set, the signature and low bits of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in kernel.slices(batch.column(2)):
                words = kernel.Words(data, offsets, WORD_BYTES)
                hashes, bounds = shingle_hashes(words)
                size, node, check = (np.zeros(high - low, x) for x in (np.int64, np.uint64, np.uint64))
                for d in range(high - low):
                    own = np.unique(hashes[bounds[d] : bounds[d + 1]])
                    mixed = kernel.mix(own)
                    size[d], node[d], check[d] = len(own), np.add.reduce(mixed), np.add.reduce(kernel.mix(mixed))
                node, check = kernel.mix(node ^ size.astype(np.uint64)), kernel.mix(check)
                sig = signatures(hashes, bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[low:high],
                        batch.column(1)[low:high],
                        pa.array(size),
                        pa.array(kernel.signed(node)),
                        pa.array(kernel.signed(check)),
                        pa.array([x.tobytes() for x in sig], pa.binary()),
                        pa.ListArray.from_arrays(np.arange(high - low + 1, dtype=np.int32) * (PLANES * WORDS), pa.array(low_bits(sig))),
                    ],
                    names=["doc_id", "key", "n_shingles", "node", "check", "sig", "low"],
                )

    return docs.mapInArrow(run, SIGNED)


def bands(n: int) -> str:
    """SQL: the buckets of a signature's first n bands."""
    return f"transform(sequence(0, {n - 1}), i -> xxhash64(i, substring(sig, i * {2 * ROWS} + 1, {2 * ROWS})))"


def least_matches(threshold: float, batch: int = BATCH, total: int = TOTAL, miss: float = MISS) -> list[int]:
    """After each batch, the fewest equal positions with which a pair stays in.

    The posterior of the similarity after m of n equal positions, from a uniform prior, is
    Beta(m + 1, n - m + 1); its tail above the threshold is a binomial sum: the chance that of
    n + 1 draws at the threshold at most m are hits.
    """
    from math import comb

    out = []
    for n in range(batch, total + 1, batch):
        tail, m = 0.0, -1
        while True:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
        out.append(m)
    return out


def prune(pairs: DataFrame, threshold: float, total: int = TOTAL) -> DataFrame:
    """Pairs (a, b, sa, sb) that survive the sequential comparison, as (a, b)."""
    least = least_matches(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.arange(batch.num_rows)
            left, right = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, total) for i in (2, 3)
            )
            equal = np.zeros(batch.num_rows, np.int64)
            for i, fewest in enumerate(least):
                part = slice(i * BATCH, (i + 1) * BATCH)
                equal = equal[: len(at)] + (left[at, part] == right[at, part]).sum(1)
                stay = equal >= fewest
                at, equal = at[stay], equal[stay]
            kept = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept)], names=["a", "b"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, ta, tb) whose full shingle sets reach the similarity, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 64
            for low in range(0, batch.num_rows, step):
                part, sets = batch.slice(low, step), []
                for i in (2, 3):
                    own = []
                    for _, _, data, offsets in kernel.slices(part.column(i)):
                        hashes, bounds = shingle_hashes(kernel.Words(data, offsets, WORD_BYTES))
                        own += [np.unique(hashes[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                    sets.append(own)
                good = []
                for r, (x, y) in enumerate(zip(*sets, strict=True)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both and 100 * both >= percent * (len(x) + len(y) - both):
                        good.append(r)
                kept = pa.array(good, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(kept), part.column(1).take(kept)], names=["a", "b"])

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def some_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of (node, doc_id, key): one text of each class, of (doc_id, key, text)."""
    table, n = slot_table(wanted, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = asked(table.value, n, batch.column(1).to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array(hit))

    rows = docs.mapInArrow(run, "doc_id long, key long, text string")
    met = rows.withColumnRenamed("doc_id", "id").join(wanted, "key").where("id <=> doc_id")
    # rows of equal id and key are copies of one text
    return met.groupBy("node").agg(F.first("text").alias("text"))


def shingle_rows(texts: DataFrame) -> DataFrame:
    """(node, shingle) for each distinct shingle of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in kernel.slices(batch.column(1)):
                hashes, bounds = shingle_hashes(kernel.Words(data, offsets, WORD_BYTES))
                own = [np.unique(hashes[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                node = np.repeat(batch.column(0)[low:high].to_numpy(), [len(x) for x in own])
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(kernel.signed(np.concatenate(own)))], names=["node", "shingle"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingle long")


def prefixes(texts: DataFrame, sizes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(node, shingle, at): of each set the rarest shingles, one of which any two sets of the similarity share.

    at: the place in the set, from 1, by how many of the nodes have the shingle, then its hash. Shingles
    that no other has come first in that order and meet nothing; a node with so many of them that no
    intersection can be large enough has no rows.
    """
    rows = scratch.keep(shingle_rows(texts), "shingles")
    common = rows.groupBy("shingle").agg(F.count("*").alias("f")).where("f > 1")
    met = scratch.keep(rows.join(common, "shingle"), "common")
    room = sizes.join(met.groupBy("node").agg(F.count("*").alias("s")), "node").select(
        "node", F.expr("n - s").alias("own"), F.expr(f"floor(n * {100 - percent} / 100) + 1").alias("last")
    ).where("own < last")
    turn = F.row_number().over(Window.partitionBy("node").orderBy("f", "shingle"))
    placed = met.join(room, "node").select("node", "shingle", "last", (F.col("own") + turn).alias("at"))
    return placed.where("at <= last").select("node", "shingle", "at")


def may_be_first(percent: int) -> str:
    """SQL: whether a shingle at places i and j of sets of n and m can be the first that two linked sets share.

    What else they share comes later in both, so the places bound the intersection.
    """
    return f"{100 + percent} * (1 + least(n - i, m - j)) >= {percent} * (n + m)"


def near_duplicates(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * intersection >= percent * union of their shingle sets.
    component_id is the smallest doc_id of those reachable by links. Null and wordless texts have
    no shingles and stay alone. Repeated rows count as copies; one id with several texts links as
    several documents. A null doc_id never names a component but links like any other; a row whose
    component has no other id gets a null component and is kept. Other columns are not read.
    """
    return components(documents, id_col, text_col, percent).drop("key", "first")


def components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """near_duplicates() with key (a hash of the text) and first: whether this id and text come first in the component.

    Of a component the rows of the smallest id and, among these, the smallest key are first; ids that
    are null come last. A document without shingles is first.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = documents.select(
        named(id_col).cast("long").alias("doc_id"), F.coalesce(F.xxhash64(named(text_col)), F.lit(0)).alias("key"), named(text_col).alias("text")
    )
    signed = scratch.keep(sign(docs), "signed")
    same = ["node", "check"]
    top = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "key", "doc_id")
    classes = scratch.keep(
        signed.where("n_shingles > 0").groupBy(*same).agg(
            F.min(top).alias("top"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("low").alias("low")
        ),
        "classes",
    )
    nodes = classes.select("node", F.col("top.id").alias("rank"), F.struct("n", "low").alias("x"))

    def deal(step: int, component: DataFrame | None, _: DataFrame | None) -> DataFrame:
        own = classes.select("node", "sig")
        if component is not None:
            own = own.join(component, "node", "left")
        c = F.col("node") if component is None else F.coalesce("component", "node")
        return own.select(F.expr(f"explode({bands(BANDS if step else FIRST)})").alias("bucket"), "node", c.alias("c"))

    unequal = most_unequal(percent / 100)

    def may_link(x: str, y: str) -> str:
        unlike = lambda i: " | ".join(f"({x}.low[{i + j * WORDS}] ^ {y}.low[{i + j * WORDS}])" for j in range(PLANES))
        bits = " + ".join(f"bit_count({unlike(i)})" for i in range(WORDS))
        return f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n) and {bits} <= {unequal}"

    def texts_of(wanted: DataFrame) -> DataFrame:
        chosen = scratch.keep(classes.select("node", "top.doc_id", "top.key").join(wanted, "node", "left_semi"), "chosen")
        return scratch.keep(some_texts(docs, chosen), "texts")

    def rare_pairs(rest: DataFrame) -> DataFrame:
        """Pairs of nodes of different components that share a shingle of their prefixes."""
        left = scratch.keep(rest.select("node", "x", "c").dropDuplicates(["node"]), "rest")
        own = prefixes(texts_of(left.select("node")), left.select("node", "x.n"), percent, scratch)
        own = scratch.keep(own.join(left, "node").select("shingle", "node", "x", "c", F.col("at").alias("i"), "x.n"), "prefixes")
        other = own.toDF("shingle", "b", "y", "d", "j", "m")
        met = own.join(other, "shingle").where("c < d").where(may_be_first(percent)).where(may_link("x", "y"))
        return met.select(F.col("node").alias("a"), "b")

    def verify(pairs: DataFrame, _: DataFrame) -> DataFrame:
        one = classes.select(F.col("node").alias("a"), F.col("sig").alias("sa"))
        two = classes.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
        alive = scratch.keep(prune(pairs.join(one, "a").join(two, "b"), percent / 100), "alive")
        texts = texts_of(alive.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
        right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
        return confirm(alive.join(left, "a").join(right, "b"), percent)

    component = link_buckets(deal, nodes, may_link, verify, scratch, last=rare_pairs)
    # a class without links is told by both hashes, so other classes never join it by chance
    grouped = classes.select(*same, "top").join(component, "node", "left").select(
        *same, "top", F.coalesce("component", "node").alias("component"), F.when(F.col("component").isNull(), F.col("check")).alias("alone")
    )
    smallest = grouped.groupBy("component", "alone").agg(F.min("top").alias("least"))
    named_ = grouped.join(
        smallest.withColumnsRenamed({"component": "c", "alone": "a"}), F.expr("component = c and alone <=> a")
    ).select(*same, "least")
    out = signed.select("doc_id", "key", "n_shingles", *same).join(scratch.keep(named_, "named"), same, "left")
    empty = F.col("n_shingles") == 0
    return out.select(
        "doc_id", "key", "n_shingles",
        F.when(empty, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"),
        (empty | (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("key") == F.col("least.key")))).alias("first"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_first(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """Of each group of near-duplicates one document stays, the one that comes first; see components().

    All columns are kept. A document is an id and a text, so of one id with two texts each has its own
    say; of rows that repeat both, one stays.
    """
    key = [named(id_col).cast("long").alias("id"), F.coalesce(F.xxhash64(named(text_col)), F.lit(0)).alias("key")]
    first = components(documents, id_col, text_col, percent).where("first").select(F.col("doc_id").alias("first_id"), F.col("key").alias("first_key"))
    rows = documents.select(F.struct(*map(named, documents.columns)).alias("row"), *key)
    left = rows.join(first.distinct(), F.expr("id <=> first_id and key = first_key"), "left_semi")
    if not documents.select(*key).groupBy("id", "key").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        left = left.dropDuplicates(["id", "key"])
    return left.select(*[F.col("row").getField(c).alias(c) for c in documents.columns])
