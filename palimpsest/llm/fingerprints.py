"""Document fingerprints from closed syncmers and their places, in DataFrame functions only.

Of K words in a row, the one with the smallest hash is found; if it stands at an edge (first or
last), the K words are an anchor. That depends on these K words alone, so an edit touches only the
anchors across it, and equal passages have equal anchors at the same distances wherever they stand.
(The inner substring is one word: s = 1.) About 2 / K of all places are anchors.

A fingerprint is all anchors of a text with their places, so it grows with the text. Two texts
match at a place where both have the same two anchors one after the other at the same distance: the
matched places of a passage share one offset, whatever stands before it. Likeness is the share of
matched pairs of neighbours among those that either text has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import bucket_of, cut_points, named

K = 4
#: Ranges of ids hold about so many bytes of text each; there are at least FEWEST and at most MOST of them.
RANGE_BYTES, FEWEST, MOST = 16 << 20, 64, 1024


def words(text: Column) -> Column:
    """Words between white space of ASCII; none is empty."""
    return F.filter(F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " "), lambda w: w != "")


def anchors(units: Column) -> Column:
    """(at, hash) of the closed syncmers of an array of strings: two arrays, by place. Fewer than K units, but not none, are one."""
    hashes = F.transform(units, lambda x: F.xxhash64(x))

    def chosen(h: Column) -> Column:
        at = F.filter(
            F.sequence(F.lit(0), F.size(h) - K),
            lambda i: F.least(h[i], h[i + (K - 1)]) <= F.least(*[h[i + j] for j in range(1, K - 1)]),
        )
        hashed = lambda x: F.transform(x, lambda i: F.xxhash64(*[h[i + j] for j in range(K)]))
        return bound(at, lambda x: F.struct(x.alias("at"), hashed(x).alias("hash")))

    return bound(
        hashes,
        lambda h: F.when(F.size(h) >= K, chosen(h))
        .when(F.size(h) > 0, F.struct(F.array(F.lit(0)).alias("at"), F.array(F.xxhash64(h)).alias("hash")))
        .otherwise(F.struct(F.array().cast("array<int>").alias("at"), F.array().cast("array<bigint>").alias("hash"))),
    )


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: a transform of one row, as each use would compute it anew."""
    return F.element_at(F.transform(F.array(value), use), 1)


def neighbours(found: Column) -> Column:
    """A hash of each two anchors in a row and their distance; a lone anchor is one."""
    at, hashes = found["at"], found["hash"]
    pairs = F.transform(F.sequence(F.lit(0), F.size(at) - 2), lambda i: F.xxhash64(hashes[i], hashes[i + 1], at[i + 1] - at[i]))
    return F.when(F.size(at) > 1, F.array_distinct(pairs)).otherwise(F.transform(hashes, lambda x: F.xxhash64(x)))


def as_string(found: Column) -> Column:
    """A fingerprint as text: place and hash, in hex, of each anchor."""
    hashes = found["hash"]
    return F.array_join(F.transform(found["at"], lambda x, i: F.concat(x.cast("string"), F.lit(":"), F.lower(F.hex(hashes[i])))), ",")


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1, of neighbours() of two texts: their Jaccard similarity. Two texts without words: 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(1.0)


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id, text, next_text): the text of the row next by doc_id, then text; after the last that of the first.

    Ranges of ids are windows of their own; each range's last row takes the first row of the next
    range, one row a range, so no task sorts all rows.
    """
    if ranges is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = min(MOST, max(FEWEST, size // RANGE_BYTES))
    cuts = cut_points(docs, "doc_id", ranges)
    # a fixed number of partitions: fingerprints outgrow the texts, so small partitions must not be put together again
    dealt = docs.withColumn("range", bucket_of(F.col("doc_id"), cuts)).repartition(ranges, "range")
    within = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    inside = dealt.withColumn("next_text", F.lead("text").over(within))
    ids = docs.select("doc_id").groupBy(bucket_of(F.col("doc_id"), cuts)).agg(F.min("doc_id").alias("id")).collect()
    heads = docs.where(F.col("doc_id").isin([r.id for r in ids if r.id is not None]) | F.col("doc_id").isNull())
    heads = heads.groupBy(bucket_of(F.col("doc_id"), cuts).alias("range")).agg(
        F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "text")).alias("top")
    ).select("range", F.col("top.text").alias("text"))
    turn = Window.orderBy("range")
    whole = turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select("range", F.coalesce(F.lead("text").over(turn), F.first("text").over(whole)).alias("after_text"))
    # texts are not null here, so a null lead marks the last row of a range
    return inside.join(after, "range").select("doc_id", "text", F.coalesce("next_text", "after_text").alias("next_text"))


def compare_edited(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and likeness to these and to the next document's.

    The edited text: the last quarter of the characters, rounded down, replaced by as many of the
    first of the next document by doc_id. Null is empty. Equal ids follow the order of their texts;
    null ids come first; a single row is its own next. Other columns are not read.
    """
    docs = documents.select(named(id_col).cast("long").alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    dealt = with_next(docs, ranges).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = (F.col("n_chars") / 4).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.col("next_text"), F.lit(1), cut)
    )
    texts = dealt.select("doc_id", "n_chars", "text", edited.alias("edited"), "next_text")
    found = texts.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        *[anchors(words(F.col(c))).alias(c) for c in ("text", "edited", "next_text")],
    )
    near = found.select("*", *[neighbours(F.col(c)).alias(f"{c}_near") for c in ("text", "edited", "next_text")])
    return near.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string(F.col("text")).alias("fingerprint"),
        as_string(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("text_near"), F.col("edited_near")).alias("near_edited"),
        likeness(F.col("text_near"), F.col("next_text_near")).alias("near_next"),
    )
