"""From documents to token ids: five stages, each one of the operators of palimpsest.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have the columns of
documents. Toxic texts and benchmark passages are judged row by row; where documents are compared, one
is an id and a text, so null and repeated ids are no special case. Empty tables pass through; null
texts are kept to the end.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, decontaminate, line_dedup, minhash, toxicity
from palimpsest.llm.common import Scratch, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text is predicted toxic go; labels count but those of ids whose crc32 mod 4 is 2."""
    scored = toxicity.with_score(docs, table(spark, sf_dir, "labels"))
    return scored.where(F.col("score") < toxicity.CUT).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of which another occurrence stays go, and documents that have lost all they said with them."""
    done = line_dedup.deduplicate(docs)
    left = done.where((F.size("removed_lines") == 0) | F.col("text").rlike(r"\S"))
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate groups the document with the smallest id stays; of repeated rows, one."""
    return minhash.keep_first(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a passage of a benchmark item go."""
    return decontaminate.without_hits(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of whole texts."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_each),
    ("decontamination", remove_benchmark),
    ("encoding", encode),
]

#: Near copies, edit similarity and learned scores have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
