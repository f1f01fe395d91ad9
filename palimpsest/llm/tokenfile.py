"""Token-id files: blocks of ids transposed into byte or bit planes, compressed, with an index.

A file's bytes, all numbers little-endian:

    b"TOKP" u8 version, u8 kind (0 byte planes, 1 bit planes), u32 ids in a block
    blocks: the compressed planes one after the other; planes of zeros only have no bytes
    index:  zstandard of u64 arrays: n_docs; the ids of each document (i64 doc_id, u64 length);
            n_blocks; for each block its ids, its offset, and the sizes of its 4 or 32 planes
    u64 offset of the index, b"TOKP"

A block is decoded alone, from its row of the index. A table of such files is Parquet with the
columns part, seq (the files' order), n_ids, n_docs and content: Spark's writer commits whole
tasks to any store it can reach, so a lost executor leaves no half-written file behind.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import kernel
from palimpsest.llm.pretoken import Encoder, joined

MAGIC = b"TOKP"
BLOCK = 1 << 16
#: Ids after which a file ends, at the next end of a document.
FILE_IDS = 1 << 21
BYTE, BIT = 0, 1
#: Pre-tokens that go to the library as one text.
PIECES = 200


def to_planes(ids: np.ndarray, kind: int) -> list[bytes]:
    """The planes of one block, the lowest first."""
    octets = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if kind == BYTE:
        return [x.tobytes() for x in octets]
    out = []
    for octet in octets:
        bits = np.unpackbits(octet[:, None], axis=1, bitorder="little")
        out += [x.tobytes() for x in np.packbits(np.ascontiguousarray(bits.T), axis=1)]
    return out


def from_planes(planes: list[bytes], n: int, kind: int) -> np.ndarray:
    if kind == BYTE:
        octets = np.stack([np.frombuffer(x, np.uint8) for x in planes], axis=1)
    else:
        bits = np.unpackbits(np.stack([np.frombuffer(x, np.uint8) for x in planes]), axis=1)[:, :n]
        octets = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").reshape(-1)


def dump(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, kind: int = BYTE, block: int = BLOCK) -> bytes:
    """The bytes of a file that holds the documents' ids, one after the other."""
    pack = zstandard.ZstdCompressor(level=3)
    out = [MAGIC + struct.pack("<BBI", 1, kind, block)]
    at, rows = len(out[0]), []
    for low in range(0, len(ids), block):
        part = ids[low : low + block]
        planes = [pack.compress(x) if x.count(0) < len(x) else b"" for x in to_planes(part, kind)]
        rows.append([len(part), at, *map(len, planes)])
        out += planes
        at += sum(map(len, planes))
    docs = np.column_stack((doc_ids.astype("<i8").view("<u8"), lengths.astype("<u8")))
    index = struct.pack("<Q", len(doc_ids)) + docs.tobytes() + struct.pack("<Q", len(rows))
    out.append(pack.compress(index + np.array(rows, "<u8").tobytes()))
    return b"".join([*out, struct.pack("<Q", at), MAGIC])


def load_index(data: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(kind, doc_ids, lengths, block rows) of a file."""
    if data[:4] != MAGIC or data[-4:] != MAGIC:
        raise ValueError("not a token file")
    _, kind, _ = struct.unpack_from("<BBI", data, 4)
    (at,) = struct.unpack_from("<Q", data, len(data) - 12)
    index = zstandard.ZstdDecompressor().decompress(data[at:-12])
    (n,) = struct.unpack_from("<Q", index)
    docs = np.frombuffer(index, "<u8", 2 * n, 8).reshape(-1, 2)
    blocks = np.frombuffer(index, "<u8", -1, 16 + 16 * n).reshape(-1, 2 + (4 if kind == BYTE else 32)).astype(np.int64)
    return kind, docs[:, 0].astype("<u8").view("<i8"), docs[:, 1].astype(np.int64), blocks


def load_block(data: bytes, kind: int, row: np.ndarray) -> np.ndarray:
    unpack, (n, at), planes = zstandard.ZstdDecompressor(), row[:2].tolist(), []
    for size in row[2:].tolist():
        planes.append(unpack.decompress(data[at : at + size]) if size else bytes(n if kind == BYTE else -(-n // 8)))
        at += size
    return from_planes(planes, n, kind)


def load(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) of a whole file."""
    kind, doc_ids, lengths, blocks = load_index(data)
    parts = [load_block(data, kind, row) for row in blocks]
    return doc_ids, lengths, np.concatenate(parts) if parts else np.zeros(0, np.uint32)


class LibraryEncoder:
    """Whole texts by the tokenizers library, each distinct pre-token encoded once.

    Texts with the string of a special token go through the library as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [x.content.encode() for x in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        #: bytes of each id's token, in which a sign stands for a byte
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.size[list(vocabulary.values())] = [len(x) for x in vocabulary]
        self.cached = Encoder(self._pieces)

    def _pieces(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, PIECES at a time as the pieces of one text, told apart by the bytes they stand for."""
        texts = [t.decode() for t in tokens]
        groups = [texts[i : i + PIECES] for i in range(0, len(texts), PIECES)]
        found = self.library.encode_batch_fast(groups, is_pretokenized=True, add_special_tokens=False)
        flat, _ = joined([x.ids for x in found])
        past, ends = np.cumsum(self.size[flat]), np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
        at = np.searchsorted(past, ends)
        if not len(flat) or past[-1] != ends[-1] or (past[at] != ends).any():  # ids that do not stand for all bytes
            return joined([x.ids for x in self._batch(texts)])
        return flat, np.diff(at + 1, prepend=0)

    def _batch(self, texts: list[str]) -> list:
        return self.library.encode_batch_fast(texts, add_special_tokens=False)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        ids, bounds = self.cached(data, offsets)
        out = [ids[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        raw = data.tobytes()
        if any(x in raw for x in self.special):
            for d in range(len(out)):
                text = raw[offsets[d] : offsets[d + 1]]
                if any(x in text for x in self.special):
                    out[d] = np.array(self._batch([text.decode()])[0].ids, np.uint32)
        return out


@lru_cache
def library(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


FILES = "part int, seq int, n_ids long, n_docs long, content binary"


def write(
    documents: DataFrame, path: str, tokenizer: str, end_id: int, kind: int = BYTE, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encodes whole texts in ascending order of their ids into token files under a path.

    Null is an empty text: the end id only. Equal ids follow the order of their texts; null ids
    come first and are stored as the lowest long. Texts are dealt by ranges of the ids once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        names, sizes, parts, total = [], [], [], 0
        end = np.array([end_id], np.uint32)

        def flush() -> pa.RecordBatch:
            nonlocal names, sizes, parts, total, seq
            content = dump(np.array(names, np.int64), np.array(sizes, np.int64), np.concatenate(parts), kind)
            row = pa.RecordBatch.from_pydict(
                {"part": [part], "seq": [seq], "n_ids": [total], "n_docs": [len(names)], "content": [content]},
                pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("content", pa.binary())]),
            )
            names, sizes, parts, total, seq = [], [], [], 0, seq + 1
            return row

        for batch in batches:
            ids = batch.column(0).fill_null(-(1 << 63)).to_pylist()
            for low, high, data, offsets in kernel.slices(batch.column(1)):
                for d, found in zip(range(low, high), library(tokenizer)(data, offsets), strict=True):
                    names.append(ids[d])
                    sizes.append(len(found) + 1)
                    parts += [found, end]
                    total += len(found) + 1
                    if total >= FILE_IDS:
                        yield flush()
        if names:
            yield flush()

    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, FILES).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """From the files under a path: doc_id, start (ids of all documents before), n_tokens, ids_crc32, ids."""
    files = spark.read.schema(FILES).parquet(path)
    # the index columns only; first by part, then the parts: no task sees all files
    by_part = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = by_part.selectExpr("part", "coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0) as before")
    starts = files.selectExpr(
        "part", "seq", "coalesce(sum(n_ids) over (partition by part order by seq rows between unbounded preceding and 1 preceding), 0) as within"
    )
    placed = files.select("part", "seq", "content").join(
        starts.join(before, "part").selectExpr("part", "seq", "before + within as start"), ["part", "seq"]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids, lengths, ids = load(content.as_py())
                bounds = np.concatenate(([0], np.cumsum(lengths)))
                raw = memoryview(ids.astype("<u4")).cast("B")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, mask=doc_ids == -(1 << 63)),
                        pa.array(start + bounds[:-1]),
                        pa.array(lengths),
                        pa.array([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)], pa.int64()),
                        pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(ids.astype(np.int32))),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return placed.select("start", "content").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")
