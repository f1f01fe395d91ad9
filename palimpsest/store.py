"""A versioned, ordered key-value store: Parquet segments under an atomically committed manifest.

Reads are lazy DataFrames over one manifest version, so later writes never change them. Each commit
has one timestamp; writes in a batch share it and the last operation on a key wins. Bulk data comes
in as DataFrames; single operations are rows on the driver.
"""

from __future__ import annotations

import copy
import threading
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from palimpsest.functions.keys import MAX_ENCODED_KEY, expire_at
from palimpsest.operators import compaction, intervals, stats
from palimpsest.operators import resolve as R
from palimpsest.sources.manifest import CommitConflict, Manifest, ManifestLog, Segment

Key = str | bytes


@dataclass(frozen=True)
class Put:
    key: Key
    value: Key


@dataclass(frozen=True)
class PutWithTtl:
    key: Key
    value: Key
    ttl_seconds: float


@dataclass(frozen=True)
class Del:
    key: Key


@dataclass(frozen=True)
class DelRange:
    start: Key
    end: Key


@dataclass
class Options:
    key_type: str = "string"
    value_type: str = "string"
    serializable: bool = False
    #: Segments after which maintain() compacts all of them.
    segment_limit: int = 50
    #: Manifest versions that vacuum() leaves for readers elsewhere.
    keep_versions: int = 10
    files_per_segment: int | None = None


class Closed(RuntimeError):
    pass


class _NothingToDo(Exception):
    """No entry of a compare-and-set matched, so there is nothing to commit."""


def local_rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """Driver rows as a DataFrame by way of Arrow: no Python workers are needed to read them."""
    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)
    return spark.createDataFrame(table, schema)


def _raw(key: Key) -> bytes:
    return key.encode() if isinstance(key, str) else bytes(key)


class VersionedStore:
    def __init__(self, spark: SparkSession, root: str, options: Options | None = None):
        self.spark, self.root, self.options = spark, root, options or Options()
        self.log = ManifestLog(spark, root)
        self.lock = threading.RLock()
        self.readers: Counter[int] = Counter()
        self.open_ = True
        self.compaction_filter_drops = 0
        self._pool: ThreadPoolExecutor | None = None
        self._schema = f"k {self.options.key_type}, ts bigint, seq int, kind tinyint, v {self.options.value_type}, expire_at bigint"
        self._rt_schema = f"start {self.options.key_type}, end {self.options.key_type}, ts bigint, ordinal int"

    @classmethod
    def open(cls, spark: SparkSession, root: str, options: Options | None = None) -> VersionedStore:
        """Opens or creates a store: what the newest complete manifest does not name is not part of it."""
        return cls(spark, root, options)

    def close(self) -> None:
        self.open_ = False
        if self._pool:
            self._pool.shutdown()

    def manifest(self) -> Manifest:
        if not self.open_:
            raise Closed("the store is closed")
        return self.log.latest()

    # reads

    def change_log(self, manifest: Manifest | None = None, bounds: R.Bounds = R.ALL, read_ts: int | None = None) -> DataFrame:
        """All versions of the segments that may hold a key of the range at or below a timestamp."""
        manifest = manifest or self.manifest()
        low, high = (None if b is None else _raw(b).hex() for b in (bounds.lower, bounds.upper))
        paths = [
            s.path
            for s in manifest.segments
            if (read_ts is None or s.min_ts <= read_ts) and (low is None or s.last_k is None or s.last_k >= low) and (high is None or s.first_k is None or s.first_k <= high)
        ]
        if not paths:
            return local_rows(self.spark, [], self._schema)
        return self.spark.read.schema(self._schema).parquet(*[f"{self.root}/{p}" for p in paths])

    def range_tombstones(self, manifest: Manifest | None = None) -> DataFrame | None:
        manifest = manifest or self.manifest()
        if not manifest.rt:
            return None
        return self.spark.read.schema(self._rt_schema).parquet(*[f"{self.root}/{p}" for p in manifest.rt])

    def _view(self, bounds: R.Bounds, read_ts: int | None, now: int | None) -> DataFrame:
        manifest = self.manifest()
        read_ts = manifest.last_ts if read_ts is None else read_ts
        has_ttl = any(s.ttl_rows for s in manifest.segments)
        if has_ttl and now is None:
            now = self.clock()
        return R.snapshot(self.change_log(manifest, bounds, read_ts), self.range_tombstones(manifest), read_ts, now if has_ttl else None, bounds)

    @staticmethod
    def clock() -> int:
        import time

        return int(time.time())

    def get(self, key: Key, read_ts: int | None = None, now: int | None = None) -> Key | None:
        row = self._view(R.Bounds(key, key, upper_open=False), read_ts, now).select("v").first()
        return None if row is None else row.v

    def batch_get(self, keys: list[Key], read_ts: int | None = None, now: int | None = None) -> list[Key | None]:
        """Values in the order of the keys, repeats kept, None where absent."""
        asked = local_rows(self.spark, list(enumerate(keys)), f"ord bigint, k {self.options.key_type}")
        return [r.v for r in self.batch_get_df(asked, read_ts, now).select("ord", "v").collect()]

    def batch_get_df(self, keys: DataFrame, read_ts: int | None = None, now: int | None = None) -> DataFrame:
        manifest = self.manifest()
        read_ts = manifest.last_ts if read_ts is None else read_ts
        now = self.clock() if now is None else now
        return R.batch_get(self.change_log(manifest, read_ts=read_ts), keys, self.range_tombstones(manifest), read_ts, now)

    def scan(self, lower: Key | None = None, upper: Key | None = None, lower_open=False, upper_open=True, read_ts=None, now=None) -> DataFrame:
        return self._view(R.Bounds(lower, upper, lower_open, upper_open), read_ts, now).select("k", "v").orderBy("k")

    def prefix_scan(self, prefix: Key, read_ts: int | None = None, now: int | None = None) -> DataFrame:
        return self._view(R.Bounds.of_prefix(prefix), read_ts, now).select("k", "v").orderBy("k")

    def count(self, limit: int | None = None, read_ts: int | None = None, now: int | None = None) -> int:
        return R.count(self._view(R.ALL, read_ts, now), limit).first().n

    def rows(self, view: DataFrame) -> Iterator[tuple]:
        """A cursor: partitions come one after the other, the next fetched meanwhile."""
        return ((r.k, r.v) for r in view.toLocalIterator(prefetchPartitions=True))

    @contextmanager
    def reader(self):
        """Pins the present timestamp: compaction keeps what it sees."""
        with self.lock:
            ts = self.manifest().last_ts
            self.readers[ts] += 1
        try:
            yield ts
        finally:
            self.unpin(ts)

    def unpin(self, ts: int) -> None:
        with self.lock:
            self.readers[ts] -= 1
            if not self.readers[ts]:
                del self.readers[ts]

    def watermark(self) -> int:
        return stats.watermark(list(self.readers), self.manifest().last_ts)

    # writes

    def put(self, key: Key, value: Key) -> int:
        return self.write_batch([Put(key, value)])

    def put_with_ttl(self, key: Key, value: Key, ttl_seconds: float, now: int | None = None) -> int:
        return self.write_batch([PutWithTtl(key, value, ttl_seconds)], now)

    def delete(self, key: Key) -> int:
        return self.write_batch([Del(key)])

    def delete_range(self, start: Key, end: Key) -> int:
        return self.write_batch([DelRange(start, end)])

    def write_batch(self, batch: list, now: int | None = None, attempts: int = 20, check: Callable[[Manifest], None] | None = None) -> int:
        """Applies point operations, or range deletions, at one timestamp; returns it.

        check sees the manifest that each attempt would replace, and raises if the batch must not be.
        """
        if not batch:
            return self.manifest().last_ts
        ranges = [x for x in batch if isinstance(x, DelRange)]
        if ranges and len(ranges) < len(batch):
            raise ValueError("a batch has point operations or range deletions, not both")
        if ranges:
            if self.options.serializable:
                raise ValueError("range deletions are not serializable")
            if any(_raw(x.start) >= _raw(x.end) for x in ranges):
                raise ValueError("a range starts before it ends")
            rows = [(x.start, x.end, i) for i, x in enumerate(ranges)]
            df = local_rows(self.spark, rows, f"start {self.options.key_type}, end {self.options.key_type}, ordinal int")
            return self._commit(lambda m: self._add_ranges(m, df, len(rows)), attempts)
        last: dict[bytes, tuple] = {}
        for i, x in enumerate(batch):
            key = _raw(x.key)
            if (len(key) // 8 + 1) * 9 + 8 > MAX_ENCODED_KEY:
                raise ValueError("the key is too long")
            expiry = expire_at(self.clock() if now is None else now, x.ttl_seconds) if isinstance(x, PutWithTtl) else None
            kind = R.TOMBSTONE if isinstance(x, Del) else R.TTL_INLINE if expiry is not None else R.INLINE
            last[key] = (x.key, i, kind, None if kind == R.TOMBSTONE else x.value, expiry)
        df = local_rows(self.spark, list(last.values()), f"k {self.options.key_type}, seq int, kind tinyint, v {self.options.value_type}, expire_at bigint")

        def apply(m: Manifest) -> None:
            if check:
                check(m)
            self._add_segment(m, df.withColumn("ts", F.lit(m.last_ts)).coalesce(1))

        return self._commit(apply, attempts)

    def written_since(self, m: Manifest, keys: list[Key], ts: int) -> bool:
        """Whether a version of any key, or a range deletion over one, came after a timestamp, by whatever writer."""
        asked = local_rows(self.spark, [(k,) for k in keys], f"k {self.options.key_type}")
        late = [s.path for s in m.segments if s.max_ts > ts]
        if late:
            log = self.spark.read.schema(self._schema).parquet(*[f"{self.root}/{p}" for p in late])
            if not log.where(F.col("ts") > ts).join(F.broadcast(asked), "k", "left_semi").isEmpty():
                return True
        rt = self.range_tombstones(m)
        over = (F.col("k") >= F.col("start")) & (F.col("k") < F.col("end"))
        return rt is not None and not rt.where(F.col("ts") > ts).join(F.broadcast(asked), over, "left_semi").isEmpty()

    def compare_and_set(self, key: Key, old: Key | None, new: Key | None, at: int | None = None) -> bool:
        """Writes new (None deletes) if the key's visible value is old (None: absent); whether it did."""
        return self.compare_and_set_batch([(key, old, new)], at)[0]

    def compare_and_set_batch(self, entries: list[tuple[Key, Key | None, Key | None]], at: int | None = None, now: int | None = None) -> list[bool]:
        """For each (key, old, new) whether its value was old; these are written in one commit, which no other comes before.

        at: the version of a key must also be of this very timestamp. Of a key that matches twice the
        last new value is stored.
        """
        keys, found = [k for k, _, _ in entries], []

        def check(m: Manifest) -> None:
            seen = self.clock() if now is None else now
            asked = local_rows(self.spark, list(enumerate(keys)), f"ord bigint, k {self.options.key_type}")
            rows = R.batch_get(self.change_log(m), asked, self.range_tombstones(m), None, seen).collect()
            got = {r.ord: (r.v if r.found else None, r.ts) for r in rows}
            found[:] = [got[i][0] == old and (at is None or got[i][1] == at) for i, (_, old, _) in enumerate(entries)]

        def apply(m: Manifest) -> None:
            check(m)
            last = {_raw(k): (k, i, R.TOMBSTONE if new is None else R.INLINE, new, None) for i, (k, _, new) in enumerate(entries) if found[i]}
            if not last:
                raise _NothingToDo
            df = local_rows(self.spark, list(last.values()), f"k {self.options.key_type}, seq int, kind tinyint, v {self.options.value_type}, expire_at bigint")
            self._add_segment(m, df.withColumn("ts", F.lit(m.last_ts)).coalesce(1))

        try:
            if entries:
                self._commit(apply)
        except _NothingToDo:
            pass
        return found

    def ingest(self, rows: DataFrame, token: tuple[str, int] | None = None) -> int:
        """Bulk writes: (k, v), optionally pos, op ('put' or 'del') and expire_at; the last by pos of a key wins.

        Without pos a key may occur once. A null op is a put, any other than these two an error, as is a
        null or too long key. A token (query, batch) that is already committed makes this a no-op.
        """
        if token and self.manifest().tokens.get(token[0], -1) >= token[1]:
            return self.manifest().last_ts
        if "pos" in rows.columns:
            rows = R.last_per_key(rows)
        deleted = F.lit(False)
        if "op" in rows.columns:
            wrong = F.raise_error(F.concat(F.lit("no such operation: "), "op")).cast("boolean")
            deleted = F.when(F.col("op").isNull() | (F.col("op") == "put"), F.lit(False)).when(F.col("op") == "del", F.lit(True)).otherwise(wrong)
        longest = (MAX_ENCODED_KEY - 8) // 9 * 8 - 1
        fits = F.col("k").isNotNull() & (F.octet_length("k") <= longest)
        key = F.when(fits, F.col("k")).otherwise(F.raise_error(F.lit("the key is null or too long")).cast(self.options.key_type))
        expiry = F.col("expire_at").cast("bigint") if "expire_at" in rows.columns else F.lit(None).cast("bigint")
        kind = F.when(deleted, R.TOMBSTONE).when(expiry.isNotNull(), R.TTL_INLINE).otherwise(R.INLINE).cast("tinyint")
        out = rows.select(key.alias("k"), F.lit(0).alias("seq"), kind.alias("kind"), F.when(~deleted, F.col("v")).alias("v"), F.when(~deleted, expiry).alias("expire_at"))

        def apply(m: Manifest) -> None:
            self._add_segment(m, out.withColumn("ts", F.lit(m.last_ts)), once="pos" not in rows.columns)
            if token:
                m.tokens[token[0]] = token[1]

        return self._commit(apply)

    def _commit(self, change, attempts: int = 20) -> int:
        """Applies a change to the next version at the next timestamp; a lost race starts anew."""
        for _ in range(attempts):
            with self.lock:
                m = copy.deepcopy(self.manifest())
                m.version, m.last_ts = m.version + 1, m.last_ts + 1
                change(m)
                try:
                    self.log.commit(m)
                    return m.last_ts
                except CommitConflict:
                    continue
        raise CommitConflict(f"{attempts} attempts failed")

    def _write(self, df: DataFrame, path: str) -> None:
        columns = [c.split()[0] for c in self._schema.split(", ")]
        types = dict(c.split() for c in self._schema.split(", "))
        df = df.select(*[F.col(c).cast(types[c]).alias(c) for c in columns])
        if self.options.files_per_segment:
            df = df.repartitionByRange(self.options.files_per_segment, "k")
        df.sortWithinPartitions("k", F.desc("ts")).write.option("parquet.bloom.filter.enabled#k", "true").parquet(path)

    def _add_segment(self, m: Manifest, df: DataFrame, level: int = 0, once: bool = False) -> None:
        """once: a key may not occur twice, else the segment is taken back."""
        path = f"segments/{m.next_id:012d}-{uuid.uuid4().hex}"
        self._write(df, f"{self.root}/{path}")
        written = self.spark.read.schema(self._schema).parquet(f"{self.root}/{path}")
        if once and not (twice := written.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")).isEmpty():
            key = twice.first().k
            self.log.delete(path)
            raise ValueError(f"the key {key!r} occurs twice and pos does not tell which is the last")
        row = written.agg(
            F.count("*").alias("rows"), F.count_if(F.col("kind") == R.TOMBSTONE).alias("tombstones"), F.count("expire_at").alias("ttl_rows"),
            F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.min("k").alias("first_k"), F.max("k").alias("last_k"), F.max("expire_at").alias("max_expire"),
        ).first().asDict()
        if row["rows"]:
            row |= {n: _raw(row[n]).hex() for n in ("first_k", "last_k")}
            m.segments.append(Segment(id=m.next_id, path=path, level=level, **row))
        m.next_id += 1

    def _add_ranges(self, m: Manifest, df: DataFrame, n: int) -> None:
        path = f"rt/{m.next_id:012d}-{uuid.uuid4().hex}"
        df.withColumn("ts", F.lit(m.last_ts).cast("bigint")).select("start", "end", "ts", "ordinal").coalesce(1).write.parquet(f"{self.root}/{path}")
        m.rt.append(path)
        m.rt_rows += n
        m.next_id += 1

    # maintenance

    def compact(self, now: int | None = None) -> None:
        """Rewrites all segments as one, with what no reader can see left out."""
        with self.lock:
            before = self.manifest()
            mark, idle = self.watermark(), not self.readers
            filters = [compaction.PrefixFilter(f["id"], bytes.fromhex(f["prefix"]) if self.options.key_type == "binary" else bytes.fromhex(f["prefix"]).decode(), f["cutoff_ts"]) for f in before.filters]
            now = self.clock() if now is None else now

            def apply(m: Manifest) -> None:
                m.last_ts -= 1  # no new timestamp: the visible state is the same
                rt = self.range_tombstones(m)
                out = compaction.compact(self.change_log(m), rt, mark, True, idle, now, filters)
                m.segments = []
                self._add_segment(m, out, level=1)
                if rt is not None:
                    kept, m.rt, m.rt_rows = rt.where(F.col("ts") > mark), [], 0
                    n = kept.count()
                    if n:
                        path = f"rt/{m.next_id:012d}-{uuid.uuid4().hex}"
                        kept.coalesce(1).write.parquet(f"{self.root}/{path}")
                        m.rt, m.rt_rows, m.next_id = [path], n, m.next_id + 1

            self._commit(apply)

    def drop_expired_segments(self, now: int) -> int:
        """Takes segments out whose every row has expired, unread; only with no readers. Returns how many.

        A segment goes if no other holds an older version of its keys, which it would bring back.
        """
        with self.lock:
            if self.readers:
                return 0
            m = self.manifest()

            def alone(s: Segment) -> bool:
                return not any(o.id != s.id and o.first_k <= s.last_k and s.first_k <= o.last_k for o in m.segments)

            gone = {s.id for s in m.segments if s.rows == s.ttl_rows and s.max_expire is not None and s.max_expire <= now and alone(s)}
            if gone:

                def apply(m: Manifest) -> None:
                    m.last_ts -= 1
                    m.segments = [s for s in m.segments if s.id not in gone]

                self._commit(apply)
            return len(gone)

    def maintain(self, now: int | None = None) -> bool:
        """One round of upkeep: expired segments go, many segments become one."""
        self.drop_expired_segments(self.clock() if now is None else now)
        if len(self.manifest().segments) > self.options.segment_limit:
            self.compact(now)
            return True
        return False

    def vacuum(self) -> list[str]:
        """Deletes old manifests and what none of those left names; returns the paths."""
        with self.lock:
            self.log.prune(self.options.keep_versions)
            kept = [self.log.read(v) for v in self.log.versions()]
            named = {s.path for m in kept for s in m.segments} | {p for m in kept for p in m.rt}
            found = {f"{d}/{n}" for d in ("segments", "rt") for n in self.log.list(f"{self.root}/{d}")}
            gone = sorted(found - named)
            for path in gone:
                self.log.delete(f"{self.root}/{path}")
            return gone

    def add_compaction_filter(self, prefix: Key, cutoff_ts: int | None = None) -> int:
        """Versions of keys with the prefix up to the cutoff, by default all so far, go at compactions without readers."""
        if not prefix:
            raise ValueError("the prefix is empty")
        last = self.manifest().last_ts
        cutoff = last if cutoff_ts is None else cutoff_ts
        if cutoff > last:
            raise ValueError("the cutoff lies ahead")
        new = {"prefix": _raw(prefix).hex(), "cutoff_ts": cutoff}
        made: list[int] = []

        def apply(m: Manifest) -> None:
            m.last_ts -= 1
            if any(f["prefix"] == new["prefix"] and f["cutoff_ts"] == cutoff for f in m.filters):
                raise ValueError("the filter exists")
            made[:] = [m.next_id]
            m.filters.append(new | {"id": m.next_id})
            m.next_id += 1

        self._commit(apply)
        return made[0]

    def remove_compaction_filter(self, id_: int) -> bool:
        had = any(f["id"] == id_ for f in self.manifest().filters)
        if had:

            def apply(m: Manifest) -> None:
                m.last_ts -= 1
                m.filters = [f for f in m.filters if f["id"] != id_]

            self._commit(apply)
        return had

    def list_compaction_filters(self) -> list[dict]:
        return self.manifest().filters

    # statistics

    def segments(self) -> DataFrame:
        """The manifest's segments, without a read of data."""
        rows = [(s.id, s.path, s.level, s.rows, s.tombstones, s.ttl_rows, s.min_ts, s.max_ts, s.first_k, s.last_k) for s in self.manifest().segments]
        return local_rows(
            self.spark, rows, "id bigint, path string, level int, n_rows bigint, tombstones bigint, ttl_rows bigint, min_ts bigint, max_ts bigint, first_k string, last_k string"
        )

    def mvcc_gc_stats(self) -> DataFrame:
        return stats.segment_stats(self.change_log())

    def range_tombstone_stats(self) -> dict[str, int]:
        rt = self.range_tombstones()
        if rt is None:
            return {"tombstones": 0, "fragments": 0, "bytes": 0}
        row = stats.fragment_bytes(intervals.fragment(rt.select("start", "end", "ts"))).first()
        return {"tombstones": self.manifest().rt_rows, "fragments": row.fragments, "bytes": row.bytes}

    # transactions and asynchronous calls

    def begin(self):
        from palimpsest.txn import Transaction

        return Transaction(self)

    def submit(self, method: str, *args, **kwargs) -> Future:
        """Any method on a thread of its own; what it returns or raises is the future's."""
        if self._pool is None:
            self._pool = ThreadPoolExecutor(8)
        return self._pool.submit(getattr(self, method), *args, **kwargs)
