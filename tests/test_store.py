"""The store against a plain model, and the semantics that its reads and compactions must keep."""

import random

import pytest

from palimpsest.cli import run as command
from palimpsest.store import Closed, Del, DelRange, Options, Put, PutWithTtl, VersionedStore
from palimpsest.txn import Conflict


@pytest.fixture
def store(spark, tmp_path):
    return VersionedStore.open(spark, str(tmp_path / "db"))


def rows(view):
    return [(r.k, r.v) for r in view.collect()]


class Model:
    def __init__(self):
        self.ts, self.log, self.rt = 0, [], []

    def write(self, batch, now=0):
        self.ts += 1
        for x in batch:
            if isinstance(x, DelRange):
                self.rt.append((x.start, x.end, self.ts))
        points = {x.key: x for x in batch if not isinstance(x, DelRange)}
        for k, x in points.items():
            self.log.append((k, self.ts, None if isinstance(x, Del) else x.value, now + x.ttl_seconds if isinstance(x, PutWithTtl) else None))

    def view(self, at, now):
        out = {}
        for k, ts, v, expiry in sorted(self.log, key=lambda r: r[1]):
            if ts <= at:
                covered = any(s <= k < e and ts <= t <= at for s, e, t in self.rt)
                out[k] = None if v is None or covered or (expiry is not None and now >= expiry) else v
        return sorted((k, v) for k, v in out.items() if v is not None)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_model(store, seed):
    rng, model = random.Random(seed), Model()
    keys = [f"k{i:02d}" for i in range(12)]
    for step in range(14):
        a, b = sorted(rng.sample(keys, 2))
        batch = rng.choice(
            [[DelRange(a, b)], [Del(a), Put(b, f"v{step}")], [Put(k, f"{k}{step}") for k in rng.sample(keys, 4)], [PutWithTtl(a, "t", rng.choice([0, 5, 50]))]]
        )
        assert store.write_batch(batch, now=0) == (model.write(batch, 0) or model.ts)
        if step in (6, 10):
            before = rows(store.scan(now=10))
            store.compact(now=10)
            assert rows(store.scan(now=10)) == before == model.view(model.ts, 10)
    assert rows(store.scan(now=10)) == model.view(model.ts, 10)
    again = VersionedStore.open(store.spark, store.root)
    asked = [*keys[::2], "absent", keys[0]]
    want = dict(model.view(model.ts, 10))
    assert again.batch_get(asked, now=10) == [want.get(k) for k in asked]
    assert [again.get(k, now=10) for k in keys[:2]] == [want.get(k) for k in keys[:2]]
    assert rows(again.scan(keys[2], keys[8], now=10)) == [(k, v) for k, v in model.view(model.ts, 10) if keys[2] <= k < keys[8]]


def test_batches_ttl_and_errors(store):
    assert store.write_batch([Put("a", "1"), Del("a"), Put("a", "2")]) == 1
    assert store.get("a") == "2"
    store.put_with_ttl("a", "3", 0.5, now=100)
    assert store.get("a", now=100) == "3" and store.get("a", now=101) is None  # the expired version hides the older ones
    assert store.get("a", read_ts=1, now=500) == "2"
    store.put("e", "")
    assert store.get("e", now=0) == ""
    with pytest.raises(ValueError):
        store.write_batch([Put("x", "1"), DelRange("a", "b")])
    with pytest.raises(ValueError):
        store.delete_range("b", "a")
    with pytest.raises(ValueError):
        store.put("k" * 70_000, "v")
    store.close()
    with pytest.raises(Closed):
        store.get("a")


def test_readers_keep_versions_and_filters_wait(store):
    store.write_batch([Put("old:drop", "1"), Put("live", "1")])
    with store.reader() as ts:
        store.put("live", "2")
        store.add_compaction_filter("old:")
        with pytest.raises(ValueError):
            store.add_compaction_filter("old:", 2)
        store.compact()
        assert rows(store.scan(read_ts=ts)) == [("live", "1"), ("old:drop", "1")]
    assert store.get("old:drop") == "1"  # filters act when data is rewritten, not before
    store.compact()
    assert rows(store.scan()) == [("live", "2")]
    (one,) = store.list_compaction_filters()
    assert store.remove_compaction_filter(one["id"]) and not store.remove_compaction_filter(one["id"])


def test_recovery_ignores_orphans_and_vacuum_deletes_them(store, tmp_path):
    store.options.keep_versions = 1
    store.put("a", "1")
    orphan = tmp_path / "db/segments/000000000099-9"
    orphan.mkdir()
    (tmp_path / "db/manifest/000000000002.7.tmp").write_text("{half")
    again = VersionedStore.open(store.spark, store.root, Options(keep_versions=1))
    assert rows(again.scan()) == [("a", "1")]
    assert again.vacuum() == ["segments/000000000099-9"] and not orphan.exists()


def test_two_writers_never_share_a_timestamp(store):
    other = VersionedStore.open(store.spark, store.root)
    jobs = [s.submit("put", f"k{i}", str(i)) for i, s in enumerate([store, other] * 3)]
    assert sorted(j.result() for j in jobs) == [1, 2, 3, 4, 5, 6]
    assert store.count() == 6 and store.count(limit=4) == 4


def test_expired_segments_go_unread(store):
    store.put_with_ttl("a", "1", 5, now=0)
    store.put("b", "2")
    assert store.drop_expired_segments(now=4) == 0 and store.drop_expired_segments(now=5) == 1
    assert rows(store.scan(now=5)) == [("b", "2")] and store.segments().count() == 1


def test_snapshot_isolation(store):
    store.write_batch([Put("a", "1"), Put("b", "1")])
    one, two = store.begin(), store.begin()
    one.put("a", "2")
    two.put("a", "3")
    two.delete("b")
    assert one.get("a") == "2" and one.get("b") == "1" and two.get("b") is None
    assert rows(two.scan()) == [("a", "3")] and rows(one.prefix_scan("b")) == [("b", "1")]
    one.commit()
    assert two.get("b") is None
    two.commit()  # the last to commit wins
    assert rows(store.scan()) == [("a", "3")]
    with pytest.raises(RuntimeError):
        two.put("a", "4")
    assert not store.readers


def test_serializable(spark, tmp_path):
    store = VersionedStore.open(spark, str(tmp_path / "s"), Options(serializable=True))
    store.put("k1", "a")
    one, two, blind, reader = (store.begin() for _ in range(4))
    one.get("k1"), one.put("k2", "x")
    two.get("k2"), two.put("k1", "y")
    blind.put("k1", "z")
    reader.get("k1")
    with pytest.raises(ValueError):
        one.scan()
    one.commit()
    with pytest.raises(Conflict):
        two.commit()
    blind.commit()
    assert reader.commit() is None
    with pytest.raises(ValueError):
        store.delete_range("a", "b")


def test_binary_keys(spark, tmp_path):
    store = VersionedStore.open(spark, str(tmp_path / "b"), Options(key_type="binary", value_type="binary"))
    keys = [b"", b"\x00", b"\x7f", b"\x80", b"\xff", b"\xff\xff"]
    store.write_batch([Put(k, k + b"!") for k in reversed(keys)])
    assert [bytes(k) for k, _ in rows(store.scan())] == keys
    assert [bytes(k) for k, _ in rows(store.prefix_scan(b"\xff"))] == [b"\xff", b"\xff\xff"]
    assert [bytes(k) for k, _ in rows(store.scan(b"\x7f", b"\xff"))] == [b"\x7f", b"\x80"]


def test_stream_ingest_is_idempotent(spark, store, tmp_path):
    from palimpsest.streaming.ingest import ingest, latest, live

    src = str(tmp_path / "src")
    spark.createDataFrame([("a", "1", 0, "put"), ("b", "1", 1, "put"), ("a", "2", 2, "put"), ("b", None, 3, "del")], "k string, v string, pos int, op string").coalesce(
        1
    ).write.json(src)
    stream = spark.readStream.schema("k string, v string, pos int, op string").json(src)
    query = ingest(stream, store, str(tmp_path / "cp"), "q")
    query.awaitTermination(60)
    assert query.exception() is None and rows(store.scan()) == [("a", "2")]
    last = store.manifest().last_ts
    assert store.ingest(spark.createDataFrame([("z", "9")], "k string, v string"), token=("q", 0)) == last
    assert store.get("z") is None
    versions = spark.createDataFrame([("a", 1, 0, "x", None), ("a", 2, 2, None, None), ("b", 3, 0, "y", 9)], "k string, ts long, kind int, v string, expire_at long")
    assert [r.k for r in live(latest(versions), 8).collect()] == ["b"] and live(latest(versions), 9).isEmpty()


def test_command_line(store):
    assert command(store, "fill 1 3") == "committed at 1"
    assert command(store, "scan 1 2") == "1=value1\n2=value2"
    command(store, "delrange 1 2")
    assert command(store, "get 1") == "absent" and command(store, "prefix 3") == "3=value3"
    command(store, "full_compaction")
    assert "'tombstones': 0" in command(store, "rt_stats") and command(store, "what").startswith("fill")
    assert command(store, "quit") is None


def test_ingest_refuses_what_it_cannot_store(spark, tmp_path):
    store = VersionedStore.open(spark, str(tmp_path / "s"))
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v string, op string")
    store.ingest(rows(("a", "1", None), ("b", "2", "put"), ("c", None, "del")))
    assert [store.get(k) for k in "abc"] == ["1", "2", None]
    for bad in (rows(("d", "1", "upsert")), rows(("d", "1", "put"), ("d", "2", "put")), rows((None, "1", "put")), rows(("x" * 70_000, "1", "put"))):
        with pytest.raises(Exception, match="no such operation|occurs twice|null or too long"):
            store.ingest(bad)
    assert store.count() == 2 and len(store.manifest().segments) == 1


def test_serializable_sees_bulk_writes_and_range_deletions(spark, tmp_path):
    root = str(tmp_path / "s")
    store = VersionedStore.open(spark, root, Options(serializable=True))
    store.write_batch([Put("a", "1"), Put("b", "1")])
    other = VersionedStore.open(spark, root)
    for write in (lambda: store.ingest(spark.createDataFrame([("a", "2")], "k string, v string")), lambda: other.delete_range("a", "b"), lambda: other.put("a", "3")):
        txn = store.begin()
        txn.get("a")
        txn.put("z", "1")
        write()
        with pytest.raises(Conflict):
            txn.commit()
    txn = store.begin()
    txn.get("a")
    txn.put("z", "1")
    other.put("b", "2")
    txn.commit()
    assert store.get("z") == "1"


def test_compare_and_set(spark, tmp_path):
    store = VersionedStore.open(spark, str(tmp_path / "s"))
    ts = store.write_batch([Put("a", "1"), Put("b", "1")])
    assert store.compare_and_set("a", "1", "2") and not store.compare_and_set("a", "1", "3") and store.compare_and_set("c", None, "1")
    assert store.compare_and_set_batch([("a", "2", None), ("b", "x", "y"), ("b", "1", "5")]) == [True, False, True]
    assert [store.get(k) for k in "abc"] == [None, "5", "1"]
    now = store.manifest().last_ts
    assert not store.compare_and_set("b", "5", "6", at=ts) and store.compare_and_set("b", "5", "6", at=now) and store.compare_and_set_batch([]) == []
