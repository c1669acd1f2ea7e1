import random

import pytest
from pyspark.sql import functions as F

from keyloom.plans.envelope import register_ordering
from keyloom.sources import store as store_module
from keyloom.sources.store import Conflict, StoreError, destroy, open_store
from keyloom.streaming.ingest import ingest


def items(df):
    return [(bytes(r["key"]), bytes(r["value"])) for r in df.collect()]


def bulk(spark, pairs):
    return spark.createDataFrame(pairs, "key binary, value binary")


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/store"


def test_put_get_delete_snapshot_reopen(spark, root):
    s = open_store(spark, root)
    s.put_all(bulk(spark, [(b"hello", b"world"), (b"foo", b"bar"), (b"a", b""), (b"a\x00", b"z")]))
    snap = s.snapshot()
    s.delete(b"hello")
    s.put(b"foo", b"v2")
    assert s.get(b"hello") is None and s.get(b"not_exist") is None and s.get(b"a") == b""
    assert s.get(b"foo") == b"v2" and s.get(b"foo", as_of=snap) == b"bar" and s.get(b"hello", as_of=snap) == b"world"
    assert s.scan(as_of=0).count() == 0
    again = open_store(spark, root, read_only=True)
    assert items(again.scan()) == [(b"a", b""), (b"a\x00", b"z"), (b"foo", b"v2")]
    assert items(again.scan(b"a\x00", b"g", limit=1)) == [(b"a\x00", b"z")]
    assert [k for k, _ in items(again.scan(reverse=True))] == [b"foo", b"a\x00", b"a"]
    for write in (lambda: again.put(b"x", b"y"), lambda: again.create_cf("n")):
        with pytest.raises(StoreError):
            write()
    with pytest.raises(Exception, match="empty key"):
        s.put(b"", b"x")
    got = s.multi_get(spark.createDataFrame([(0, bytearray(b"foo")), (1, bytearray(b"hello"))], "pos int, key binary")).orderBy("pos").collect()
    assert [r["status"] for r in got] == ["OK", "NotFound"]
    assert s.fsck() == [] and s.vacuum(0) == []
    destroy(spark, root)


def test_column_families(spark, root):
    s = open_store(spark, root, cfs=["extra"])
    s.put(b"shared_key", b"default_value")
    s.put(b"shared_key", b"extra_value", cf="extra")
    assert s.list_cfs() == ["default", "extra"]
    assert (s.get(b"shared_key"), s.get(b"shared_key", "extra")) == (b"default_value", b"extra_value")
    s.drop_cf("extra")
    s.create_cf("extra", ordering="reverse_bytewise")
    assert s.cfs["extra"]["id"] == 2 and s.get(b"shared_key", "extra") is None
    for bad in (lambda: s.drop_cf("default"), lambda: s.create_cf("extra"), lambda: s.create_cf("x", ordering="mine")):
        with pytest.raises(StoreError):
            bad()
    assert len(s.vacuum(0)) == 1


def test_transactions(spark, root):
    s = open_store(spark, root)
    with s.begin() as t:
        t.put(b"k1", b"a")
        t.put(b"k1", b"b")
        t.put(b"k2", b"c")
        t.delete(b"k2")
        assert t.get(b"k1") == b"b" and t.get(b"k2") is None
        assert items(t.scan()) == [(b"k1", b"b")]
    assert s.get(b"k1") == b"b" and s.get(b"k2") is None
    t = s.begin()
    t.put(b"k3", b"x")
    t.rollback()
    assert s.get(b"k3") is None
    a, b = s.begin(), open_store(spark, root).begin()
    a.put(b"k1", b"first")
    b.put(b"k1", b"second")
    a.commit()
    with pytest.raises(Conflict):
        b.commit()
    r, w = open_store(spark, root).begin("serializable"), open_store(spark, root).begin()
    assert r.get(b"k1") == b"first"
    r.put(b"other", b"1")
    w.put(b"k1", b"third")
    w.commit()
    with pytest.raises(Conflict):
        r.commit()


def test_against_a_model(spark, root):
    r, s = random.Random(2), open_store(spark, root)
    state, versions = {}, {}
    for _ in range(8):
        puts = [(f"key{r.randrange(12)}".encode(), str(r.random()).encode()) for _ in range(r.randint(1, 4))]
        puts = list(dict(puts).items())
        if r.random() < 0.3 and state:
            k = r.choice(sorted(state))
            del state[k]
            versions[s.delete(k)] = dict(state)
        else:
            state.update(puts)
            versions[s.put_all(bulk(spark, puts))] = dict(state)
    keep = sorted(versions)[4]
    for v, want in versions.items():
        assert items(s.scan(as_of=v)) == sorted(want.items())
    assert s.compact(oldest=keep)
    for v, want in versions.items():
        if v >= keep:
            assert items(s.scan(as_of=v)) == sorted(want.items())
    with pytest.raises(StoreError):
        s.scan(as_of=keep - 1)
    assert len(s.vacuum(0)) == 8 and s.fsck() == []
    sizes = s.approximate_sizes([(b"a", b"z"), (b"zz", b"zzz")]).orderBy("range_id").collect()
    assert sizes[0]["bytes"] > 0 and sizes[1]["bytes"] == 0


def test_uncommitted_files_are_invisible(spark, root):
    s = open_store(spark, root)
    s.put(b"k", b"v")
    s._write("default", s.changes().withColumn("seq", F.lit(99)).withColumn("value", F.lit(b"lost")))
    again = open_store(spark, root)
    assert again.get(b"k") == b"v" and len(again.vacuum(0)) == 1 and again.get(b"k") == b"v"


def test_stream_is_idempotent(spark, root, tmp_path):
    src = f"file://{tmp_path}/in"
    spark.createDataFrame([(bytearray(b"a"), 1, bytearray(b"1")), (bytearray(b"b"), 1, bytearray(b"2"))], "key binary, op int, value binary").write.parquet(src)
    for check in ("c1", "c2"):
        q = ingest(spark.readStream.schema("key binary, op int, value binary").parquet(src), root, f"file://{tmp_path}/{check}")
        q.awaitTermination(120)
    s = open_store(spark, root)
    assert items(s.scan()) == [(b"a", b"1"), (b"b", b"2")] and s.approximate_entries() == 2


def test_last_of_a_key_wins_and_footers_bound_files(spark, root):
    s = open_store(spark, root)
    s.put_all(bulk(spark, [(b"k", str(i).encode()) for i in range(50)]))
    assert s.get(b"k") == b"49"
    s.put_all(bulk(spark, [(f"{i:04d}".encode(), b"v") for i in range(400)]).repartition(4))
    parts = [p for f in s.files.values() for p in f["parts"]]
    assert sum(p["entries"] for p in parts) == 450 and all(p["min_key"] <= p["max_key"] for p in parts)
    assert len(s.changes(start=b"0000", end=b"0001").inputFiles()) < len(parts)
    assert s.property("num-entries") == 450 and s.property("num-files") == len(parts) and s.property("nonsense") is None


def test_orderings(spark, root):
    s = open_store(spark, root)
    s.create_cf("r", ordering="reverse_bytewise")
    s.create_cf("n", ordering="numeric32")
    s.create_cf("p", ordering="prefix", prefix=2)
    keys = [b"a", b"b", b"c", b"d"]
    s.put_all(bulk(spark, [(k, k) for k in keys]), "r")
    assert [k for k, _ in items(s.scan(b"c", b"a", cf="r"))] == [b"c", b"b"]
    assert [k for k, _ in items(s.scan(cf="r", reverse=True))] == keys and [k for k, _ in items(s.seek(b"bb", "r"))] == [b"b"]
    assert [k for k, _ in items(s.seek_for_prev(b"bb", "r"))] == [b"c"]
    nums = [1, 255, 256, 70000, 3_000_000_000]
    s.put_all(bulk(spark, [(n.to_bytes(4, "little"), b"x") for n in nums]), "n")
    got = lambda df: [int.from_bytes(k, "little") for k, _ in items(df)]
    le = lambda n: n.to_bytes(4, "little")
    assert got(s.scan(cf="n")) == nums and got(s.scan(cf="n", reverse=True)) == nums[::-1]
    assert got(s.scan(le(255), le(70000), cf="n")) == [255, 256] and got(s.seek(le(257), "n")) == [70000] and got(s.seek_for_prev(le(257), "n")) == [256]
    assert s.get(le(256), "n") == b"x"
    s.put_all(bulk(spark, [(b"ab1", b"1"), (b"ac1", b"2")]), "p")
    s.put(b"ab2", b"3", "p")
    assert items(s.scan(cf="p")) == [(b"ab2", b"3"), (b"ac1", b"2")] and s.get(b"abzz", "p") == b"3"
    s.delete(b"ab9", "p")
    assert s.get(b"ab1", "p") is None and s.compact("p") and items(s.scan(cf="p")) == [(b"ac1", b"2")]
    register_ordering("by_length", lambda k: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(k)), 8, "0")), k), lambda k: len(k).to_bytes(4, "big") + k)
    s.create_cf("l", ordering="by_length")
    s.put_all(bulk(spark, [(k, b"") for k in (b"bbb", b"z", b"aa")]), "l")
    assert [k for k, _ in items(s.scan(cf="l"))] == [b"z", b"aa", b"bbb"] and [k for k, _ in items(s.scan(b"zz", cf="l"))] == [b"bbb"]
    with pytest.raises(StoreError):
        s.create_cf("q", ordering="prefix")
    with pytest.raises(StoreError):
        s.update_options("r", ordering="bytewise")
    assert s.update_options("r", buffer=4) == {"buffer": 4} and open_store(spark, root).cfs["r"]["options"] == {"buffer": 4}
    assert s.fsck() == []


def test_conflict_survives_compaction_and_phantoms_are_seen(spark, root):
    s = open_store(spark, root)
    s.put(b"k", b"1")
    t = s.begin()
    t.put(b"k", b"2")
    other = open_store(spark, root)
    other.delete(b"k")
    other.compact()
    with pytest.raises(Conflict):
        t.commit()
    assert open_store(spark, root).get(b"k") is None
    t = open_store(spark, root).begin("serializable")
    assert items(t.scan(start=b"m", end=b"p")) == []
    t.put(b"z", b"1")
    other.put(b"n", b"phantom")
    with pytest.raises(Conflict):
        t.commit()
    t = open_store(spark, root).begin("serializable")
    t.scan(start=b"m", end=b"p")
    t.put(b"z", b"2")
    other.put(b"x", b"outside")
    t.commit()
    assert other.get(b"n") == b"phantom" and open_store(spark, root).get(b"z") == b"2"


def test_log_is_checkpointed_and_published_whole(spark, root, monkeypatch):
    monkeypatch.setattr(store_module, "CHECKPOINT", 3)
    s = open_store(spark, root, cfs=["extra"])
    for i in range(7):
        s.put(b"k%d" % i, b"v")
    s.drop_cf("extra")
    again = open_store(spark, root)
    assert (again.version, again.files, again.cfs, again.max_cf_id) == (s.version, s.files, s.cfs, s.max_cf_id)
    assert again.log.checkpoint()["version"] == 9 and len(again.log.entries(again.log.checkpoint()["version"])) == 1
    assert not s.log.append(4, {"version": 4, "actions": []}) and len(s.log.entries()) == 10
    again.log._write(".left", {"torn": 1})
    assert open_store(spark, root).version == 10 and again.repair(0) == {"removed": [], "damaged": []}
    assert not [n for n in s.log.children(f"{root}/_log") if n.startswith(".left")]


def test_compaction_of_a_range_and_pinned_snapshots(spark, root):
    s = open_store(spark, root)
    s.put_all(bulk(spark, [(b"a%d" % i, b"1") for i in range(9)]))
    s.put_all(bulk(spark, [(b"x%d" % i, b"1") for i in range(9)]))
    snap = s.snapshot()
    s.delete(b"a3")
    assert s.compact(start=b"a", end=b"b", target_rows=4) and s.get(b"a3") is None and s.get(b"a3", as_of=snap) == b"1"
    assert sum(f["level"] == 0 for f in s.files.values()) == 1 and s.property("num-files-at-level1") >= 3
    s.release(snap)
    assert s.compact() and s.property("num-deletions") == 0 and s.scan().count() == 17


def test_many_small_files(spark, root, monkeypatch):
    """Compaction into many files reads no footer on the driver, lists folders only and writes filters that fit."""
    s = open_store(spark, root)
    s.put_all(bulk(spark, [(b"%06d" % i, b"v") for i in range(2000)] + [(b"\xff%d" % i, b"w") for i in range(10)]))
    s.delete_all(spark.createDataFrame([(b"%06d" % i,) for i in range(0, 2000, 2)], "key binary"))
    before = items(s.scan())
    monkeypatch.setattr(store_module.Log, "_from_footers", lambda *_: pytest.fail("a footer was read"))
    assert s.compact(target_rows=10)
    monkeypatch.undo()
    (f,) = s.files.values()
    folder = f"{root}/{f['path']}"
    assert len(f["parts"]) > store_module.FOOTERS and sum(p["entries"] for p in f["parts"]) == f["entries"] == 1010
    assert f["parts"] == sorted(s.log._from_footers(folder), key=lambda p: p["name"]) == s.log.bounds(folder)
    assert s.log.fs.getContentSummary(s.log._path(folder)).getLength() < 20_000 * len(f["parts"])
    assert s._paths(s.files.values()) == [folder] and len(s.changes().inputFiles()) == len(f["parts"])
    assert 0 < len(s.changes(start=b"000100", end=b"000110").inputFiles()) < 5
    assert items(s.scan()) == before and s.get(b"000101") == b"v" and s.get(b"000100") is None and s.fsck() == []
