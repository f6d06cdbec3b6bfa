import random

import pytest

from palimpsest.model import KV_LOG, Options
from palimpsest.operators import compaction, lookup, resolve, stats
from palimpsest.operators.compaction import Run
from palimpsest.plans.chunk_store import ChunkStore, TargetChunk
from palimpsest.plans.table import KVTable
from palimpsest.sources import log, runs

SMALL = Options(max_l0_runs=2)


def rows(df):
    return [(bytes(r["key"]), bytes(r["value"])) for r in df.collect()]


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "t")


def test_crud_and_reopen(spark, path):
    t = KVTable(spark, path)
    t.insert(b"key", b"val1")
    assert t.get(b"key") == b"val1"
    t.delete(b"key")
    assert t.get(b"key") is None and not t.contains(b"key")
    t.insert(b"key", b"old")
    t.close()
    t = KVTable(spark, path)
    assert t.get(b"key") == b"old"
    t.insert(b"key", b"new")
    t.close()
    assert KVTable(spark, path).get(b"key") == b"new"


def test_crash_replay(spark, path):
    t = KVTable(spark, path)
    t.insert(b"a", b"1")
    t.delete(b"gone")
    t.insert(b"gone", b"x")
    t.delete(b"gone")
    t = KVTable(spark, path)  # no close
    assert t.get(b"a") == b"1" and t.get(b"gone") is None
    assert t.size_estimate() == 2 + 4 + 5 + 4


def test_damaged_pending_file_gives_its_valid_prefix():
    good = [(b"a", b"1", False, 1), (b"b", None, True, 2), (b"c", b"", False, 3)]

    class Mem:
        def create(self, name, data):
            self.data = data

    log.append_pending(m := Mem(), good)
    assert log.decode_pending(m.data) == good
    assert log.decode_pending(m.data[:-5]) == good[:2]
    bad = bytearray(m.data)
    bad[len(bad) // 2] ^= 255
    assert log.decode_pending(bytes(bad)) == good[:1]
    with pytest.raises(ValueError):
        log.decode_pending(bytes(bad), strict=True)


def test_empty_keys_write_nothing(spark, path):
    t = KVTable(spark, path)
    with pytest.raises(ValueError):
        t.insert_batch([(b"a", b"1"), (b"", b"2")])
    with pytest.raises(ValueError):
        t.delete(b"")
    assert t.get(b"a") is None and t.get(b"") is None
    t.insert_batch([])
    t.insert_batch([(b"a", b"1"), (b"a", b"2"), (b"e", b"")])
    assert t.get_batch([b"e", b"a", b"x", b"a"]) == [b"", b"2", None, b"2"]
    assert rows(t.scan()) == [(b"a", b"2"), (b"e", b"")] and rows(t.scan(skip_empty=True)) == [(b"a", b"2")]


def test_compaction_newest_wins(spark, path):
    t = KVTable(spark, path, SMALL)
    for batch in ([(b"a", b"1"), (b"b", b"2")], [(b"c", b"3"), (b"d", b"4")], [(b"c", b"100"), (b"d", b"1000")]):
        t.insert_batch(batch)
        t.force_flush()
    assert {k: len(v) for k, v in t.levels().items()} == {0: 1, 1: 1}
    assert t.get_batch([b"a", b"b", b"c", b"d"]) == [b"1", b"2", b"100", b"1000"]
    assert sorted(t.vacuum()) and rows(KVTable(spark, path, SMALL).scan())[2] == (b"c", b"100")


def test_snapshots_and_levels(spark, path):
    t = KVTable(spark, path)
    t.insert_batch([(b"a", b"old"), (b"b", b"old")])
    t.force_flush()
    before, version = t.scan(), t.version
    t.insert_batch([(b"a", b"new"), (b"c", b"new")])
    t.delete(b"b")
    assert rows(before) == [(b"a", b"old"), (b"b", b"old")]
    assert rows(t.scan()) == [(b"a", b"new"), (b"c", b"new")]
    t.force_flush()
    assert rows(t.scan(version=version)) == [(b"a", b"old"), (b"b", b"old")]
    assert t.get_batch([b"b"]) == [None] and rows(t.range(b"b", b"c")) == [(b"c", b"new")]


def test_compaction_of_deletes_alone(spark, path):
    t = KVTable(spark, path, SMALL)
    t.insert(b"a", b"1")
    t.force_flush()
    t.delete(b"a")
    t.force_flush()
    assert t.levels() == {} and rows(t.scan()) == []
    assert KVTable(spark, path).manifest().count() == 4


def test_deletes_stay_while_older_versions_exist_below():
    run = lambda i, level, lo, hi, s0, s1: Run(i, level, lo, hi, 10, 1, s0, s1)
    deep = run(1, 2, b"a", b"z", 1, 5)
    task = compaction.Task(0, (run(3, 0, b"a", b"c", 8, 9),), (run(2, 1, b"a", b"c", 6, 7),))
    assert not compaction.may_drop_deletes(task, [deep, *task.inputs])
    assert compaction.may_drop_deletes(task, [*task.inputs])
    assert not compaction.may_drop_deletes(task, [*task.inputs, run(4, 0, b"b", b"b", 2, 2)])  # late rows


def test_picker():
    run = lambda i, level, lo, hi, size=10: Run(i, level, lo, hi, size)
    o = Options(max_l0_runs=2, base_level_size=15, level_multiplier=10)
    zero = [run(4, 0, b"c", b"e"), run(5, 0, b"a", b"b")]
    one = [run(1, 1, b"a", b"d"), run(2, 1, b"f", b"g")]
    t = compaction.pick(zero + one, o)
    assert [r.id for r in t.sources] == [4, 5] and [r.id for r in t.targets] == [1]
    t = compaction.pick(zero[:1] + one, o)
    assert t.source_level == 1 and [r.id for r in t.sources] == [1] and t.targets == ()
    assert compaction.pick(one[:1], o) is None and compaction.pick([], o) is None


def test_runs_are_sorted_and_errors_surface(spark, path, tmp_path):
    t = KVTable(spark, path)
    t.insert_batch([(bytes([i]), b"v") for i in (0x80, 0x61, 0x7F, 1)] + [(b"ab", b"")])
    t.force_flush()
    keys = [bytes(r["key"]) for r in runs.read_runs(spark, path, ["runs/L0-1"]).collect()]
    assert keys == [b"\x01", b"a", b"ab", b"\x7f", b"\x80"]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"invalid_data")
    with pytest.raises(Exception):
        runs.read_runs(spark, str(tmp_path), ["bad"]).collect()


def test_bulk_append_and_read_only(spark, path):
    t = KVTable(spark, path)
    df = spark.createDataFrame([(bytearray(b"k"), bytearray(b"v"), False, 7), (bytearray(b"d"), None, True, 8)], KV_LOG)
    t.append(df)
    t.insert(b"k", b"w")
    assert t.get(b"k") == b"w" and t.seq == 9
    t.close()
    r = KVTable.open(spark, path, read_only=True)
    assert r.get(b"k") == b"w"
    with pytest.raises(PermissionError):
        r.insert(b"k", b"x")
    with pytest.raises(Exception, match="keys must not be empty"):
        t.append(spark.createDataFrame([(bytearray(b""), None, False, 10)], KV_LOG))


def test_second_writer_fails(spark, path):
    a, b = KVTable(spark, path), KVTable(spark, path)
    a.insert(b"x", b"1")
    a.force_flush()
    with pytest.raises(FileExistsError):
        b.append(spark.createDataFrame([(bytearray(b"x"), None, True, 99)], KV_LOG))


def test_merge_and_lookup_operators(spark):
    log_ = lambda *r: spark.createDataFrame([(bytearray(k), v and bytearray(v), v is None, s) for k, v, s in r], KV_LOG)
    newer, older = log_((b"a", b"new", 9), (b"b", None, 8)), log_((b"b", b"old", 2), (b"c", b"c", 1))
    merged = {bytes(r["key"]): r["value"] and bytes(r["value"]) for r in resolve.merge_runs([older, newer]).collect()}
    assert merged == {b"a": b"new", b"b": None, b"c": b"c"}
    seek = lambda k: [bytes(r["key"]) for r in lookup.seek(newer.unionByName(older), bytearray(k)).collect()]
    assert seek(b"a") == [b"a"] and seek(b"b") == [b"c"] and seek(b"z") == []


def test_block_packing_boundaries(spark):
    pack = lambda sizes, limit: [r["grp"] for r in stats.pack_blocks(spark.createDataFrame([(i, s + 17) for i, s in enumerate(sizes)], "i int, size int"), "i", limit).orderBy("i").collect()]
    assert pack([6, 6, 6], 54) == [0, 0, 1]  # 8 + 23 + 23 = 54 fits
    assert pack([62, 2], 20) == [0, 1]  # too large, alone
    roll = stats.memtable_rollover(spark.createDataFrame([(i, 4) for i in range(5)], "i int, size int"), "i", 8).orderBy("i").collect()
    assert [r["grp"] for r in roll] == [0, 0, 0, 1, 1]  # closes after the write beyond 8


def test_chunk_store(spark, path):
    s = ChunkStore(KVTable(spark, path))
    s.insert_multi([(b"k1", b"\x01\x02"), (b"k2", b"\x03")])
    assert s.get(b"k1") == b"\x01\x02" and s.get_multi([b"k2", b"k1"]) == [b"\x03", b"\x01\x02"]
    with pytest.raises(KeyError):
        s.get(b"k3")
    with pytest.raises(KeyError):
        s.get_multi([b"k1", b"k3"])
    with pytest.raises(ValueError):
        s.insert(b"k", TargetChunk((b"k1",)))
    assert not s.contains(b"k3")
    data = {1: bytes(10), 2: b"\x01" * (1 << 20) + b"\x02" * 4096, 3: b"\x01" * 9000, 4: random.Random(1).randbytes(100_000)}
    files = spark.createDataFrame([(i, bytearray(b)) for i, b in data.items()], "id long, data binary")
    for size in (4096, None):
        m = s.write_files(files, "id", "data", size)
        assert {r["file_id"]: bytes(r["bytes"]) for r in s.read_files(m).collect()} == data
        again = s.chunks().count()
        s.write_files(files, "id", "data", size)
        assert s.chunks().count() == again
    seg = s.read_segment(s.write_files(files.filter("id = 2"), "id", "data"), 255, 256).first()
    assert bytes(seg["bytes"]) == b"\x01" * 4096 + b"\x02" * 4096


def test_stream_is_idempotent(spark, path, tmp_path):
    from palimpsest.streaming.upsert import apply_batch, upsert_stream

    src = str(tmp_path / "in")
    df = spark.createDataFrame([(bytearray(b"%d" % (i % 5)), bytearray(b"v%d" % i), i % 7 == 0, i) for i in range(40)], KV_LOG)
    df.repartition(3).write.parquet(src)
    t = KVTable(spark, path)
    upsert_stream(spark.readStream.schema(KV_LOG).option("maxFilesPerTrigger", 1).parquet(src), t, "q", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert rows(t.scan()) == rows(resolve.scan(df).select("key", "value"))
    version = t.version
    assert not apply_batch(t, df, "q", 0) and t.version == version


def test_random_operations_against_a_dict(spark, path):
    rng, t, truth = random.Random(3), KVTable(spark, path, Options(max_l0_runs=2, base_level_size=40, level_multiplier=2)), {}
    for step in range(24):
        keys = [b"k%d" % rng.randrange(12) for _ in range(3)]
        if rng.random() < 0.6:
            pairs = [(k, b"v%d" % step) for k in keys]
            t.insert_batch(pairs)
            truth |= dict(pairs)
        else:
            t.delete_batch(keys)
            for k in keys:
                truth.pop(k, None)
        if rng.random() < 0.3:
            t.force_flush()
        if rng.random() < 0.15:
            t = KVTable(spark, path, t.options)
    assert rows(t.scan()) == sorted(truth.items())
    t.force_flush()
    assert rows(KVTable(spark, path).scan()) == sorted(truth.items())


def test_losing_writer_destroys_nothing(spark, path):
    a, b = KVTable(spark, path), KVTable(spark, path)
    one = lambda k, s: spark.createDataFrame([(bytearray(k), bytearray(b"v"), False, s)], KV_LOG)
    a.append(one(b"k", 1))
    with pytest.raises(FileExistsError):
        b.append(one(b"z", 99))
    c = KVTable(spark, path)
    assert rows(c.scan()) == rows(a.scan()) == [(b"k", b"v")]
    assert len(c.vacuum()) == 1 and c.vacuum() == [] and rows(c.scan()) == [(b"k", b"v")]
