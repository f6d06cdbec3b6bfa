import random

import numpy as np
import pytest

from palimpsest.model import KV_LOG, Options
from palimpsest.operators import chunks
from palimpsest.plans.chunk_store import ChunkStore
from palimpsest.plans.table import KVTable
from palimpsest.sources import files, log, runs


def plain_cuts(data, least=1024, mean_bits=12, most=16384):
    """Byte by byte: a rolling sum of shifted gears over 32 bytes; the first mark at or beyond the least length ends a chunk."""
    gear = [int(g) for g in np.random.default_rng(1).integers(0, 1 << 63, 256, dtype=np.uint64)]
    out, start, window = [], 0, []
    for i, byte in enumerate(data):
        window = [*window[-31:], gear[byte]]
        h = sum(g << (len(window) - 1 - k) for k, g in enumerate(window)) & ((1 << 64) - 1)
        marked = (h >> 31) & ((1 << mean_bits) - 1) == 0
        if (marked and i + 1 - start >= least) or i + 1 - start == most:
            out.append(i + 1)
            start = i + 1
    return out + [len(data)] * (start < len(data))


@pytest.mark.parametrize("n", [0, 1, 31, 1024, 5000, 60_000])
def test_content_defined_cuts(n):
    data = random.Random(n).randbytes(n)
    assert chunks.cut_points(data) == plain_cuts(data)
    assert chunks.cut_points(bytes(n)) == plain_cuts(bytes(n))


def test_content_defined_chunks_and_pieces(spark):
    rng = random.Random(2)
    base = rng.randbytes(80_000)
    data = {1: base, 2: base[:30_000] + b"inserted" + base[30_000:], 3: b"", 4: b"x"}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "id long, data binary")
    cut = chunks.content_defined(df, "id", "data").cache()
    got = {}
    for r in cut.orderBy("file_id", "chunk_no").collect():
        got[r["file_id"]] = got.get(r["file_id"], b"") + bytes(r["bytes"])
    assert got == {k: v for k, v in data.items() if v}
    assert chunks.dedup(cut).count() < cut.count() - 5
    whole = {}
    for r in chunks.pieces(chunks.file_map(cut), chunks.dedup(cut), 3).orderBy("file_id", "piece").collect():
        assert len(r["bytes"]) <= 3 * 16384
        whole[r["file_id"]] = whole.get(r["file_id"], b"") + bytes(r["bytes"])
    assert whole == got


def scanned(df):
    """Rows that the scan of df's plan gave out."""
    df.collect()
    plan, n = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") and plan.getClass().getSimpleName().startswith("Adaptive") else plan]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "FileSourceScanExec":
            n += p.metrics().get("numOutputRows").get().value()
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return n


def test_bloom_filter_spares_reads(spark, tmp_path):
    """An absent key between the least and the greatest: with the filter no row is read, without it whole pages are."""
    df = spark.range(20_000).selectExpr("cast(concat('k', id * 2) as binary) as key", "cast('v' as binary) as value", "false as deleted", "id as seq")
    rows = {}
    for fpp in (0.001, 0.0):
        f = files.Files(spark, str(tmp_path / f"t{fpp}"))
        run = runs.write_run(f, df, "runs/L0-1", Options(bloom_fpp=fpp), 1, 0, 2)
        assert run.n_rows == 20_000 and run.size_bytes == f.size("runs/L0-1") > 0 and run.entry_bytes == df.selectExpr("sum(octet_length(key) + 1)").first()[0]
        read = runs.read_runs(spark, f.base, ["runs/L0-1"])
        rows[fpp] = sum(scanned(read.filter(read.key == bytearray(b"k%d" % k))) for k in (1, 777, 20_001))
        assert read.filter(read.key == bytearray(b"k778")).count() == 1
    assert rows[0.001] == 0 and rows[0.0] > 1000


def test_snapshots_of_the_log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log, "SNAPSHOT", 4)
    t = KVTable(spark, str(tmp_path / "t"), Options(auto_compact=False))
    one = lambda k: spark.createDataFrame([(bytearray(b"k%d" % k), bytearray(b"v"), False, k)], KV_LOG)
    for k in range(1, 10):
        t.append(one(k), query="q", batch=k)
    read = []
    monkeypatch.setattr(files.Files, "read", lambda self, name, f=files.Files.read: read.append(name) or f(self, name))
    again = KVTable(spark, str(tmp_path / "t"))
    assert [n.rpartition(".")[2] for n in read] == ["snapshot", "json"] and again.state == t.state
    assert again.state.batches == {"q": 9} and again.state.next_run == 10
    for version in (0, 3, 4, 5, 9):
        assert log.load(t.files, version).version == version and again.scan(version=version).count() == version
    del read[:]
    t.append(one(10))
    again.refresh()
    assert [n for n in read if n.startswith("_log")] == ["_log/00000000000000000010.json"] and again.scan().count() == 10
    t.files.delete("_log/00000000000000000010.json")
    t.append(one(11))
    with pytest.raises(ValueError):
        KVTable(spark, str(tmp_path / "t"))


def test_store_in_use(spark, tmp_path):
    t = KVTable(spark, str(tmp_path / "t"))
    one, two = ChunkStore(t), ChunkStore(t)
    one.insert(b"k", b"v")
    with pytest.raises(RuntimeError):
        one.close()
    del two
    one.close()
    assert ChunkStore(KVTable(spark, str(tmp_path / "t"))).get(b"k") == b"v"


def test_shared_folder_on_a_cluster():
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        files.shared_dir(Session())
