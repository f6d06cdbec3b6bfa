"""The engine's queries over the driver's tables, each with SQL that gives the same rows.

`kv` is a log derived from orders: key o_custkey, seq o_orderkey, a delete where the status is F, and an
empty value for every tenth order; `tier` deals it into 20 runs: 0-7 are level 2, 8-13 level 1, 14-17
level 0, 18 and 19 not yet flushed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import live_value
from ..model import Options
from ..operators import chunks, compaction, lookup, resolve, stats
from ..sources.files import workspace
from ..streaming.upsert import upsert_stream
from .chunk_store import ChunkStore
from .table import KVTable

KV = {"key": "k", "seq": "seq", "deleted": "del"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    n = orders.agg((F.coalesce(F.max("o_orderkey"), F.lit(0)) + 1).alias("n"))  # one row
    dead = F.col("o_orderstatus") == "F"
    value = live_value(F.when(F.col("o_orderkey") % 10 == 0, F.lit("")).otherwise(F.col("o_orderpriority")), dead)
    rows = orders.crossJoin(F.broadcast(n))
    return rows.select(F.col("o_custkey").cast("string").alias("k"), F.col("o_orderkey").alias("seq"), dead.alias("del"), value.alias("v"), F.expr("cast((o_orderkey * 20) div n as int)").alias("tier"))


def live(df: DataFrame) -> DataFrame:
    return resolve.resolve(df, **KV).select("k", "v", "seq")


def probe(spark: SparkSession, keys: list[str]) -> DataFrame:
    return spark.createDataFrame([*enumerate(keys)], "pos int, k string")


_CTE = """WITH n AS (SELECT max(o_orderkey) + 1 AS n FROM orders),
kv AS (SELECT CAST(o_custkey AS varchar) AS k, o_orderkey AS seq, o_orderstatus = 'F' AS del,
  CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderkey % 10 = 0 THEN '' ELSE o_orderpriority END AS v,
  CAST((o_orderkey * 20) // n AS int) AS tier FROM orders, n)"""


def _r(src: str = "kv", where: str = "true") -> str:
    return f"(SELECT k, v, seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM {src} WHERE {where}) WHERE rn = 1 AND NOT del)"


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, cte: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = (f"{_CTE} " if cte else "") + sql
        return f

    return add


@query(f"SELECT * FROM {_r()}")
def kv_live(spark, d):
    return live(kv(spark, d))


@query(f"SELECT * FROM {_r(where='tier < 14')}")
def kv_snapshot_asof(spark, d):
    return live(kv(spark, d).filter("tier < 14"))


@query(f"SELECT * FROM {_r(where='seq <= (SELECT max(seq) // 2 FROM kv)')}")
def kv_snapshot_seq(spark, d):
    df = kv(spark, d)
    half = df.crossJoin(F.broadcast(df.agg(F.expr("max(seq) div 2").alias("half"))))
    return resolve.snapshot(half, F.col("half"), **KV).select("k", "v", "seq")


@query(f"SELECT k, v FROM {_r()} WHERE length(v) > 0")
def kv_scan_nonempty(spark, d):
    return resolve.scan(kv(spark, d), **KV, skip_empty="v").select("k", "v")


@query("SELECT k, v, del, seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM kv WHERE tier BETWEEN 14 AND 17) WHERE rn = 1")
def kv_merge_runs_keep_tombstones(spark, d):
    runs = [kv(spark, d).filter(F.col("tier") == t).select("k", "v", "del", "seq") for t in range(14, 18)]
    return resolve.merge_runs(runs, "k", "seq")


def _get(key):
    return f"SELECT * FROM {_r()} WHERE k = '{key}'"


@query(_get("7"))
def kv_get(spark, d):
    return lookup.get(kv(spark, d), "7", **KV).select("k", "v", "seq")


@query(_get("1006"))
def kv_get_deleted(spark, d):
    return lookup.get(kv(spark, d), "1006", **KV).select("k", "v", "seq")


@query(_get("nope"))
def kv_get_missing(spark, d):
    return lookup.get(kv(spark, d), "nope", **KV).select("k", "v", "seq")


@query(_get("1004"))
def kv_get_empty(spark, d):
    return lookup.get(kv(spark, d), "1004", **KV).select("k", "v", "seq")


@query(f"SELECT p.pos, p.k, r.v FROM (VALUES (0, '7'), (1, 'nope'), (2, '13'), (3, '7'), (4, '100'), (5, '1004')) p(pos, k) LEFT JOIN {_r()} r ON p.k = r.k")
def kv_get_batch(spark, d):
    return lookup.get_batch(kv(spark, d), probe(spark, ["7", "nope", "13", "7", "100", "1004"]), **KV).select("pos", "k", "v")


@query(f"SELECT p.k, r.k IS NOT NULL AS present FROM (VALUES ('7'), ('nope'), ('13')) p(k) LEFT JOIN {_r()} r ON p.k = r.k")
def kv_contains_batch(spark, d):
    return lookup.contains_batch(kv(spark, d), probe(spark, ["7", "nope", "13"]), **KV).select("k", "present")


_PROBES = "(SELECT k FROM kv UNION SELECT CAST(c_custkey AS varchar) FROM customer)"


def _probes(spark, d) -> DataFrame:
    """Every key of the log and of customer: customers without orders are absent."""
    return kv(spark, d).select("k").union(table(spark, d, "customer").select(F.col("c_custkey").cast("string"))).distinct()


@query(f"SELECT k FROM {_PROBES} p WHERE NOT EXISTS (SELECT 1 FROM {_r()} r WHERE r.k = p.k)")
def kv_probe_miss(spark, d):
    df = kv(spark, d)
    return lookup.absent(df, _probes(spark, d), **KV)


@query(f"SELECT k FROM {_PROBES} p WHERE EXISTS (SELECT 1 FROM {_r()} r WHERE r.k = p.k)")
def kv_probe_semi(spark, d):
    df = kv(spark, d)
    return lookup.present(df, _probes(spark, d), **KV)


@query(f"SELECT * FROM {_r()} WHERE k >= '55' ORDER BY k LIMIT 1")
def kv_seek(spark, d):
    return lookup.seek(kv(spark, d), "55", **KV).select("k", "v", "seq")


@query(f"SELECT * FROM {_r()} WHERE k BETWEEN '2' AND '3'")
def kv_range_scan(spark, d):
    return lookup.range_scan(kv(spark, d), "2", "3", **KV).select("k", "v", "seq")


@query(f""", src AS (SELECT k, seq, del, v FROM kv UNION ALL SELECT DISTINCT k, CAST(1000000000 AS bigint), true, CAST(NULL AS varchar) FROM kv WHERE CAST(k AS int) % 7 = 0) SELECT * FROM {_r('src')}""")
def kv_delete_batch(spark, d):
    df = kv(spark, d).drop("tier")
    gone = df.filter(F.col("k").cast("int") % 7 == 0).select("k").distinct()
    return live(df.unionByName(gone.select("k", F.lit(1_000_000_000).cast("long").alias("seq"), F.lit(True).alias("del"), F.lit(None).cast("string").alias("v"))))


_BATCH = [("7", "x"), ("new", "y"), ("7", "z"), ("1006", "back")]


@query(f""", src AS (SELECT k, seq, del, v FROM kv UNION ALL SELECT * FROM (VALUES {", ".join(f"('{k}', CAST({1_000_000_000 + i} AS bigint), false, '{v}')" for i, (k, v) in enumerate(_BATCH))}) b(k, seq, del, v)) SELECT * FROM {_r('src')}""")
def kv_insert_batch(spark, d):
    rows = [(k, 1_000_000_000 + i, False, v) for i, (k, v) in enumerate(_BATCH)]
    return live(kv(spark, d).drop("tier").unionByName(spark.createDataFrame(rows, "k string, seq long, del boolean, v string")))


@query("""SELECT tier, min(k) AS first_key, max(k) AS last_key, count(*) AS n_rows, CAST(sum(CASE WHEN del THEN 1 ELSE 0 END) AS bigint) AS n_deletes,
CAST(sum(strlen(k) + coalesce(strlen(v), 0)) AS bigint) AS n_bytes FROM kv GROUP BY tier""")
def kv_run_meta(spark, d):
    return stats.run_meta(kv(spark, d), "tier", "k", "v", "del")


@query(""", m AS (SELECT tier, min(k) AS lo, max(k) AS hi FROM kv WHERE tier < 18 GROUP BY tier),
src AS (SELECT min(lo) AS lo, max(hi) AS hi FROM m WHERE tier >= 14)
SELECT m.tier FROM m, src WHERE m.tier BETWEEN 8 AND 13 AND m.hi >= src.lo AND m.lo <= src.hi""")
def kv_run_overlap(spark, d):
    meta = stats.run_meta(kv(spark, d), "tier", "k", "v", "del").collect()  # one row a run
    runs = [compaction.Run(r["tier"], 0 if r["tier"] >= 14 else 1 if r["tier"] >= 8 else 2, r["first_key"].encode(), r["last_key"].encode(), r["n_bytes"]) for r in meta if r["tier"] < 18]
    task = compaction.pick(runs, Options(max_l0_runs=1))
    return spark.createDataFrame([(r.id,) for r in (task.targets if task else ())], "tier int")


@query("""SELECT lvl, CAST(sum(sz) AS bigint) AS n_bytes, sum(sz) > 1000 * pow(10, lvl - 1) AS over_target
FROM (SELECT CASE WHEN tier < 8 THEN 2 WHEN tier < 14 THEN 1 ELSE 0 END AS lvl, strlen(k) + coalesce(strlen(v), 0) AS sz FROM kv) WHERE lvl > 0 GROUP BY lvl""")
def kv_level_sizes(spark, d):
    df = kv(spark, d).withColumn("lvl", F.when(F.col("tier") < 8, 2).when(F.col("tier") < 14, 1).otherwise(0))
    return stats.level_sizes(df, "lvl", _size(), 1000, 10)


def _size():
    return (F.octet_length("k") + F.coalesce(F.octet_length("v"), F.lit(0))).cast("long")


@query("SELECT seq, CAST(sum(strlen(k) + coalesce(strlen(v), 0)) OVER (ORDER BY seq) AS bigint) AS estimate FROM kv")
def kv_size_estimate(spark, d):
    return stats.size_estimate(kv(spark, d), "seq", _size(), F.col("tier"))


_FOLD = """{cte}, x AS (SELECT row_number() OVER (ORDER BY {order}) AS i, {order} AS o, strlen(k) + coalesce(strlen(v), 0) + {extra} AS sz FROM {src}),
f AS (SELECT i, o, sz, sz + {header} AS cur, CAST(0 AS bigint) AS g FROM x WHERE i = 1
UNION ALL SELECT x.i, x.o, x.sz, CASE WHEN {full} THEN x.sz + {header} ELSE f.cur + x.sz END, CASE WHEN {full} THEN f.g + 1 ELSE f.g END FROM f JOIN x ON x.i = f.i + 1)
SELECT g AS grp, count(*) AS n_rows, CAST(sum(sz) AS bigint) AS n_bytes, min(o) AS lo, max(o) AS hi FROM f GROUP BY g"""
_REC = _CTE.replace("WITH", "WITH RECURSIVE", 1)


def _groups(df: DataFrame, order: str) -> DataFrame:
    return df.groupBy("grp").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes"), F.min(order).alias("lo"), F.max(order).alias("hi"))


@query(_FOLD.format(cte=_REC, order="seq", extra=0, src="kv", header=0, full="f.cur > 8192"), cte=False)
def kv_memtable_rollover(spark, d):
    return _groups(stats.memtable_rollover(kv(spark, d).select("seq", _size().alias("size")), "seq", 8192), "seq")


def _packed(spark, d) -> DataFrame:
    sizes = live(kv(spark, d)).select("k", (_size() + stats.ENTRY_HEADER).alias("size"))
    return stats.pack_blocks(sizes, "k", 4096)


_BLOCKS = _FOLD.format(cte=_REC, order="k", extra=17, src=_r(), header=8, full="f.cur + x.sz > 4096")


@query(_BLOCKS, cte=False)
def kv_block_packing(spark, d):
    return _groups(_packed(spark, d), "k")


@query(_BLOCKS.replace("SELECT g AS grp, count(*) AS n_rows, CAST(sum(sz) AS bigint) AS n_bytes, min(o) AS lo, max(o) AS hi", "SELECT g AS grp, min(o) AS first_key, max(o) AS last_key, count(*) AS n_rows"), cte=False)
def kv_block_index(spark, d):
    return stats.block_index(_packed(spark, d), ["grp"], "k")


@query(_BLOCKS.replace("SELECT g AS grp, count(*) AS n_rows, CAST(sum(sz) AS bigint) AS n_bytes, min(o) AS lo, max(o) AS hi FROM f GROUP BY g", f", b AS (SELECT min(o) AS first_key FROM f GROUP BY g) SELECT p.k, max(first_key) AS first_key FROM {_PROBES} p JOIN b ON first_key <= p.k GROUP BY p.k"), cte=False)
def kv_sparse_index_lookup(spark, d):
    """For every probe, the block of the packed live run that may hold it; none before the first block."""
    return lookup.block_of(stats.block_index(_packed(spark, d), ["grp"], "k"), _probes(spark, d), "k", "first_key")


@query("SELECT k, v, del, seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM kv WHERE tier BETWEEN 8 AND 17) WHERE rn = 1")
def kv_compact_l0_l1(spark, d):
    df = kv(spark, d)
    return compaction.compact([df.filter("tier between 14 and 17"), df.filter("tier between 8 and 13")], False, **KV).drop("tier")


@query(f"SELECT * FROM {_r()}")
def kv_compact_last_level(spark, d):
    df = kv(spark, d)
    return compaction.compact([df.filter("tier >= 8"), df.filter("tier < 8")], True, **KV).select("k", "v", "seq")


@query(f"SELECT * FROM {_r()}")
def kv_compaction_equivalence(spark, d):
    df = kv(spark, d)
    one = compaction.compact([df.filter("tier between 14 and 17"), df.filter("tier between 8 and 13")], False, **KV)
    two = compaction.compact([one, df.filter("tier < 8")], True, **KV)
    return live(two.unionByName(df.filter("tier >= 18")))


@query("SELECT CAST(count(*) AS bigint) AS versions, count(DISTINCT k) AS n_keys, count(*) - count(DISTINCT k) AS shadowed FROM kv")
def kv_version_stats(spark, d):
    return resolve.version_stats(kv(spark, d), "k")


_MANIFEST = [(1, "add", 1, 0), (2, "add", 2, 0), (3, "remove", 1, 0), (3, "remove", 2, 0), (3, "add", 3, 1), (4, "add", 4, 0), (5, "add", 5, 0), (6, "remove", 3, 1), (6, "add", 6, 2)]
_MANIFEST_SQL = "(VALUES " + ", ".join(f"(CAST({v} AS bigint), '{a}', CAST({i} AS bigint), {lv})" for v, a, i, lv in _MANIFEST) + ") m(version, action, id, level)"


def _manifest(spark) -> DataFrame:
    return spark.createDataFrame(_MANIFEST, "version long, action string, id long, level int")


@query(f"SELECT a.level, a.id FROM (SELECT * FROM {_MANIFEST_SQL} WHERE action = 'add') a WHERE NOT EXISTS (SELECT 1 FROM {_MANIFEST_SQL} WHERE action = 'remove' AND m.id = a.id AND m.version >= a.version)", cte=False)
def kv_manifest_fold(spark, d):
    return stats.manifest_fold(_manifest(spark))


@query(f"SELECT max(id) + 1 AS next_id FROM {_MANIFEST_SQL}", cte=False)
def kv_next_id(spark, d):
    return stats.next_id(_manifest(spark), "id")


@query("SELECT k, seq FROM kv WHERE seq < coalesce((SELECT min(seq) FROM kv WHERE seq % 7 = 3 AND seq > (SELECT max(seq) * 2 // 3 FROM kv)), 9223372036854775807)")
def kv_wal_valid_prefix(spark, d):
    df = kv(spark, d)
    marked = df.crossJoin(F.broadcast(df.agg(F.expr("max(seq) * 2 div 3").alias("late"))))
    return stats.valid_prefix(marked, (F.col("seq") % 7 == 3) & (F.col("seq") > F.col("late"))).select("k", "seq")


@query("SELECT DISTINCT tier AS wal_id FROM kv WHERE tier NOT IN (SELECT tier FROM kv WHERE tier < 18)")
def kv_wal_recovery_antijoin(spark, d):
    ids = kv(spark, d).select(F.col("tier").alias("wal_id")).distinct()
    return ids.join(ids.filter("wal_id < 18"), "wal_id", "left_anti")


_EVENTS = "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'"


def _events(spark, d) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_id", "event_type", (F.col("event_type") == "error").alias("del"))


@query(_EVENTS, cte=False)
def ev_latest_by_user(spark, d):
    return resolve.resolve(_events(spark, d), "user_id", "event_id", "del").select("user_id", "event_id", "event_type")


@query(_EVENTS, cte=False)
def ev_stream_upsert(spark, d):
    """The same through a stream: micro-batches go to a table in the shared folder, which is then read."""
    base = workspace(spark, "stream")
    source = spark.read.parquet(f"{d}/events.parquet")
    events = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    rows = events.select(F.col("user_id").cast("string").cast("binary").alias("key"), F.col("event_type").cast("binary").alias("value"), (F.col("event_type") == "error").alias("deleted"), F.col("event_id").alias("seq"))
    t = KVTable(spark, f"{base}/table")
    upsert_stream(rows, t, "events", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = resolve.resolve(t.log())
    return out.select(F.col("key").cast("string").cast("long").alias("user_id"), F.col("seq").alias("event_id"), F.col("value").cast("string").alias("event_type"))


@query("SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC) AS rn FROM lineitem) WHERE rn = 1", cte=False)
def li_latest_line(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_returnflag")
    return resolve.latest(lines, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey"])


_CHUNKS = """WITH raw AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE strlen(text) > 0),
c AS (SELECT doc_id AS file_id, CAST(i AS int) AS chunk_no, substr(h, 1 + 8192 * i, 8192) AS p FROM (SELECT doc_id, h, unnest(range(0, (length(h) + 8191) // 8192)) AS i FROM raw)),
chunks AS (SELECT file_id, chunk_no, sha256(from_hex(p)) AS hash, CAST(length(p) // 2 AS int) AS n_bytes FROM c) """


def _chunks(spark, d) -> DataFrame:
    return chunks.fixed(table(spark, d, "documents"), "doc_id", "text")


@query(_CHUNKS + "SELECT * FROM chunks", cte=False)
def doc_chunk_fixed(spark, d):
    return chunks.file_map(_chunks(spark, d)).select("file_id", "chunk_no", "hash", "n_bytes")


@query(_CHUNKS + "SELECT CAST(sum(n) AS bigint) AS n_chunks, count(*) AS n_distinct, CAST(sum(b) AS bigint) AS n_bytes, CAST(sum(one) AS bigint) AS n_stored FROM (SELECT hash, count(*) AS n, sum(n_bytes) AS b, max(n_bytes) AS one FROM chunks GROUP BY hash)", cte=False)
def doc_chunk_dedup(spark, d):
    return chunks.dedup_stats(_chunks(spark, d))


@query("SELECT doc_id AS file_id, sha256(text) AS hash FROM documents WHERE strlen(text) > 0", cte=False)
def doc_reassemble(spark, d):
    c = _chunks(spark, d)
    return chunks.reassemble(chunks.file_map(c), chunks.dedup(c)).select("file_id", F.sha2("bytes", 256).alias("hash"))


@query("SELECT doc_id AS file_id, sha256(from_hex(substr(hex(encode(text)), 1 + 8192, 16384))) AS hash FROM documents WHERE strlen(text) > 4096", cte=False)
def doc_segment_read(spark, d):
    c = _chunks(spark, d)
    return chunks.segment(chunks.file_map(c), chunks.dedup(c), 1, 2).select("file_id", F.sha2("bytes", 256).alias("hash"))


@query(_CHUNKS + "SELECT count(*) AS n_missing FROM chunks a WHERE NOT EXISTS (SELECT 1 FROM chunks b WHERE b.hash = a.hash)", cte=False)
def doc_strict_multiget(spark, d):
    c = _chunks(spark, d)
    return chunks.missing(chunks.file_map(c), chunks.dedup(c)).agg(F.count(F.lit(1)).alias("n_missing"))


@query(None)
def doc_chunk_content_defined(spark, d):
    return chunks.file_map(chunks.content_defined(table(spark, d, "documents"), "doc_id", "text"))


def _records(df: DataFrame) -> DataFrame:
    return df.select(F.col("k").cast("binary").alias("key"), F.col("v").cast("binary").alias("value"), F.col("del").alias("deleted"), "seq")


def _rows(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"))


_WRITTEN, _DELETED = [("7", "x"), ("new", "y"), ("7", "z"), ("1006", "back"), ("gone", "w")], ["13", "gone", "never"]
_AT = 10**9
_API = (
    ", src AS (SELECT k, seq, del, v FROM kv UNION ALL SELECT * FROM (VALUES "
    + ", ".join([f"('{k}', CAST({_AT + i} AS bigint), false, '{v}')" for i, (k, v) in enumerate(_WRITTEN)] + [f"('{k}', CAST({_AT + 100 + i} AS bigint), true, NULL)" for i, k in enumerate(_DELETED)])
    + ") b(k, seq, del, v))"
)


def _stored(spark, d) -> KVTable:
    """The log as a stored table: runs of four tiers each are appended, and compacted as they come; then batches of writes and
    deletes through the log of pending writes, a flush, a vacuum, and a second handle."""
    t = KVTable(spark, workspace(spark, "table"), Options(max_l0_runs=2))
    log = kv(spark, d)
    for first in range(0, 20, 4):
        t.append(_records(log.filter(F.col("tier").between(first, first + 3))))
        t.compact_all()
    t.insert_batch([(k.encode(), v.encode()) for k, v in _WRITTEN])
    t.delete_batch([k.encode() for k in _DELETED])
    t = KVTable(spark, t.files.base, t.options)  # pending writes come back from their log
    t.force_flush()
    t.vacuum()
    return KVTable.open(spark, t.files.base, read_only=True)


@query(f"{_API} SELECT k, v FROM {_r('src')}")
def kv_table_scan(spark, d):
    return _rows(_stored(spark, d).scan())


@query(f"{_API} SELECT k, v FROM {_r('src')} WHERE k BETWEEN '10' AND '2'")
def kv_table_range(spark, d):
    return _rows(_stored(spark, d).range(b"10", b"2"))


@query(f"{_API} SELECT p.pos, p.k, r.v FROM (VALUES (0, '7'), (1, 'gone'), (2, 'new'), (3, '7'), (4, '13'), (5, '1006'), (6, '1004'), (7, '')) p(pos, k) LEFT JOIN {_r('src')} r ON p.k = r.k")
def kv_table_get_batch(spark, d):
    keys = ["7", "gone", "new", "7", "13", "1006", "1004", ""]
    got = _stored(spark, d).get_batch([k.encode() for k in keys])
    return spark.createDataFrame([(i, k, v if v is None else v.decode()) for i, (k, v) in enumerate(zip(keys, got))], "pos int, k string, v string")


@query(f"SELECT 1 AS version, k, v FROM {_r(where='tier < 10')} UNION ALL SELECT 2, k, v FROM {_r()}")
def kv_table_versions(spark, d):
    """A table as of an older version and as of the last."""
    t, log = KVTable(spark, workspace(spark, "table"), Options(auto_compact=False)), kv(spark, d)
    t.append(_records(log.filter("tier < 10")))
    t.append(_records(log.filter("tier >= 10")))
    return _rows(t.scan(version=1)).select(F.lit(1).alias("version"), "k", "v").union(_rows(t.scan()).select(F.lit(2), "k", "v"))


@query("SELECT CAST(max(tier // 5) + 2 AS bigint) AS next_id, count(DISTINCT tier // 5) AS n_runs, CAST(count(*) AS bigint) AS n_rows, CAST(sum(CASE WHEN del THEN 1 ELSE 0 END) AS bigint) AS n_deletes FROM kv")
def kv_table_manifest(spark, d):
    """What a second handle folds out of the commit log: the runs appended, by their entries in it."""
    t, log = KVTable(spark, workspace(spark, "table"), Options(auto_compact=False)), kv(spark, d)
    for part in range(4):
        t.append(_records(log.filter(F.expr("tier div 5") == part)))
    t = KVTable.open(spark, t.files.base, read_only=True)
    live = stats.manifest_fold(t.manifest().select("version", F.lit("add").alias("action"), F.explode("add").alias("id")).withColumn("level", F.lit(0)))
    entries = spark.createDataFrame([(r.id, r.n_rows, r.n_deletes) for r in t.live.values()], "id long, n_rows long, n_deletes long")
    total = live.join(entries, "id").agg(F.count(F.lit(1)).alias("n_runs"), F.sum("n_rows").alias("n_rows"), F.sum("n_deletes").alias("n_deletes"))
    return stats.next_id(live, "id").crossJoin(total)


@query(_CHUNKS + ", gone AS (SELECT min(hash) AS hash FROM chunks) SELECT (SELECT count(*) FROM chunks WHERE hash = (SELECT hash FROM gone)) AS n_missing, true AS refused, count(DISTINCT hash) - 1 AS n_stored FROM chunks", cte=False)
def doc_store_strict(spark, d):
    """A chunk store of all documents that has lost a chunk: what a strict read misses, that it refuses, and what is left."""
    t = KVTable(spark, workspace(spark, "chunks"))
    store = ChunkStore(t)
    files = store.write_files(table(spark, d, "documents"), "doc_id", "text")
    gone = files.agg(F.min("hash").alias("hash")).first()["hash"].encode()
    t.delete(gone)
    refused = False
    try:
        store.get_multi([gone])
    except KeyError:
        refused = True
    missing = chunks.missing(files, store.chunks()).agg(F.count(F.lit(1)).alias("n_missing"), F.lit(refused).alias("refused"))
    return missing.crossJoin(store.chunks().agg(F.count(F.lit(1)).alias("n_stored")))


@query("SELECT doc_id AS file_id, sha256(text) AS hash FROM documents WHERE strlen(text) > 0", cte=False)
def doc_store_read(spark, d):
    """Documents written to a chunk store and read back through a second handle."""
    path = workspace(spark, "chunks")
    files = ChunkStore(KVTable(spark, path)).write_files(table(spark, d, "documents"), "doc_id", "text")
    return ChunkStore(KVTable.open(spark, path, read_only=True)).read_files(files).select("file_id", F.sha2("bytes", 256).alias("hash"))
