"""KVTable: a store of immutable sorted runs under a commit log.

Writes are buffered, logged at once, and cut into level-0 runs; reads take one version of the run list and
merge it with the buffer. Each commit is one new file, so a reader never sees half of it, and a crash leaves
at most files that vacuum() deletes. Opening reads the last snapshot of the log and the commits since. One writer at a time; a second one fails with FileExistsError.
"""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import KV_LOG, Options, checked_keys
from ..operators import compaction, lookup, resolve
from ..sources import log, runs
from ..sources.files import Files


class KVTable:
    def __init__(self, spark: SparkSession, path: str, options: Options | None = None, read_only: bool = False):
        self.spark, self.options, self.read_only = spark, options or Options(), read_only
        self.files = Files(spark, path)
        if not self.files.names(log.LOG):
            if read_only:
                raise FileNotFoundError(path)
            self.files.mkdirs()
            log.commit(self.files, 0, action="create", seq=0)
        self.state = log.load(self.files)
        self.pending: list[log.Mutation] = log.replay_pending(self.files, self.state.flushed)
        self.seq = max([self.state.flushed, *(r[3] for r in self.pending)])
        self.estimate = sum(len(k) + len(v or b"") for k, v, _, _ in self.pending)
        self.users: weakref.WeakSet = weakref.WeakSet()

    @property
    def version(self) -> int:
        return self.state.version

    @property
    def live(self) -> dict[int, compaction.Run]:
        return self.state.live

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options | None = None, read_only: bool = False) -> KVTable:
        return cls(spark, path, options, read_only)

    # writes

    def insert(self, key: bytes, value: bytes) -> None:
        self.insert_batch([(key, value)])

    def insert_batch(self, pairs: Iterable[tuple[bytes, bytes]]) -> None:
        """All or nothing: an empty key anywhere writes nothing. The last of equal keys wins."""
        pairs = [*pairs]
        keys = checked_keys(k for k, _ in pairs)
        self._write([(k, bytes(v), False) for k, (_, v) in zip(keys, pairs)])

    def delete(self, key: bytes) -> None:
        self.delete_batch([key])

    def delete_batch(self, keys: Iterable[bytes]) -> None:
        self._write([(k, None, True) for k in checked_keys(keys)])

    def _write(self, rows: list[tuple[bytes, bytes | None, bool]]) -> None:
        self._writable()
        if not rows:
            return
        stamped = [(*r, self.seq + 1 + i) for i, r in enumerate(rows)]
        log.append_pending(self.files, stamped)
        self.seq += len(rows)
        self.pending += stamped
        self.estimate += sum(len(k) + len(v or b"") for k, v, _, _ in stamped)
        if self.estimate > self.options.memtable_size:
            self.force_flush()

    def append(self, df: DataFrame, **extra) -> None:
        """Commits a DataFrame of key, value, deleted, seq as one level-0 run; seq comes from its source.

        `extra` goes into the commit. Rows with an empty or null key are an error and commit nothing."""
        self._writable()
        self.force_flush()
        checked = df.withColumn("key", F.when(F.octet_length("key") > 0, F.col("key")).otherwise(F.raise_error(F.lit("keys must not be empty"))))
        self._publish(self._write_run(checked, 0), [], "append", **extra)

    def force_flush(self) -> None:
        """Commits what is pending as a level-0 run; nothing to do if there is none."""
        if not self.pending:
            return
        self._writable()
        self._publish(self._write_run(self._buffer(), 0, 1), [], "flush")
        self.pending, self.estimate = [], 0
        log.drop_pending(self.files, self.seq)
        self.compact_all()

    def _write_run(self, df: DataFrame, level: int, partitions: int | None = None) -> compaction.Run | None:
        """In a folder that no other writer has, dead or alive: what loses its commit is debris for vacuum()."""
        id_ = self.state.next_run
        return runs.write_run(self.files, df, f"runs/L{level}-{id_}/attempt={uuid.uuid4().hex}", self.options, id_, level, partitions)

    def _publish(self, run: compaction.Run | None, remove: list[int], action: str, **extra) -> None:
        flushed = self.seq if action == "flush" else max(self.state.flushed, run.max_seq if run and action != "compact" else 0)
        self.state.apply(log.commit(self.files, self.version + 1, [run] if run else [], remove, action=action, seq=flushed, **extra))
        log.snapshot(self.files, self.state)
        self.seq = max(self.seq, flushed)

    def refresh(self) -> None:
        """Takes over what other handles have committed since."""
        log.refresh(self.files, self.state)
        self.seq = max(self.seq, self.state.flushed)

    def compact_all(self) -> int:
        """Runs compactions until none is due, if the options allow it; returns how many."""
        n = 0
        while self.options.auto_compact and self.compact():
            n += 1
        return n

    def compact(self) -> bool:
        """Runs one compaction if one is due. Inputs stay on disk for readers of older versions until vacuum()."""
        task = compaction.pick([*self.live.values()], self.options)
        if not task:
            return False
        self._writable()
        frames = [self._read([r]) for r in task.inputs]
        out = compaction.compact(frames, compaction.may_drop_deletes(task, [*self.live.values()]))
        self._publish(self._write_run(out, task.source_level + 1), [r.id for r in task.inputs], "compact")
        return True

    def vacuum(self) -> list[str]:
        """Deletes run folders that the current version doesn't name, and returns their names. No writer may be at work."""
        self._writable()
        live = {r.path for r in self.live.values()}
        gone = [x for n in self.files.names("runs") for a in self.files.names(f"runs/{n}") if (x := f"runs/{n}/{a}") not in live]
        for n in gone:
            self.files.delete(n)
        for n in self.files.names("runs"):
            if not self.files.names(f"runs/{n}"):
                self.files.delete(f"runs/{n}")
        return gone

    def close(self) -> None:
        if not self.read_only:
            self.force_flush()

    def _writable(self) -> None:
        if self.read_only:
            raise PermissionError("the table is open for reading")

    # reads

    def _buffer(self) -> DataFrame:
        return self.spark.createDataFrame(self.pending, KV_LOG)

    def _read(self, some: Iterable[compaction.Run]) -> DataFrame:
        return runs.read_runs(self.spark, self.files.base, [r.path for r in some])

    def log(self, low: bytes | None = None, high: bytes | None = None, version: int | None = None) -> DataFrame:
        """All mutations of the current or an older version, of runs that meet [low, high] only. Older versions need their runs still on disk."""
        live = [*(self.live if version is None else log.load(self.files, version).live).values()]
        some = [r for r in live if (low is None or r.last_key >= low) and (high is None or r.first_key <= high)]
        out = self._read(some)
        return out.unionByName(self._buffer()) if version is None and self.pending else out

    def get(self, key: bytes) -> bytes | None:
        for r in reversed(self.pending):
            if r[0] == key:
                return r[1]
        row = lookup.get(self.log(key, key), bytearray(key)).first()
        return None if row is None else bytes(row["value"])

    def contains(self, key: bytes) -> bool:
        return self.get(key) is not None

    def get_batch(self, keys: list[bytes]) -> list[bytes | None]:
        if not keys:
            return []
        asked = self.spark.createDataFrame([(i, bytearray(k)) for i, k in enumerate(keys)], "pos long, key binary")
        rows = lookup.get_batch(self.log(min(keys), max(keys)), asked).select("pos", "value").collect()
        return [None if r["value"] is None else bytes(r["value"]) for r in rows]

    def scan(self, skip_empty: bool = False, version: int | None = None) -> DataFrame:
        """key, value of the live rows in key order. The frame keeps to the version it was made at."""
        return resolve.scan(self.log(version=version), skip_empty="value" if skip_empty else None).select("key", "value")

    def range(self, low: bytes, high: bytes) -> DataFrame:
        return lookup.range_scan(self.log(low, high), bytearray(low), bytearray(high)).select("key", "value")

    def levels(self) -> dict[int, list[compaction.Run]]:
        """Live runs: level 0 by id, the others by first key."""
        out: dict[int, list[compaction.Run]] = {}
        for r in sorted(self.live.values(), key=lambda r: r.id):
            out.setdefault(r.level, []).append(r)
        return {k: v if k == 0 else sorted(v, key=lambda r: r.first_key) for k, v in out.items()}

    def manifest(self) -> DataFrame:
        return log.as_frame(self.spark, log.commits(self.files))

    def size_estimate(self) -> int:
        """Bytes written since the last flush, overwrites included."""
        return self.estimate

    def stored_bytes(self) -> int:
        """Bytes of keys and values of all runs and of what is pending; the manifest has those of runs."""
        return sum(r.entry_bytes for r in self.live.values()) + self.estimate
