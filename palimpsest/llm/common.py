"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_dir

#: Rows, and bytes (but for one longer row), of a batch that goes to Python.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Rows that go through Python hold whole texts or sets: the session sends BATCH_ROWS and BATCH_BYTES at most at a time."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size)) > BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))


_open: list[Scratch] = []


@contextlib.contextmanager
def tidy() -> Iterator[None]:
    """Deletes at its end what operators called inside have left in the shared folder: results must be written elsewhere by then."""
    n = len(_open)
    yield
    while len(_open) > n:
        scratch = _open.pop()
        atexit.unregister(scratch.close)
        scratch.close()


class Scratch:
    """Parquet tables written to the shared folder. drop() deletes what a job no longer needs; the rest goes at exit."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", 0
        self.kept: list[DataFrame] = []
        self.cuts: set[str] = set()
        small_batches(spark)
        _open.append(self)
        atexit.register(self.close)

    def table(self, df: DataFrame) -> DataFrame:
        """Writes df and reads it back: lineage ends at files that outlive any executor."""
        path = f"{self.base}/{self.n}"
        self.n += 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path  # type: ignore[attr-defined]
        return out

    def cut(self, df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
        """A checkpoint in the shared folder, for results of iterations: as many tasks as df has. Deletes the cut that it follows."""
        if self.spark.sparkContext.getCheckpointDir() is None:
            self.spark.sparkContext.setCheckpointDir(shared_dir(self.spark))
        out = df.checkpoint()
        file = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            out._scratch = file.get()  # type: ignore[attr-defined]
            self.cuts.add(file.get())
        if instead_of is not None:
            self.drop(instead_of)
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        """Holds df on the executors until release(). What a lost executor held is computed again from written tables."""
        df = df.persist()
        self.kept.append(df)
        return df

    def release(self) -> None:
        for df in self.kept:
            df.unpersist()
        self.kept = []

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _delete(self.spark, t._scratch)  # type: ignore[attr-defined]
            self.cuts.discard(t._scratch)  # type: ignore[attr-defined]

    def close(self) -> None:
        for path in [self.base, *self.cuts]:
            with contextlib.suppress(Exception):
                _delete(self.spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def id_crc(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id written as decimal text; null stays null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary"))


def row_key() -> Column:
    """doc_id, or a hash of the text where doc_id is null."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.col("text")))


def spare(columns: Sequence[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column (Spark ignores case)."""
    have, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in have:
            n = f"_{n}"
        have.add(n.lower())
        out.append(n)
    return out


def bit_table(hashes: DataFrame, most: int = 1 << 28) -> np.ndarray:
    """A Bloom filter as bytes: of each well-mixed long of the one column of `hashes`, two bits are set, by its low and its high half.

    32 bits a hash, and at most `most` (32 MB) however many there are: beyond that more of what is asked for
    is found by chance, so what passes must be joined exactly afterwards.
    """
    (name,) = hashes.columns
    n = hashes.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    bits = min(most, max(1 << 24, 1 << (32 * n).bit_length()))
    place = lambda h: F.pmod(h, F.lit(bits).cast("long")) + 1  # the functions below count from 1
    at = hashes.select(F.explode(F.array(place(F.col(name)), place(F.shiftrightunsigned(name, 32)))).alias("at"))
    rows = at.groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m")).toArrow()
    out = np.zeros(bits // 8, np.uint8)
    for b, m in zip(rows["b"].to_pylist(), rows["m"].to_pylist()):
        out[(b - 1) * 4096 : b * 4096] = np.frombuffer(m, np.uint8)
    return out


def in_table(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the 64-bit hashes h have their bits in a bit_table."""
    mask = np.uint64(len(table) * 8 - 1)
    bit = lambda at: (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
    h = h.view(np.uint64)
    out = bit(h & mask)
    some = np.flatnonzero(out)
    out[some] = bit((h[some] >> np.uint64(32)) & mask)
    return out


def readable(column: pa.Array) -> pa.Array:
    """A batch's texts as valid UTF-8: what isn't becomes U+FFFD, as bytes.decode does it."""
    raw = column.cast(pa.binary())
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if x is None else x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


def worker_cache(name: str, make):
    """What make() gives, kept over all tasks of this Python worker until another name is asked for: one cache at a time."""
    import sys
    import types

    store = sys.modules.setdefault("_palimpsest_worker", types.ModuleType("_palimpsest_worker"))
    if getattr(store, "name", None) != name:
        store.value, store.name = None, name
        store.value = make()
    return store.value
