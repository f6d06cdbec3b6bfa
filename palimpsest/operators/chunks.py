"""Chunks of byte strings: cutting, content addresses, deduplication, reassembly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.records import content_hash

CHUNK = 4096


def fixed(files: DataFrame, file_id: str, data: str, size: int = CHUNK) -> DataFrame:
    """file_id, chunk_no, hash, n_bytes, bytes: pieces of `size` bytes, the last one shorter; an empty file has none."""
    raw = F.col(data).cast("binary")
    n = F.ceil(F.octet_length(raw) / size).cast("int")
    cut = files.filter(F.octet_length(raw) > 0).select(F.col(file_id).alias("file_id"), raw.alias("raw"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    piece = F.substring(F.col("raw"), F.col("chunk_no") * size + 1, F.lit(size))
    out = cut.select("file_id", "chunk_no", piece.alias("bytes"))
    return out.select("file_id", "chunk_no", content_hash("bytes").alias("hash"), F.octet_length("bytes").alias("n_bytes"), "bytes")


def cut_points(data: bytes, least: int = 1024, mean_bits: int = 12, most: int = 16384) -> list[int]:
    """Ends of content-defined chunks: where a rolling hash of the last 32 bytes has mean_bits zero bits."""
    x = np.frombuffer(data, np.uint8)
    rng = np.random.default_rng(1)
    gear = rng.integers(0, 1 << 63, 256, dtype=np.uint64)[x]
    h = np.zeros(len(x), np.uint64)
    for k in range(min(32, len(x))):  # byte k back, shifted k bits
        h[k:] += gear[: len(x) - k] << np.uint64(k)
    marks = np.flatnonzero((h >> np.uint64(31)) & np.uint64((1 << mean_bits) - 1) == 0) + 1
    out, start = [], 0
    while start < len(x):
        k = int(np.searchsorted(marks, start + least))
        end = int(marks[k]) if k < len(marks) else len(x)
        start = min(end, start + most, len(x))
        out.append(start)
    return out


def content_defined(files: DataFrame, file_id: str, data: str) -> DataFrame:
    """Like fixed(), cut where the content says so: an insertion moves few cuts."""

    names, kinds = ["file_id", "chunk_no", "bytes"], (pa.int64(), pa.int32(), pa.binary())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, raw in zip(*b.columns):  # one file at a time
                data = raw.as_py() or b""
                ends = cut_points(data)
                cols = ([file.as_py()] * len(ends), range(len(ends)), [data[a:z] for a, z in zip([0, *ends], ends)])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    cut = files.select(F.col(file_id).cast("long"), F.col(data).cast("binary")).mapInArrow(work, "file_id long, chunk_no int, bytes binary")
    return cut.select("file_id", "chunk_no", content_hash("bytes").alias("hash"), F.octet_length("bytes").alias("n_bytes"), "bytes")


def dedup(chunks: DataFrame) -> DataFrame:
    """hash, bytes, n_bytes: each content once."""
    return chunks.select("hash", "bytes", "n_bytes").dropDuplicates(["hash"])


def dedup_stats(chunks: DataFrame) -> DataFrame:
    """n_chunks, n_distinct, n_bytes, n_stored: two levels of sums, so no task sees all hashes."""
    per = chunks.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("b"), F.max("n_bytes").alias("one"))
    return per.agg(F.sum("n").alias("n_chunks"), F.count(F.lit(1)).alias("n_distinct"), F.sum("b").alias("n_bytes"), F.sum(F.col("one").cast("long")).alias("n_stored"))


def file_map(chunks: DataFrame) -> DataFrame:
    return chunks.select("file_id", "chunk_no", "hash", "n_bytes")


_IN_ORDER = "listagg(bytes) within group (order by chunk_no)"


def reassemble(files: DataFrame, store: DataFrame) -> DataFrame:
    """file_id, bytes: chunks in order, joined by hash. A row holds a whole file; pieces() has no such limit."""
    return files.join(store.select("hash", "bytes"), "hash").groupBy("file_id").agg(F.expr(_IN_ORDER).alias("bytes"))


def pieces(files: DataFrame, store: DataFrame, n_chunks: int = 1024) -> DataFrame:
    """file_id, piece, bytes: like reassemble(), in pieces of n_chunks chunks, so no row grows with its file."""
    parts = files.join(store.select("hash", "bytes"), "hash").withColumn("piece", F.floor(F.col("chunk_no") / n_chunks).cast("int"))
    return parts.groupBy("file_id", "piece").agg(F.expr(_IN_ORDER).alias("bytes"))


def segment(files: DataFrame, store: DataFrame, first: int, last: int) -> DataFrame:
    """reassemble() of the chunks first..last of each file."""
    return reassemble(files.filter(F.col("chunk_no").between(first, last)), store)


def missing(files: DataFrame, store: DataFrame) -> DataFrame:
    """Chunks of files that the store lacks; a strict read needs it to be empty."""
    return files.join(store.select("hash"), "hash", "left_anti")
