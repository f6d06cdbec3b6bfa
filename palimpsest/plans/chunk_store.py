"""A strict store of content-addressed chunks and files of them, over a KVTable."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunks, resolve
from .table import KVTable


@dataclass(frozen=True)
class TargetChunk:
    """A chunk that stands for others; this store doesn't hold such."""

    keys: tuple[bytes, ...]


class ChunkStore:
    """Reads of missing keys are errors here, and contains() is False where a read fails."""

    def __init__(self, table: KVTable):
        self.table = table
        table.users.add(self)

    def insert(self, key: bytes, chunk: bytes | TargetChunk) -> None:
        self.insert_multi([(key, chunk)])

    def insert_multi(self, pairs: list[tuple[bytes, bytes | TargetChunk]]) -> None:
        if any(isinstance(c, TargetChunk) for _, c in pairs):
            raise ValueError("target chunks are not supported")
        self.table.insert_batch(pairs)  # type: ignore[arg-type]

    def get(self, key: bytes) -> bytes:
        value = self.table.get(key)
        if value is None:
            raise KeyError(key)
        return value

    def get_multi(self, keys: list[bytes]) -> list[bytes]:
        values = self.table.get_batch(keys)
        if None in values:
            raise KeyError(keys[values.index(None)])
        return values  # type: ignore[return-value]

    def contains(self, key: bytes) -> bool:
        try:
            return self.table.contains(key)
        except Exception:
            return False

    def write_files(self, files: DataFrame, file_id: str, data: str, size: int | None = chunks.CHUNK) -> DataFrame:
        """Stores the chunks of files that aren't stored yet and returns the file map; size None cuts by content."""
        cut = chunks.fixed(files, file_id, data, size) if size else chunks.content_defined(files, file_id, data)
        known = resolve.resolve(self.table.log()).select(F.decode("key", "utf-8").alias("hash"))
        fresh = chunks.dedup(cut).join(known, "hash", "left_anti")
        rows = fresh.select(F.encode("hash", "utf-8").alias("key"), F.col("bytes").alias("value"), F.lit(False).alias("deleted"), F.lit(self.table.seq + 1).cast("long").alias("seq"))
        self.table.append(rows)
        return chunks.file_map(cut)

    def chunks(self) -> DataFrame:
        live = resolve.resolve(self.table.log())
        return live.select(F.decode("key", "utf-8").alias("hash"), F.col("value").alias("bytes"), F.octet_length("value").alias("n_bytes"))

    def read_files(self, files: DataFrame) -> DataFrame:
        """file_id, bytes; KeyError if a chunk is missing."""
        store = self.chunks()
        gone = chunks.missing(files, store).limit(5).collect()
        if gone:
            raise KeyError(f"chunks not found: {gone}")
        return chunks.reassemble(files, store)

    def read_pieces(self, files: DataFrame, n_chunks: int = 1024) -> DataFrame:
        """file_id, piece, bytes: files of any length, in pieces of `n_chunks` chunks; KeyError if a chunk is missing."""
        store = self.chunks()
        gone = chunks.missing(files, store).limit(5).collect()
        if gone:
            raise KeyError(f"chunks not found: {gone}")
        return chunks.pieces(files, store, n_chunks)

    def read_segment(self, files: DataFrame, first: int, last: int) -> DataFrame:
        return chunks.segment(files, self.chunks(), first, last)

    def close(self) -> None:
        """Closes the table; RuntimeError while another store is open on it."""
        if any(x is not self for x in self.table.users):
            raise RuntimeError("the table is still in use")
        self.table.users.discard(self)
        self.table.close()
