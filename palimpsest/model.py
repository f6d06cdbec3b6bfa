"""Schemas and options of the versioned key-value store.

A log row is one mutation: a put of bytes (empty bytes included) or a delete. `seq` orders mutations; the
live view of a log is the put of the greatest seq for each key, unless that mutation is a delete.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KV_LOG = T.StructType().add("key", "binary", False).add("value", "binary").add("deleted", "boolean", False).add("seq", "long", False)
KV_VIEW = T.StructType().add("key", "binary").add("value", "binary")
MANIFEST = T.StructType().add("version", "long").add("action", "string").add("id", "long").add("level", "integer").add("add", T.ArrayType(T.LongType())).add("remove", T.ArrayType(T.LongType()))
CHUNKS = T.StructType().add("hash", "string").add("bytes", "binary").add("n_bytes", "integer")
FILE_MAP = T.StructType().add("file_id", "long").add("chunk_no", "integer").add("hash", "string").add("n_bytes", "integer")


@dataclass(frozen=True)
class Options:
    """Sizes in bytes. Defaults follow the store whose behaviour this one matches.

    There is no number of flush workers, as a flush is one Spark job of many tasks, and no switch to sync pending
    writes, as each batch of them is one whole new file."""

    block_size: int = 4096
    memtable_size: int = 8 << 20
    max_l0_runs: int = 4
    base_level_size: int = 10 << 20
    level_multiplier: int = 10
    bloom_fpp: float = 0.001
    auto_compact: bool = True

    def level_target(self, level: int) -> float:
        return float("inf") if level == 0 else self.base_level_size * self.level_multiplier ** (level - 1)


def checked_keys(keys: Iterable[bytes]) -> list[bytes]:
    """The keys as bytes; raises before anything is written if one is empty."""
    out = [bytes(k) for k in keys]
    if any(not k for k in out):
        raise ValueError("keys must not be empty")
    return out


def entry_bytes(key: str | Column = "key", value: str | Column = "value") -> Column:
    """Bytes of a mutation: key and value; a delete has no value."""
    return (F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")
