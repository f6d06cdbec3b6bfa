"""Sizes, zone maps and the packing of sorted entries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ranges

#: What a block costs besides its entries, and an entry besides its key and value.
BLOCK_HEADER, ENTRY_HEADER = 8, 17


def run_meta(df: DataFrame, run: str, key: str, value: str, deleted: str) -> DataFrame:
    """Zone map of each run: least and greatest key, rows, deletes, bytes."""
    size = F.octet_length(F.col(key).cast("binary")) + F.coalesce(F.octet_length(F.col(value).cast("binary")), F.lit(0))
    return df.groupBy(run).agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count(F.lit(1)).alias("n_rows"), F.sum(F.col(deleted).cast("long")).alias("n_deletes"), F.sum(size).cast("long").alias("n_bytes"))


def level_sizes(df: DataFrame, level: str, size: Column, base: int, multiplier: int) -> DataFrame:
    """Bytes of each level below 0 against its target base * multiplier^(level - 1)."""
    total = df.groupBy(level).agg(F.sum(size).cast("long").alias("n_bytes"))
    return total.filter(F.col(level) > 0).withColumn("over_target", F.col("n_bytes") > base * F.pow(F.lit(float(multiplier)), F.col(level) - 1))


def size_estimate(df: DataFrame, seq: str, size: Column, bucket: Column) -> DataFrame:
    """seq and the running bytes of a memtable: every write counts, overwrites included.

    `bucket` cuts the log into ranges of seq that ascend; sums run within ranges and the ranges' sums are
    added before, so no task holds the whole log."""
    rows = df.select(seq, size.cast("long").alias("__size"), bucket.alias("__b"))
    per = rows.groupBy("__b").agg(F.sum("__size").alias("__s"))
    before = per.select("__b", (F.sum("__s").over(W.orderBy("__b")) - F.col("__s")).alias("__before"))
    w = W.partitionBy("__b").orderBy(seq).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("__run", F.sum("__size").over(w)).join(before, "__b").select(seq, (F.col("__run") + F.col("__before")).alias("estimate"))


def block_index(entries: DataFrame, block: list[str], key: str) -> DataFrame:
    """What a reader keeps of each block: first and last key, and how many entries; `block` names the run and the block."""
    return entries.groupBy(*block).agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count(F.lit(1)).alias("n_rows"))


def _follow(sizes: np.ndarray, base: int, limit: int, after: bool) -> tuple[np.ndarray, np.ndarray]:
    """(mark, stop) of each row of a range whose sizes begin at `base` bytes of their run.

    A group begun at row i closes at the first later row whose mark is beyond stop[i]: before that row."""
    ends = base + np.cumsum(sizes)
    begins = ends - sizes
    return (begins, begins + limit) if after else (ends, begins + limit)


def _next(mark: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The row at which the group of each row closes; the number of rows if it goes on beyond the range."""
    return np.maximum(np.searchsorted(mark, stop, "right"), np.arange(len(mark)) + 1)


def _exits(limit: int, after: bool):
    """Of each row at which a group begun before the range may close: mark, and where the last group begun from there stops; and how many groups that makes."""

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("__o")
        base, mark, stop = table["__base"][0].as_py(), *_follow(table["__size"].to_numpy(), table["__base"][0].as_py(), limit, after)
        then, out, n = _next(mark, stop), stop.copy(), np.ones(len(mark), np.int64)
        for i in range(len(mark) - 1, -1, -1):
            if then[i] < len(mark):
                out[i], n[i] = out[then[i]], n[then[i]] + 1
        # a group begun before has its stop below base + limit: rows beyond the first mark over that are no candidates
        few = min(len(mark), int(np.searchsorted(mark, base + limit, "right")) + 1)
        cols = [pa.array(np.full(few, table["__b"][0].as_py()), pa.int64()), pa.array(mark[:few]), pa.array(out[:few]), pa.array(n[:few])]
        return pa.Table.from_arrays([table["__run"].slice(0, few).combine_chunks(), *cols], ["__run", "__b", "mark", "out", "n"])

    return work


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By run and range: the stop that the open group has on entry, and the groups begun before; candidates come in order."""
    run = at = done = None
    stop, groups, rows = -1, 0, []
    for b in batches:
        for r, k, mark, out, n in zip(*(c.to_pylist() for c in b.columns)):
            if r != run:
                run, stop, groups, at, done = r, -1, 0, None, None
            if k != at:
                at, done = k, False
                rows.append((r, k, stop, groups))
            if not done and mark > stop:
                stop, groups, done = out, groups + n, True
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((b.schema.field(0).type, pa.int64(), pa.int64(), pa.int64()))], ["__run", "__b", "__stop", "__groups"])
        rows = []


def _number(limit: int, after: bool, names: list[str]):
    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("__o")
        mark, stop = _follow(table["__size"].to_numpy(), table["__base"][0].as_py(), limit, after)
        then, grp = _next(mark, stop), np.empty(len(mark), np.int64)
        i, g = int(np.searchsorted(mark, table["__stop"][0].as_py(), "right")), table["__groups"][0].as_py()
        grp[:i] = g - 1
        while i < len(mark):
            grp[i : then[i]] = g
            i, g = int(then[i]), g + 1
        return table.select(names).append_column("grp", pa.array(grp))

    return work


def _folded(df: DataFrame, order: str, limit: int, after: bool, run: str | None, at: list | None) -> DataFrame:
    """A fold with resets over each run in order, in parallel over ranges of `order`.

    Prefix sums say, for every row, where a group begun there would close. Each range follows these from the few rows
    at which a group begun before it may close; one pass over those stitches ranges together; then ranges number their rows."""
    at = ranges.cuts(df, order) if at is None else at
    names = df.columns
    rows = df.select("*", (F.col(run).cast("string") if run else F.lit("")).alias("__run"), F.col(order).alias("__o"), F.col("size").cast("long").alias("__size"), ranges.range_of(order, at).cast("long").alias("__b"))
    per = rows.groupBy("__run", "__b").agg(F.sum("__size").alias("__s"))
    base = per.select("__run", "__b", (F.sum("__s").over(W.partitionBy("__run").orderBy("__b")) - F.col("__s")).alias("__base"))
    rows = rows.join(base, ["__run", "__b"])
    exits = rows.select("__run", "__o", "__size", "__b", "__base").groupBy("__run", "__b").applyInArrow(_exits(limit, after), "__run string, __b long, mark long, out long, n long")
    entry = exits.repartition("__run").sortWithinPartitions("__run", "__b", "mark").mapInArrow(_stitch, "__run string, __b long, __stop long, __groups long")
    ddl = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", grp long"
    return rows.join(entry, ["__run", "__b"]).groupBy("__run", "__b").applyInArrow(_number(limit, after, names), ddl)


def memtable_rollover(df: DataFrame, order: str, limit: int, run: str | None = None, at: list | None = None) -> DataFrame:
    """df (order, size) plus grp: the memtable of each write; one closes after the write that takes it over the limit.

    `order` is unique in a run; `run` names a column of runs that are folded each; `at` gives cuts of the order where they are known."""
    return _folded(df, order, limit, True, run, at)


def pack_blocks(df: DataFrame, order: str, block_size: int, run: str | None = None, at: list | None = None) -> DataFrame:
    """df (order, size with ENTRY_HEADER) plus grp: the block of each entry of a sorted run; an entry too large stands alone."""
    return _folded(df, order, block_size - BLOCK_HEADER, False, run, at)


def next_id(df: DataFrame, column: str, empty: int = 1) -> DataFrame:
    """The id after the greatest, `empty` if there is none."""
    return df.agg(F.coalesce(F.max(column) + 1, F.lit(empty)).cast("long").alias("next_id"))


def manifest_fold(manifest: DataFrame) -> DataFrame:
    """version, action (add or remove), id, level -> the live runs: adds that no later remove names."""
    adds = manifest.filter("action = 'add'")
    gone = manifest.filter("action = 'remove'").groupBy("id").agg(F.max("version").alias("__gone"))
    return adds.join(gone, "id", "left").filter("__gone is null or __gone < version").select("level", "id")


def valid_prefix(log: DataFrame, corrupt: Column, seq: str = "seq") -> DataFrame:
    """The rows before the first corrupt one."""
    first = log.filter(corrupt).agg(F.min(seq).alias("__first"))  # one row
    return log.crossJoin(F.broadcast(first)).filter(F.col("__first").isNull() | (F.col(seq) < F.col("__first"))).drop("__first")
