"""Sorted runs: Parquet files in key order, with bloom filters and min/max statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..model import KV_LOG, Options, entry_bytes
from ..operators.compaction import Run
from .files import Files


def write_run(files: Files, df: DataFrame, name: str, options: Options, id_: int, level: int, partitions: int | None = None) -> Run | None:
    """Range-partitioned and sorted by key, so that each file and row group covers few keys. Returns the run's entry
    for the manifest, gathered while it is written; None for a run without rows.

    The bloom filter answers for absent keys; its error is the options' bloom_fpp, 0 for none."""
    sorted_ = df.select(*KV_LOG.names)
    sorted_ = (sorted_.repartitionByRange(partitions, "key") if partitions else sorted_.repartitionByRange("key")).sortWithinPartitions("key")
    seen = Observation()
    sorted_ = sorted_.observe(seen, F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("n"), F.min("seq").alias("s0"), F.max("seq").alias("s1"), F.sum(F.col("deleted").cast("long")).alias("d"), F.sum(entry_bytes()).alias("b"))
    w = sorted_.write.option("parquet.page.size", str(max(options.block_size, 1024)))
    if options.bloom_fpp:
        w = w.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(options.bloom_fpp))
    w.parquet(f"{files.base}/{name}")
    m = seen.get
    return Run(id_, level, bytes(m["lo"]), bytes(m["hi"]), files.size(name), m["n"], m["s0"], m["s1"], m["d"], name, m["b"]) if m["n"] else None


def read_runs(spark: SparkSession, base: str, names: Sequence[str]) -> DataFrame:
    """All rows of the runs; a run that can't be read is an error."""
    if not names:
        return spark.createDataFrame([], KV_LOG)
    return spark.read.schema(KV_LOG).option("ignoreCorruptFiles", "false").option("ignoreMissingFiles", "false").parquet(*[f"{base}/{n}" for n in names])
