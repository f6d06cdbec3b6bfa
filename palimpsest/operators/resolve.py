"""The merge of runs: the latest version of each key.

The window form plans a partial rank limit before the exchange (each task forwards one row a key), needs
no value column for key-only reads, and lets predicates on the key through to the scan. A hot key is thus
cut to one row a task before it crosses the network.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str | Sequence[str] = "key", seq: str | Sequence[str] = "seq") -> DataFrame:
    """The row of the greatest seq for each key, deletes included."""
    key, seq = [key] if isinstance(key, str) else [*key], [seq] if isinstance(seq, str) else [*seq]
    w = W.partitionBy(*key).orderBy(*[F.desc(s) for s in seq])
    return df.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def resolve(df: DataFrame, key="key", seq="seq", deleted: str | None = "deleted", keep_deletes: bool = False) -> DataFrame:
    """The live rows of a log; with keep_deletes the latest versions, as a merge that isn't the last needs them."""
    out = latest(df, key, seq)
    return out if keep_deletes or deleted is None else out.filter(~F.col(deleted))


def merge_runs(runs: Sequence[DataFrame], key="key", seq="seq") -> DataFrame:
    """One run out of many: latest versions, deletes kept. Any order and grouping of runs gives the same."""
    return latest(reduce(DataFrame.unionByName, runs), key, seq)


def snapshot(df: DataFrame, upto: int | Column, key="key", seq="seq", deleted="deleted") -> DataFrame:
    """The live rows as of seq `upto`."""
    return resolve(df.filter(F.col(seq) <= upto), key, seq, deleted)


def scan(df: DataFrame, key="key", seq="seq", deleted="deleted", skip_empty: str | None = None) -> DataFrame:
    """Live rows in key order; skip_empty names the value column whose empty puts are hidden as well."""
    out = resolve(df, key, seq, deleted)
    if skip_empty:
        out = out.filter(F.octet_length(skip_empty) > 0)
    return out.orderBy(key)


def version_stats(df: DataFrame, key="key") -> DataFrame:
    """How many versions and keys a log has, and how many versions others shadow. Counts by key first: no key is distinct-counted in one task."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("versions"), F.count(F.lit(1)).alias("n_keys"), (F.sum("n") - F.count(F.lit(1))).alias("shadowed"))
