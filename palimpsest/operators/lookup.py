"""Point, batch and range reads. Only predicates on the key go below the merge; one on the value would revive old versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranges
from .resolve import resolve

def get(log: DataFrame, value, key="key", seq="seq", deleted="deleted") -> DataFrame:
    """The live row of one key: no row if it is absent or deleted."""
    return resolve(log.filter(F.col(key) == F.lit(value)), key, seq, deleted)


def get_batch(log: DataFrame, keys: DataFrame, key="key", seq="seq", deleted="deleted", position="pos") -> DataFrame:
    """keys (position, key) with the live row of each: order and duplicates stay, absent ones are null.

    The log is cut to the wanted keys before it is merged. Spark sends the keys to all tasks where it knows them to be
    fewer than its threshold (spark.sql.autoBroadcastJoinThreshold), else both sides are exchanged."""
    wanted = keys.select(key).distinct()
    live = resolve(log.join(wanted, key, "left_semi"), key, seq, deleted)
    return keys.join(live, key, "left").orderBy(position)


def contains_batch(log: DataFrame, keys: DataFrame, key="key", seq="seq", deleted="deleted") -> DataFrame:
    """keys plus `present`."""
    live = resolve(log.join(keys.select(key).distinct(), key, "left_semi"), key, seq, deleted).select(key, F.lit(True).alias("present"))
    return keys.join(live, key, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def present(log: DataFrame, keys: DataFrame, key="key", seq="seq", deleted="deleted") -> DataFrame:
    """The keys that have a live row."""
    return keys.join(resolve(log, key, seq, deleted).select(key), key, "left_semi")


def absent(log: DataFrame, keys: DataFrame, key="key", seq="seq", deleted="deleted") -> DataFrame:
    """The keys that have none."""
    return keys.join(resolve(log, key, seq, deleted).select(key), key, "left_anti")


def strict(found: DataFrame, value: str) -> DataFrame:
    """found, or KeyError if a row has no value."""
    missing = found.filter(F.col(value).isNull()).limit(5).collect()
    if missing:
        raise KeyError(f"not found: {missing}")
    return found


def seek(log: DataFrame, target, key="key", seq="seq", deleted="deleted") -> DataFrame:
    """The first live row whose key is at least target."""
    return resolve(log.filter(F.col(key) >= F.lit(target)), key, seq, deleted).orderBy(key).limit(1)


def range_scan(log: DataFrame, low, high, key="key", seq="seq", deleted="deleted") -> DataFrame:
    """Live rows with low <= key <= high."""
    return resolve(log.filter(F.col(key).between(low, high)), key, seq, deleted)


def block_of(blocks: DataFrame, keys: DataFrame, key="key", first="first_key") -> DataFrame:
    """The greatest first key of a block that is at most each key: the one block to read.

    blocks is a sparse index; the keys are a stated set. Sorted together, each key takes the last first key
    before it within its range of the index, and the greatest of earlier ranges where it has none."""
    from pyspark.sql import Window as W

    both = blocks.select(F.col(first).alias(key), F.col(first).alias("__first"), F.lit(0).alias("__probe")).unionByName(keys.select(key, F.lit(None).cast(blocks.schema[first].dataType).alias("__first"), F.lit(1).alias("__probe")))
    ranged = both.withColumn("__range", ranges.range_of(key, ranges.cuts(blocks, first)))
    # one row a range from here to the join
    before = ranged.groupBy("__range").agg(F.max("__first").alias("__top"))
    carried = before.withColumn("__carry", F.max("__top").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1))).drop("__top")
    w = W.partitionBy("__range").orderBy(key, "__probe").rowsBetween(W.unboundedPreceding, 0)
    out = ranged.withColumn("__here", F.last("__first", True).over(w)).filter("__probe = 1").join(carried, "__range")
    return out.select(key, F.coalesce("__here", "__carry").alias(first)).filter(F.col(first).isNotNull())
