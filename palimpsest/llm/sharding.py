"""Rendezvous (highest random weight) sharding of stable record keys over weighted shards.

Each key draws one uniform number per shard from a hash of (key, shard) and goes to the shard
with the least -ln(u) / weight. Adding a shard only adds a candidate, so a record either stays
or moves to the new shard; a shard's share is its weight over the sum of weights. The hash is MD5, so that any
other system can find a record's shard.

Slots number a shard's rows by (hash of key and text, key, text's crc32, size). Rows that are equal in all of these
are counted first and take a run of slots, which is dealt out again in blocks, so no task holds a key's rows.

Defined cases: a null key hashes as a value of its own; a null text has no bytes (size 1, crc32 of
nothing 0); repeated rows go to one shard and take separate slots; a table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, spare

#: Slots of one block of equal rows.
BLOCK = 8192


def _digits(x: Column, n: int) -> Column:
    """The first n hexadecimal digits of the MD5 of a string."""
    return F.substring(F.md5(x.cast("binary")), 1, n)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (int, from 0) of each key; weights are positive."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    name = F.coalesce(key.cast("string"), F.lit("null"))
    # 52 bits of the hash make u in (0, 1]; ln(u) is finite for all of them
    u = lambda i: (F.conv(_digits(F.concat(name, F.lit(f":{i}")), 13), 16, 10).cast("long") + 1) / F.lit(float(2**52))
    cost = [F.struct((-F.log(u(i)) / F.lit(float(w))).alias("cost"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return F.array_min(F.array(*cost))["shard"]


def slots(df: DataFrame, shard: str, key: str, order: Sequence[str], scratch: Scratch) -> DataFrame:
    """df plus `slot`, gapless from 0 in each shard, in the order of a hash of `key` (a string) and then of `order`.

    A shard is numbered in 4096 parts by that hash; the table of their offsets has 4096 rows a shard, which bounds its broadcast.
    """
    part, n, first, block = spare(df.columns, "part", "n", "first", "block")
    same = scratch.table(df.withColumn(part, _digits(F.col(key), 3)).groupBy(*df.columns, part).agg(F.count(F.lit(1)).alias(n)))
    sums = same.groupBy(shard, part).agg(F.sum(n).alias("rows"))
    before = sums.select(shard, part, (F.sum("rows").over(W.partitionBy(shard).orderBy(part)) - F.col("rows")).alias("before"))
    within = F.sum(n).over(W.partitionBy(shard, part).orderBy(*order)) - F.col(n)
    runs = same.withColumn(first, within).join(F.broadcast(before), [shard, part]).withColumn(first, F.col(first) + F.col("before"))
    dealt = runs.withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / BLOCK)))).repartition(shard, first, block)
    low = F.col(block) * BLOCK
    return dealt.withColumn("slot", F.explode(F.sequence(F.col(first) + low, F.col(first) + F.least(F.col(n), low + BLOCK) - 1))).select(*df.columns, "slot")


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, grown: Sequence[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law 'key', shard, slot, grown_shard (with the weights `grown`, by default one more shard of weight 1)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    placed = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        rendezvous(F.col("doc_id"), weights).alias("shard"),
        rendezvous(F.col("doc_id"), grown or [*weights, 1.0]).alias("grown_shard"),
    ).withColumn("key", F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32").cast("string")))
    out = slots(placed, "shard", "key", ["doc_id", "text_crc32", "size"], Scratch(docs.sparkSession))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def balance(placed: DataFrame) -> DataFrame:
    """Rows and bytes of each shard."""
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes"))
