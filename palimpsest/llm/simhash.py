"""SimHash document fingerprints, and a search of all fingerprints within a Hamming radius.

Terms are pairs of neighbouring words (a lone word is paired with nothing; a text without words has
the one term ''), weighted by how often they occur. Each term's 128-bit hash votes on each bit: +weight
where its bit is 1, -weight where it is 0; the sign of the sum is the fingerprint's bit (a tie is 0).

Votes are counted in whole-stage code: a 64-bit hash is cut into 16 longs of four 16-bit counters, so
that one sum adds four bits at once, and terms are grouped in runs of 32,767 so no counter overflows.

The search cuts a fingerprint into blocks and keys a table by each choice of blocks that must agree.

Null texts count as empty. Equal texts have equal fingerprints, whatever their id. Repeated rows give
repeated results. An empty table gives an empty result. Null ids come last in descending order.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

BITS = 128
LANE = 0x0001000100010001
#: Terms whose votes are counted together: the topmost counter stays below the sign bit.
RUN = 32_767


def terms(text: Column) -> Column:
    """64-bit hashes of the word pairs of a text."""
    words = F.filter(F.split(F.lower(text), r"[\s\p{Punct}]+"), lambda w: w != "")
    two = F.transform(F.arrays_zip(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))).alias("a"), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))).alias("b")), lambda p: F.xxhash64(p["a"], p["b"]))
    return F.when(F.size(words) > 1, two).otherwise(F.array(F.xxhash64(F.coalesce(F.get(words, F.lit(0)), F.lit("")), F.lit(None).cast("string"))))


def _lanes() -> list[Column]:
    """Sums of 16-bit counters over the column h: lanes 0-15 of the low half, 16-31 of the high half."""
    high = F.xxhash64(F.col("h"), F.lit(1))
    return [F.sum(F.shiftrightunsigned(x, j).bitwiseAND(F.lit(LANE))).alias(f"v{16 * k + j}") for k, x in enumerate((F.col("h"), high)) for j in range(16)]


def vote(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys + lo, hi (long): the fingerprint of each row's text. keys must tell rows apart."""
    each = df.select(*keys, F.posexplode(terms(F.col(text))).alias("__at", "h")).withColumn("__run", F.expr(f"__at div {RUN}"))
    runs = each.groupBy(*keys, "__run").agg(F.count(F.lit(1)).alias("n"), *_lanes())
    # bit j + 16 i of a half is counter i of lane j; twice its count against n is the sign of its vote
    bits = lambda k: [F.shiftrightunsigned(F.col(f"v{16 * k + j}"), 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4) for j in range(16)]
    votes = runs.select(*keys, F.array(*[2 * b - F.col("n") for k in (0, 1) for b in bits(k)]).alias("votes"))
    total = votes.groupBy(*keys).agg(*[F.sum(F.col("votes")[b]).alias(f"t{b}") for b in range(BITS)])
    word = lambda k: sum((F.when(F.col(f"t{64 * k + b}") > 0, F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)) for b in range(64)), F.lit(0).cast("long"))
    return total.select(*keys, word(0).alias("lo"), word(1).alias("hi"))


def as_hex(lo: Column, hi: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Share of equal bits."""
    return F.lit(1.0) - distance(a, b) / F.lit(float(BITS))


#: Ranges that neighbours() cuts ids into at most; what it broadcasts has 24 bytes for each, 13 MB in all.
RANGES = 1 << 19


def _rank(a: Column, key: Column, most: int) -> Column:
    """How many of the at most `most` ascending values of array a are <= key, by bisection."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= F.size(a)) & (F.get(a, at + s - 1) <= key), at + s).otherwise(at))


def neighbours(docs: DataFrame, bucket_bytes: int = 8 << 20) -> DataFrame:
    """Each document with the next one's text, in descending order of doc_id (after the last, the first).

    One exchange of the texts: rows are dealt to ranges of (doc_id, hash of the text), so that rows of one id, or
    without one, don't have to share a range; Spark cuts the ranges from ids and hashes alone. The first row of
    each range is also sent to the range before it. Beyond RANGES ranges of `bucket_bytes`, ranges grow.
    Columns: bucket, at (order in it), ghost (a copy that only serves as a neighbour), doc_id, text, next_text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # ascending keys are descending ids, nulls last
    key = F.struct(F.col("doc_id").isNull().cast("int").alias("k0"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long")).alias("k1"), F.xxhash64("text").alias("k2"))
    keys = docs.select(key.alias("k"), (F.octet_length("text") + 64).alias("b"))  # a row takes more than its text
    total = keys.agg(F.sum("b").alias("b")).first()["b"] or 0
    n = max(1, min(RANGES, -(-total // bucket_bytes)))
    dealt = keys.select("k.*").repartitionByRange(n, "k0", "k1", "k2") if n > 1 else keys.select("k.*").coalesce(1)
    heads = sorted(tuple(r["k"]) for r in dealt.groupBy(F.spark_partition_id()).agg(F.min(F.struct("k0", "k1", "k2")).alias("k")).collect())
    heads = heads or [(0, 0, 0)]
    # two steps of bisection: which part of the heads, then which head; a row that has a head's key is one
    step = max(1, math.isqrt(len(heads)))
    parts = [heads[i : i + step] for i in range(0, len(heads), step)]
    kind = "struct<k0:int,k1:bigint,k2:bigint>"
    ranges = spark.createDataFrame([(i, i * step, part) for i, part in enumerate(parts)], f"part int, first int, heads array<{kind}>")
    starts = F.array(*[F.struct(F.lit(k0).alias("k0"), F.lit(k1).cast("long").alias("k1"), F.lit(k2).cast("long").alias("k2")) for k0, k1, k2 in (p[0] for p in parts)])
    rows = docs.withColumn("k", key).withColumn("part", F.greatest(_rank(starts, F.col("k"), len(parts)) - 1, F.lit(0))).join(F.broadcast(ranges), "part")
    rows = rows.withColumn("in_part", F.greatest(_rank(F.col("heads"), F.col("k"), step) - 1, F.lit(0)))
    rows = rows.withColumn("bucket", F.col("first") + F.col("in_part")).withColumn("head", F.get("heads", F.col("in_part")) == F.col("k"))
    here = lambda at, ghost: F.struct(at.alias("bucket"), F.lit(ghost).alias("ghost"))
    before = F.pmod(F.col("bucket") - 1, F.lit(len(heads)))
    both = F.when(F.col("head"), F.array(here(F.col("bucket"), False), here(before, True))).otherwise(F.array(here(F.col("bucket"), False)))
    dealt = rows.select("doc_id", "text", "k", F.explode(both).alias("p")).select("doc_id", "text", "k", "p.bucket", "p.ghost").repartition(F.col("bucket"))
    w = W.partitionBy("bucket").orderBy("ghost", "k")
    return dealt.withColumn("at", F.row_number().over(w)).withColumn("next_text", F.lead("text").over(w)).drop("k")


def fingerprint_documents(docs: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and of the search within
    `radius`: class_id (the least doc_id of the same fingerprint) and n_near (how many other fingerprints are that near)."""
    scratch = Scratch(docs.sparkSession)
    prints = scratch.table(_fingerprints(docs))
    classes = scratch.table(prints.groupBy("lo", "hi").agg(F.min("doc_id").alias("class_id")))
    pairs = within_radius(classes, radius)
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a_lo").alias("lo"), F.col("a_hi").alias("hi")), F.struct(F.col("b_lo").alias("lo"), F.col("b_hi").alias("hi")))).alias("p"))
    near = ends.groupBy("p.lo", "p.hi").agg(F.count(F.lit(1)).alias("n_near"))
    info = scratch.table(classes.join(near.hint("merge"), ["lo", "hi"], "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long"))))
    return prints.join(info.hint("merge"), ["lo", "hi"]).drop("lo", "hi")


def _fingerprints(docs: DataFrame) -> DataFrame:
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int"))
    both = neighbours(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.concat(kept, F.substring(F.coalesce(F.col("next_text"), F.lit("")), F.lit(1), half))
    both = both.withColumn("edited", F.when(~F.col("ghost"), edited)).withColumn("edited_sha256", F.sha2("edited", 256))
    whole = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")))
    sides = both.select("bucket", "at", "ghost", "doc_id", "n_chars", "edited_sha256", F.explode(F.when(F.col("ghost"), whole).otherwise(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body"))))).alias("s"))
    keys = ["bucket", "at", "ghost", "doc_id", "n_chars", "edited_sha256"]
    prints = vote(sides.select(*keys, "s.kind", "s.body"), [*keys, "kind"], "body")
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    rows = prints.groupBy(*keys).agg(pick(0, "lo").alias("lo"), pick(0, "hi").alias("hi"), pick(1, "lo").alias("elo"), pick(1, "hi").alias("ehi"))
    w = W.partitionBy("bucket").orderBy("at")
    rows = rows.withColumn("nlo", F.lead("lo").over(w)).withColumn("nhi", F.lead("hi").over(w)).filter(~F.col("ghost"))
    own = (F.col("lo"), F.col("hi"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        as_hex(*own).alias("fingerprint"), as_hex(F.col("elo"), F.col("ehi")).alias("edited_fingerprint"),
        likeness(own, (F.col("elo"), F.col("ehi"))).alias("near_edited"), likeness(own, (F.col("nlo"), F.col("nhi"))).alias("near_next"), *own,
    )


def within_radius(prints: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """All pairs of different fingerprints (lo, hi) at most `radius` bits apart: a_lo, a_hi, b_lo, b_hi, bits.

    128 bits are cut into `blocks` (by default radius + 2). Two fingerprints within the radius differ in at most
    `radius` blocks, so the others agree: a table for each choice of blocks - radius of them, keyed by what they
    hold, has every such pair. Equal fingerprints are one class; a pair counts in the first table that holds it.
    """
    blocks = radius + 2 if blocks is None else blocks
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("0 <= radius < blocks <= 128")
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    halves = lambda m: [F.lit(((h + (1 << 63)) & ((1 << 64) - 1)) - (1 << 63)).cast("long") for h in (m & ((1 << 64) - 1), m >> 64)]
    mask = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(blocks)]
    tables = [*combinations(range(blocks), blocks - radius)]

    def key(t: int) -> Column:
        low, high = halves(sum(mask[i] for i in tables[t]))
        return F.xxhash64(F.lit(t), F.col("lo").bitwiseAND(low), F.col("hi").bitwiseAND(high))

    keyed = prints.select("lo", "hi").distinct().select("lo", "hi", F.posexplode(F.array(*map(key, range(len(tables))))).alias("t", "key"))
    a, b = (keyed.select(F.col("t").alias(f"{x}_t"), F.col("key").alias(f"{x}_key"), F.col("lo").alias(f"{x}_lo"), F.col("hi").alias(f"{x}_hi")) for x in "ab")
    after = (F.col("a_hi") < F.col("b_hi")) | ((F.col("a_hi") == F.col("b_hi")) & (F.col("a_lo") < F.col("b_lo")))
    near = distance((F.col("a_lo"), F.col("a_hi")), (F.col("b_lo"), F.col("b_hi")))
    pairs = a.join(b, (F.col("a_t") == F.col("b_t")) & (F.col("a_key") == F.col("b_key")) & after & (near <= radius))

    def agree(i: int) -> Column:
        low, high = halves(mask[i])
        return (F.col("a_lo").bitwiseXOR(F.col("b_lo")).bitwiseAND(low) == 0) & (F.col("a_hi").bitwiseXOR(F.col("b_hi")).bitwiseAND(high) == 0)

    # of the choices within the blocks that agree, the first is that of the first such blocks
    first = F.lit(False)
    for t, chosen in enumerate(tables):
        rule = F.col("a_t") == t
        for i in range(chosen[-1] + 1):
            rule = rule & (agree(i) if i in chosen else ~agree(i))
        first = first | rule
    return pairs.filter(first).select("a_lo", "a_hi", "b_lo", "b_hi", near.alias("bits"))
