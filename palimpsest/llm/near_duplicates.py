"""MinHash near-duplicates: banded minima find candidates, signatures and full sets confirm them, and
alternating large-star and small-star joins the links to components.

1. Each text becomes its set of word shingles; texts with equal sets are one class from then on.
2. Universal hashes' minima of each class fall into bands; classes that share a band's minima share a bucket.
3. Each class of a bucket is compared with the bucket's least class: first signatures, then, for what is left,
   full sets.
4. Buckets whose classes are not all in one component by then are compared further, every pair of classes of
   different components in pairs of blocks of bounded bytes; a pair belongs to its first common band alone. Rows
   of a component that fills blocks of its own never meet each other again, nor do sets whose sizes alone rule a
   link out. Signatures go first; full sets follow of classes that have a pair left. Candidates never leave their
   task: it puts out at most one link less than it has classes.
5. Components of all links; the least doc_id of a component is kept.

Sets are kept of classes in buckets alone: a second pass over the texts, behind a bit table of bounded size,
computes them again, so no text crosses the network.

At the link's least similarity s a pair shares no band with probability (1 - s^rows)^bands: with 26 bands
of 5, 4e-7 for 0.85 (op5) and 3.3e-5 for 0.80 (the pipeline). The signature test leaves 5 standard deviations of room, so it costs less still.

Null texts and texts without words have an empty set, link to nothing, and are kept. A null id takes part;
component_id is the least id that isn't null, or null if there is none (find_documents marks such rows as
kept, keep_one keeps one of them). Repeated rows are in one component and all bear its id. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bit_table, in_table, row_key, spare, worker_cache
from .components import connected_components
from .shingles import WordHashes, shingles

BANDS, ROWS = 26, 5
HASHES = BANDS * ROWS
#: Shingles (8 bytes each) of a block of classes that one task compares with another block. A class counts as a
#: share of 1 / 500 at least, so a block has some 500 classes at most.
BLOCK = 200_000
_rng = np.random.default_rng(5)
_MUL = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_BAND = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def minima(h: np.ndarray) -> np.ndarray:
    """16 bits of the least of each universal hash a x + b (mod 2^64) over the set: middle bits, which stay even for sets of any size."""
    out, step = np.empty(HASHES, np.uint64), max(1, 65536 // len(h))
    for k in range(0, HASHES, step):
        out[k : k + step] = (_MUL[k : k + step, None] * h[None] + _ADD[k : k + step, None]).min(1)
    return (out >> np.uint64(16)).astype(np.uint16)


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of a signature, or of each row of signatures."""
    k = (sig.astype(np.uint64).reshape(*sig.shape[:-1], BANDS, ROWS) * _BAND).sum(-1) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (k ^ (k >> np.uint64(31))).view(np.int64)


def _set_of(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    # bytes.lower() and bytes.split() know ASCII only, and split at its six white spaces
    return shingles(hashes.of((text or b"").lower().split()))


def _class_of(h: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, rk, th (a hash of the text), n_shingles, cid (16 bytes that name the set), bands (null without words)."""
    schema = "doc_id long, rk long, th long, n_shingles long, cid binary, bands array<long>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_cache("words", WordHashes)
        for b in batches:
            found = [_set_of(t, hashes) for t in b.column(3).cast(pa.binary()).to_pylist()]
            keys = [bands(minima(h)) if len(h) else None for h in found]
            cols = [b.column(0), b.column(1), b.column(2), pa.array(map(len, found), pa.int64()), pa.array(map(_class_of, found), pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), row_key().alias("rk"), F.xxhash64("text").alias("th"), "text").mapInArrow(work, schema)


def full_sets(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """cid, n, sig, items (the set) of the rows whose hash of (rk, th) is in the bit table `wanted`; others only by chance."""
    schema, sent = "cid binary, n long, sig binary, items binary", docs.sparkSession.sparkContext.broadcast(wanted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table, seen = worker_cache("words", WordHashes), sent.value, set()
        for b in batches:
            name = b.column(0).to_numpy()
            at = [i for i in np.flatnonzero(in_table(table, name)).tolist() if not (name[i] in seen or seen.add(name[i]))]  # rows that repeat
            found = [h for t in b.column(1).take(pa.array(at, pa.int64())).cast(pa.binary()).to_pylist() if len(h := _set_of(t, hashes))]
            cols = [pa.array(map(_class_of, found), pa.binary()), pa.array(map(len, found), pa.int64()), pa.array((minima(h).tobytes() for h in found), pa.binary()), pa.array((h.tobytes() for h in found), pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["cid", "n", "sig", "items"])

    return docs.select(F.xxhash64(row_key(), F.xxhash64("text")), "text").mapInArrow(work, schema)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _least_equal(percent: int) -> int:
    """Equal signature places that a pair at the least similarity has at least, but for 5 standard deviations."""
    s = percent / 100
    return int(np.floor(HASHES * s - 5 * np.sqrt(HASHES * s * (1 - s))))


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def _alike(percent: int):
    """Of pairs with sizes and signatures, those that may link."""
    least = _least_equal(percent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.column(2).to_numpy(), b.column(3).to_numpy()
            ok = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
            ok &= (_signatures(b.column(4)) == _signatures(b.column(5))).sum(1) >= least
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok))

    return work


def _confirm(percent: int):
    """Of pairs with full sets, the links."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [_linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return work


def _candidates(table: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of one pair of blocks of a bucket: each row with those rows of other labels that may link to it."""
    least, key, lo, hi = _least_equal(percent), table["key"][0].as_py(), table["lo"][0].as_py(), table["hi"][0].as_py()
    sig, size, block = _signatures(table["sig"]), table["n"].to_numpy(), table["block"].to_numpy()
    keys, ids = bands(sig), {}
    label = np.array([ids.setdefault(x, len(ids)) for x in table["label"].to_pylist()])
    band = int(np.flatnonzero(keys[0] == key)[0])
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    for at, i in enumerate(left.tolist()):
        j = right[at + 1 :] if lo == hi else right
        j = j[(label[j] != label[i]) & (100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i]))]
        j = j[(sig[j] == sig[i]).sum(1) >= least]
        j = j[~(keys[j, :band] == keys[i, :band]).any(1)]
        if len(j):
            yield i, j


def _some(percent: int):
    """For one pair of blocks: its rows that have a candidate."""

    def work(table: pa.Table) -> pa.Table:
        hit = np.zeros(len(table), bool)
        for i, j in _candidates(table, percent):
            hit[i] = hit[j] = True
        return table.select(["key", "lo", "hi", "block", "cid", "label"]).filter(pa.array(hit))

    return work


def _join_up(percent: int):
    """For one pair of blocks: links, confirmed on full sets, that join what labels and earlier links have not joined."""

    def work(table: pa.Table) -> pa.Table:
        names, items, found, roots = table["cid"].to_pylist(), [np.frombuffer(x, np.uint64) for x in table["items"].to_pylist()], [], {}
        root = np.array([roots.setdefault(x, len(roots)) for x in table["label"].to_pylist()])
        for i, j in _candidates(table, percent):
            for k in j.tolist():
                if root[k] != root[i] and _linked(items[i], items[k], percent):
                    found.append((names[i], names[k]))
                    root[root == root[k]] = root[i]
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    return work


def _blocks(rest: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """rest (key, cid, label, n) dealt to pairs of blocks: key, cid, label, block, lo, hi, once for each pair that a row is in.

    A label with more than BLOCK shingles in a bucket has blocks of its own, which are not paired with each other;
    the others share blocks. A block holds sizes of one range, and is paired with those of ranges next to it alone.
    """
    step = -math.log(min(percent, 99) / 100) * 1.001  # sizes that may link are less than a whole step apart
    share = rest.groupBy("key", "label").agg(F.sum(F.greatest("n", F.lit(BLOCK // 500))).alias("own"))
    rows = share.filter(F.col("own") <= BLOCK).groupBy("key").agg(F.sum("own").alias("shared"))
    parts = scratch.table(share.join(rows.hint("merge"), "key", "left").select("key", "label", (F.col("own") > BLOCK).alias("alone"), F.ceil(F.when(F.col("own") > BLOCK, F.col("own")).otherwise(F.col("shared")) / BLOCK).alias("parts")))
    seats = rest.withColumn("range", F.floor(F.log("n") / step).cast("int")).join(parts.hint("merge"), ["key", "label"])
    dealt = F.when(F.col("alone"), F.xxhash64("label", F.pmod(F.xxhash64("cid"), F.col("parts")), "range")).otherwise(F.xxhash64(F.lit("shared"), F.pmod(F.xxhash64("label"), F.col("parts")), F.col("range")))
    seats = scratch.table(seats.select("key", "cid", "label", "range", F.when(F.col("alone"), F.col("label")).alias("owner"), dealt.alias("block")))
    other = seats.select(F.col("key").alias("k"), F.col("block").alias("o_block"), F.col("owner").alias("o_owner"), F.col("range").alias("o_range")).distinct()
    meet = (F.col("key") == F.col("k")) & (F.abs(F.col("range") - F.col("o_range")) <= 1) & F.coalesce(F.col("owner") != F.col("o_owner"), F.lit(True))
    out = scratch.table(seats.join(other.hint("merge"), meet).select("key", "cid", "label", "block", F.least("block", "o_block").alias("lo"), F.greatest("block", "o_block").alias("hi")))
    scratch.drop(parts, seats)
    return out


def components(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, rk, th, n_shingles, component, component_id for every row of docs; links have 100 |A and B| >= percent |A or B|.

    component names the component itself, whatever ids it has; it is null without words.
    """
    scratch = Scratch(docs.sparkSession)
    every = scratch.table(sets(docs))
    # one row of each class enters the buckets, however many copies there are
    some = every.filter(F.col("n_shingles") > 0).groupBy("cid")
    classes = scratch.table(some.agg(F.min("doc_id").alias("doc"), F.min(F.struct("rk", "th")).alias("row"), F.first("bands").alias("bands")))
    seats = classes.select("cid", F.explode("bands").alias("key"))
    buckets = seats.groupBy("key").agg(F.count(F.lit(1)).alias("in_bucket")).filter("in_bucket > 1")
    members = scratch.table(seats.join(buckets.hint("shuffle_hash"), "key"))
    hubs = members.groupBy("key").agg(F.min("cid").alias("hub"))
    pairs = members.join(hubs, "key").filter(F.col("cid") != F.col("hub")).select(F.col("cid").alias("a"), F.col("hub").alias("b")).distinct()
    wanted = classes.join(members.select("cid").distinct(), "cid", "left_semi").select(F.xxhash64("row.rk", "row.th").alias("h"))
    full = scratch.table(full_sets(docs, bit_table(wanted)).dropDuplicates(["cid"]))

    def side(name: str, *columns: str) -> DataFrame:
        return full.select(F.col("cid").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))

    def confirmed(may: DataFrame) -> DataFrame:
        both = may.join(side("a", "items"), "a").join(side("b", "items"), "b").select("a", "b", "items_a", "items_b")
        return scratch.table(both.mapInArrow(_confirm(percent), "a binary, b binary"))

    signed = pairs.join(side("a", "n", "sig"), "a").join(side("b", "n", "sig"), "b").select("a", "b", "n_a", "n_b", "sig_a", "sig_b")
    links = confirmed(scratch.table(signed.mapInArrow(_alike(percent), "a binary, b binary")))
    label = connected_components(links, scratch)
    # buckets that still hold several components; in those of two, the one pair is settled
    at = members.filter("in_bucket > 2").join(label.select(F.col("node").alias("cid"), F.col("component").alias("label")), "cid", "left").select("key", "cid", F.coalesce("label", "cid").alias("label"))
    open_ = at.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter(F.col("l0") != F.col("l1")).select("key")
    rest = scratch.table(at.join(open_.hint("merge"), "key").join(full.select("cid", "n"), "cid"))
    dealt = _blocks(rest, percent, scratch)
    some = dealt.join(full.select("cid", "n", "sig"), "cid").groupBy("key", "lo", "hi").applyInArrow(_some(percent), "key long, lo long, hi long, block long, cid binary, label binary")
    some = scratch.table(some)
    more = scratch.table(some.join(full.select("cid", "n", "sig", "items"), "cid").groupBy("key", "lo", "hi").applyInArrow(_join_up(percent), "a binary, b binary"))
    scratch.drop(rest, links, dealt, some)
    first, label = label, connected_components(more.unionByName(label.select(F.col("node").alias("a"), F.col("component").alias("b"))), scratch)
    named = classes.select("cid", "doc").join(label.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    final = scratch.table(named.join(least, "component").select("cid", "component", "component_id"))
    scratch.drop(classes, members, full, more, first, label)
    out = every.select("doc_id", "rk", "th", "n_shingles", "cid").join(final, "cid", "left")
    return out.select("doc_id", "rk", "th", "n_shingles", "component", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def find_documents(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return components(docs, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row of each component (of the least doc_id, nulls last, and of its least text hash), with the columns of docs.

    Rows without words stay, each once for its id and text.
    """
    from pyspark.sql import Window as W

    rows = components(docs, percent).withColumn("none", F.col("doc_id").isNull())
    alone = F.col("component").isNull()
    # a row is named by (none, rk, th): one id may have many texts
    kept = rows.groupBy(*(F.when(~alone, F.col("component")).alias("g0"), *(F.when(alone, F.col(c)).alias(f"g_{c}") for c in ("none", "rk", "th")))).agg(F.min(F.struct("none", "rk", "th")).alias("k"))
    none, rk, th, at = names = spare(docs.columns, "none", "rk", "th", "at")
    found = docs.withColumns({none: F.col("doc_id").isNull(), rk: row_key(), th: F.xxhash64("text")}).join(kept.select(F.col("k.none").alias(none), F.col("k.rk").alias(rk), F.col("k.th").alias(th)), names[:3], "left_semi")
    # rows that repeat id and text: one stays. The join has brought them together already
    return found.withColumn(at, F.row_number().over(W.partitionBy(none, rk, th).orderBy("text"))).filter(F.col(at) == 1).select(*docs.columns)
