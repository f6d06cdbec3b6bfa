"""Benchmark decontamination by spaced seeds.

A seed is a mask laid on a run of words; the words under its ones are hashed, the others may differ. Hashes
of benchmark items and of documents that agree give an alignment of the two texts, which is then verified
word by word: a window of 13 words (or the whole of a shorter item) is good if at least 80 % of its words are
equal, and an overlap is a run of good windows that touch, without unequal words at its ends. The masks find
every window of 13 words with up to two substitutions; a shorter item is sought by runs of as many equal
words as it must have somewhere, so nothing that is good is missed.

Both sides' seeds are joined by an exchange, whatever their number. A bit table of bounded size keeps those
of documents back that no item has; what passes travels in segments, word hashes around the hits alone.

Words are lower-cased runs without ASCII punctuation. Null texts have no words. Items of fewer than
`shortest` words are not searched (by default 5; 1 searches all). Repeated rows give their overlaps once for
each (doc_id, item_id). Ids may be null; empty tables give an empty result. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bit_table, in_table, spare, worker_cache
from .shingles import PLACE, WordHashes, mixed

WINDOW, PERCENT, SHORTEST = 13, 80, 5
# Two masks that find 13 words with two substitutions anywhere.
MASKS = ("11101011", "11001111")
#: Words of the benchmark in one partition of it.
BLOCK_WORDS = 500_000
#: Hits at most so many words apart are in one segment: windows that touch have theirs nearer to each other.
REACH = 2 * WINDOW
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def least_equal(size: int) -> int:
    """Equal words that make a window of this size good."""
    return -(-PERCENT * size // 100)


def masks_for(n: int) -> tuple[str, ...]:
    """The masks for an item of n words."""
    if n >= WINDOW:
        return MASKS
    bad = n - least_equal(n)
    return ("1" * -(-(n - bad) // (bad + 1)),)


def seeds(w: np.ndarray, mask: str) -> np.ndarray:
    """The seed hash at each start of the mask in w."""
    n = len(w) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, int(mask, 2), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            h = h + w[k : k + n] * PLACE[16 + k]
    return mixed(h)


def overlap(w: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """Start in w, length and equal words of the best overlap where the item's first word lies at w[shift]."""
    lo, hi, size = max(0, shift), min(len(w), shift + len(item)), min(WINDOW, len(item))
    if hi - lo < size:
        return None
    equal = np.concatenate(([0], np.cumsum(w[lo:hi] == item[lo - shift : hi - shift])))
    good = np.flatnonzero(equal[size:] - equal[:-size] >= least_equal(size))
    best = None
    for run in np.split(good, np.flatnonzero(np.diff(good) > size) + 1) if len(good) else ():
        start, stop = int(run[0]), int(run[-1]) + size
        same = start + np.flatnonzero(np.diff(equal[start : stop + 1]))
        start, stop = int(same[0]), int(same[-1]) + 1
        found = (lo + start, stop - start, int(equal[stop] - equal[start]))
        if best is None or found[2] > best[2]:
            best = found
    return best


def _item_words(shortest: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_cache("words", WordHashes)
        for b in batches:
            rows = [(i, hashes.of(words(t))) for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist())]
            rows = [(i, w) for i, w in rows if len(w) >= max(1, shortest)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([len(w) for _, w in rows], pa.int64()), pa.array([w.tobytes() for _, w in rows], pa.binary())], ["item_id", "n", "words"])

    return work


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for item, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            w = np.frombuffer(raw, np.uint64)
            for mask in masks_for(len(w)):
                h = seeds(w, mask)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), item, np.int64)), pa.array(np.arange(len(h)))], ["h", "item", "item_at"])


def _segments(sent, masks: list[str]):
    names = ["doc_id", "name", "start", "words", "h", "at"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hashes = sent.value, worker_cache("words", WordHashes)
        for b in batches:
            rows = []
            for doc, name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
                w = hashes.of(words(text))
                found = [(np.flatnonzero(in_table(table, h)), h) for h in (seeds(w, m) for m in masks)]
                at = np.concatenate([i for i, _ in found]) if found else np.empty(0, np.int64)
                if not len(at):
                    continue
                h, order = np.concatenate([x[i] for i, x in found]), np.argsort(at, kind="stable")
                at, h = at[order], h[order]
                for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > REACH) + 1):
                    start = max(0, int(at[part[0]]) - WINDOW)
                    rows.append((doc, name, start, w[start : int(at[part[-1]]) + 2 * WINDOW].tobytes(), h[part].view(np.int64), at[part] - start))
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    return work


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of doc_id, name, item_id, start, shift, words of a segment, words of an item: the overlaps."""
    names = ["doc_id", "name", "item_id", "start_word", "n_words", "n_equal"]
    for b in batches:
        keep, rows = [], []
        for k, (start, shift, w, item) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3, 7)))):
            if found := overlap(np.frombuffer(w, np.uint64), np.frombuffer(item, np.uint64), shift):
                keep.append(k)
                rows.append((start + found[0], found[1], found[2]))
        cols = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(keep, pa.int64())) for c in range(3)), *(pa.array(c, pa.int64()) for c in cols)], names)


def _found(docs: DataFrame, benchmark: DataFrame, block_words: int, shortest: int) -> DataFrame:
    """docs has doc_id, name (binary), text; the overlaps of each of its rows, with doc_id and name."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = benchmark.select(F.col("item_id").cast("long"), "text").filter("text is not null").distinct()
    size = texts.agg(F.sum(F.octet_length("text") / 5).alias("n")).first()["n"] or 0
    items = texts.repartition(max(1, int(-(-size // block_words)))).mapInArrow(_item_words(shortest), "item_id long, n long, words binary")
    items = scratch.table(items.withColumn("item", F.monotonically_increasing_id()))
    masks = sorted({m for r in items.select(F.least("n", F.lit(WINDOW)).alias("n")).distinct().collect() for m in masks_for(r["n"])})
    sought = scratch.table(items.select("item", "words").mapInArrow(_item_seeds, "h long, item long, item_at long"))
    sent = spark.sparkContext.broadcast(bit_table(sought.select("h")))
    held = docs.select(F.col("doc_id").cast("long"), "name", "text").mapInArrow(_segments(sent, masks), "doc_id long, name binary, start long, words binary, h array<long>, at array<long>")
    held = scratch.table(held.withColumn("segment", F.monotonically_increasing_id()))
    hits = held.select("segment", F.explode(F.arrays_zip("h", "at")).alias("x")).select("segment", "x.h", "x.at").join(sought.hint("shuffle_hash"), "h")
    lain = hits.select("segment", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    both = lain.join(held.select("segment", "doc_id", "name", "start", F.col("words").alias("w")), "segment").join(items.select("item", "item_id", "words").hint("shuffle_hash"), "item")
    return both.select("doc_id", "name", "item_id", "start", "shift", "w", "words").mapInArrow(_verify, "doc_id long, name binary, item_id long, start_word long, n_words long, n_equal long")


def overlaps(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, item_id, start_word, n_words, n_equal, similarity: the best overlap of each document and item that has
    one, that of the most equal words, then the first. Rows with one id, and items of one id, are taken together."""
    found = _found(docs.select("doc_id", F.lit(None).cast("binary").alias("name"), "text"), benchmark, block_words, shortest)
    best = F.max(F.struct("n_equal", (-F.col("start_word")).alias("back"), (-F.col("n_words")).alias("short"))).alias("b")
    one = found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("b.back")).alias("start_word"), (-F.col("b.short")).alias("n_words"), "b.n_equal")
    return one.withColumn("similarity", F.col("n_equal") / F.col("n_words"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """The documents without an overlap, with their columns. A row is named by its id and a digest of its text."""
    name, id_ = spare(docs.columns, "name", "id")
    digest = F.unhex(F.md5("text"))
    found = _found(docs.select("doc_id", digest.alias("name"), "text"), benchmark, BLOCK_WORDS, shortest)
    flagged = Scratch(docs.sparkSession).table(found.select(F.col("doc_id").alias(id_), F.col("name").alias(name)).distinct())
    same = (F.col("doc_id").cast("long").eqNullSafe(F.col(id_))) & (digest == F.col(name))
    return docs.join(flagged.hint("merge"), same, "left_anti")
