import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import packing
from palimpsest.llm.queries import tokenizer_path

D = "/root/testdata/sf0.001"


def expected(rows, capacity=2048):
    from tokenizers import Tokenizer

    t, out = Tokenizer.from_file(tokenizer_path()), set()
    for doc, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out.add((doc, k, at, len(part), zlib.crc32(part.tobytes())))
    return out


def check(out, rows, capacity=2048):
    got = out.collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == expected(rows, capacity)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs), sum(r.length for r in got)


def test_documents(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    n, total = check(packing.pack_documents(docs.repartition(7), tokenizer_path()), [(r.doc_id, r.text) for r in docs.collect()])
    assert n <= 1.01 * total / 2048 + 3  # each of the small groups leaves some room


@pytest.mark.parametrize("room", [1, 8, 20])
def test_rounds_over_many_groups(spark, monkeypatch, room):
    monkeypatch.setattr(packing, "GROUP", 20)
    sizes = spark.range(0, 300, 1, 9).select(F.col("id").alias("doc_id"), (1 + F.pmod(F.xxhash64("id"), F.lit(60))).alias("length"))
    got = packing.pack(sizes, 64, room, fan_in=2).collect()
    assert sorted((r.doc_id, r.length) for r in got) == sorted((r.doc_id, r.length) for r in sizes.collect())
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(o == sum(x for p, x in s if p < o) for s in seqs.values() for o, _ in s) and all(sum(x for _, x in s) <= 64 for s in seqs.values())


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (4, "x" * 50), (4, "x" * 50), (5, "wörd, ÉTÉ!! Σ ~ İ \x1c K " * 900), (6, "<|endoftext|>")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length long")
    check(packing.pack_documents(docs, tokenizer_path()), rows)
    assert packing.pack_documents(docs.limit(0), tokenizer_path()).count() == 0
    ids = packing.tokenize(docs.filter("doc_id = 5"), tokenizer_path(), with_ids=True).orderBy("piece").collect()
    from tokenizers import Tokenizer

    assert np.frombuffer(b"".join(bytes(r.ids) for r in ids), "<u4").tolist() == Tokenizer.from_file(tokenizer_path()).encode(rows[5][1], add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("heavy, bins", [(60, 901), (58, 900)])
def test_small_bins_of_many_groups_meet(spark, monkeypatch, heavy, bins):
    """Nine partitions of 100 heavy bins, and one item of 5 each that heavy bins of 60 of 64 can't take."""
    monkeypatch.setattr(packing, "GROUP", 500)
    small = F.col("id") % 101 == 100
    sizes = spark.range(0, 909, 1, 9).select(F.col("id").alias("doc_id"), F.when(small, 5).otherwise(heavy).alias("length").cast("long"))
    got = packing.pack(sizes, 64, 1, fan_in=2).collect()
    assert len(got) == 909 and len({r.sequence_id for r in got}) == bins
