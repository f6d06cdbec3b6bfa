import random
from collections import Counter

import pytest

from palimpsest.llm import near_duplicates as nd
from palimpsest.llm.common import Scratch
from palimpsest.llm.components import connected_components

from .brute import near_components

DOCS = "doc_id long, text string, component_id long, rk string"


def check(spark, rows):
    out = nd.find_documents(spark.createDataFrame([(d, t, 1, "x") for d, t in rows], DOCS)).collect()
    want = near_components(rows)
    assert len(out) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


@pytest.mark.parametrize("block", [256, 8])
def test_clusters_of_near_copies(spark, monkeypatch, block):
    """Many copies at all distances of one text, around the limit: most pairs don't link, and no centre links all."""
    monkeypatch.setattr(nd, "BLOCK", block)
    rng = random.Random(4)
    base, rows = [f"w{rng.randrange(10**6)}" for _ in range(150)], []
    for i in range(120):
        w = list(base)
        for k in rng.sample(range(150), rng.randrange(0, 8)):
            w[k] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    chain = [" ".join(base[k : k + 120] + [f"c{k}"] * 3) for k in range(0, 30, 2)]
    check(spark, rows + [(200 + i, t) for i, t in enumerate(chain)])


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a\x0bB"), (6, "a b c"), (7, "É b c d e"), (8, "é b c d e"), (9, "w " * 9000), (10, "w  W w w w"), (11, "a\xa0b c")]
    check(spark, rows)
    twice = spark.createDataFrame([(d, t, 1, "x") for d, t in [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (3, None)]], DOCS)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in nd.find_documents(twice).collect())
    assert got == [("1", 2, "1", True)] * 2 + [("3", 0, "3", True), ("None", 0, "None", True), ("None", 2, "1", False)]
    kept = nd.keep_one(twice)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"] and kept.columns == twice.columns
    assert nd.find_documents(twice.limit(0)).count() == 0


def test_components(spark):
    rng, edges = random.Random(5), [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    edges += [(200 + rng.randrange(60), 200 + rng.randrange(60)) for _ in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    for x in list(parent):
        assert got.get(x, x) == find(x)


def test_one_id_over_many_texts(spark):
    """A repeated id costs no document that is a copy of nothing, and saves no copy."""
    base = [f"w{k}" for k in range(100)]
    near = [" ".join([*base, f"n{k}"]) for k in range(3)]
    other = [f"b{k} c d e f g" for k in range(6)]
    rows = [(3, near[0]), *((5, t) for t in other), (5, near[1]), (5, near[2]), (5, other[0]), (5, None), (5, ""), (42, None), (None, None)]
    want = [(3, near[0]), *((5, t) for t in other), (5, None), (5, ""), (42, None), (None, None)]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], DOCS)
    assert Counter((r.doc_id, r.text) for r in nd.keep_one(docs).collect()) == Counter(want)


def test_near_copies_without_ids(spark):
    base = " ".join(f"w{k}" for k in range(100))
    texts = [f"{base} n{k}" for k in range(3)]
    docs = spark.createDataFrame([(None, t, 1, "x") for t in [*texts, "a b c", "a b c", None]], DOCS)
    got = [r.text for r in nd.keep_one(docs).collect()]
    assert len(got) == 3 and set(got) - set(texts) == {"a b c", None}
