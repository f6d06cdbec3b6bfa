import corpus_pipeline
from palimpsest.llm import near_duplicates

from .brute import near_components

D = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, D).cache()
        if name == "packing":
            assert {r.doc_id for r in docs.collect()} == set(before)
            break
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(after) and set(after) <= set(before)
        if name == "near_duplicates":
            want = near_components([(d, r.text) for d, r in before.items()])
            assert set(after) == {d for d, (_, c) in want.items() if d == c}
        if name == "secrets":
            assert set(after) == set(before) and not any("token = \"0" in r.text for r in after.values())
        else:
            assert all(after[d] == before[d] for d in after)
        seen[name] = len(after)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    assert 0 < seen["decontamination"] <= seen["near_duplicates"] <= seen["quality"] < 1000 and labels
    assert near_duplicates.BANDS == 26


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and "sequence_id" in out.columns
