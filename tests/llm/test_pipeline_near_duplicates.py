import corpus_pipeline

from .brute import near_components, shingle_set


def test_links_from_eighty_percent(spark):
    """Pairs of 0.80 and 0.84 link in the stage, one just below 0.80 doesn't."""
    rows = []
    for n, size in enumerate([80, 105, 79]):  # shingles in common; 10 more of each text alone
        shared = [f"w{n}.{k}" for k in range(size + 4)]
        rows += [(10 * n + m, " ".join(shared + [f"x{n}.{m}.{k}" for k in range(10)])) for m in range(2)]
    like = lambda a, b: len(shingle_set(a) & shingle_set(b)) / len(shingle_set(a) | shingle_set(b))
    assert [like(rows[k][1], rows[k + 1][1]) for k in (0, 2, 4)] == [0.8, 0.84, 79 / 99]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
    assert got == {d for d, (_, c) in near_components(rows, 80).items() if d == c} == {0, 10, 20, 21}
