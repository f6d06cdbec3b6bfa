import random

import pytest

from palimpsest.operators import ranges, stats


def plain(sizes, limit, after, header):
    out, group, filled = [], 0, header
    for i, size in enumerate(sizes):
        if i and (filled > limit if after else filled + size > limit):
            group, filled = group + 1, header
        filled += size
        out.append(group)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_folds_over_ranges(spark, seed):
    rng, rows, want = random.Random(seed), [], {}
    limit = [40, 90, 300][seed]
    for run, n in (("a", 400), ("b", 1), ("c", 57)):
        sizes = [rng.choice([0, 1, 5, 17, 30, 200]) for _ in range(n)]
        rows += [(run, i * 3, s) for i, s in enumerate(sizes)]
        for after in (True, False):
            want |= {(after, run, i * 3): g for i, g in enumerate(plain(sizes, limit, after, 0 if after else stats.BLOCK_HEADER))}
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "r string, i long, size int").repartition(5)
    for at in (None, [], [0, 1, 2, 60, 61, 63, 300, 900, 5000]):
        for after, fold in ((True, stats.memtable_rollover), (False, stats.pack_blocks)):
            got = {(after, r["r"], r["i"]): r["grp"] for r in fold(df, "i", limit, run="r", at=at).collect()}
            assert got == {k: g for k, g in want.items() if k[0] == after}
    assert stats.pack_blocks(df.limit(0), "i", 50).count() == 0


def test_range_of(spark):
    df = spark.createDataFrame([(k,) for k in ["b", "a", "zz", "c", "b", "m", None]], "k string")
    got = {r["k"]: r["n"] for r in df.withColumn("n", ranges.range_of("k", ["b", "c", "n"])).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "m": 2, "zz": 3, None: 0}
    at = ranges.cuts(spark.range(1000), "id", 8)
    assert at == sorted(set(at)) and 5 <= len(at) <= 7


def test_block_index(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (1, 1, "c"), (2, 0, "a")], "run int, grp int, k string")
    got = sorted(map(tuple, stats.block_index(df, ["run", "grp"], "k").collect()))
    assert got == [(1, 0, "a", "b", 2), (1, 1, "c", "c", 1), (2, 0, "a", "a", 1)]
