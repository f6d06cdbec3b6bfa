"""Operators against plain versions of themselves, and on rows that used to break them."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import decontamination as dc
from palimpsest.llm import language, licences, near_duplicates, packing, quality, secrets, simhash, urls
from palimpsest.llm.common import Scratch
from palimpsest.llm.queries import tokenizer_path

from .brute import near_components, shingle_set

D = "/root/testdata/sf0.001"


def plain_overlaps(text, item):
    """The best run of touching good windows over all alignments: (start, words, equal) or None."""
    best = None
    size = min(13, len(item))
    need = -(-8 * size // 10)
    for shift in range(size - len(item), len(text) - size + 1):
        lo, hi = max(0, shift), min(len(text), shift + len(item))
        same = [text[i] == item[i - shift] for i in range(lo, hi)]
        if sum(same) < need:
            continue
        good = [s for s in range(len(same) - size + 1) if sum(same[s : s + size]) >= need]
        runs = []
        for s in good:
            if runs and s - runs[-1][-1] <= size:
                runs[-1].append(s)
            else:
                runs.append([s])
        for run in runs:
            at = [i for i in range(run[0], run[-1] + size) if same[i]]
            found = (len(at), -(lo + at[0]), -(at[-1] + 1 - at[0]))
            best = found if best is None else max(best, found)
    return best and (-best[1], -best[2], best[0])


def test_decontamination(spark):
    rng = random.Random(8)
    pool = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(pool) for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14, 20, 40, 60])]
    items += [(90, "x"), (91, "y y"), (92, None), (93, " ,;"), (94, items[14][1]), (94, items[13][1])]
    rows = [(1, None), (2, ""), (3, "x"), (None, items[13][1]), (4, " ".join(["y"] * 40))]
    for d in range(10, 60):
        w = [rng.choice(pool) for _ in range(30)]
        for _ in range(rng.randrange(4)):
            part = rng.choice(items[:16])[1].split()
            part = [x if rng.random() > 0.12 else "other" for x in part]
            at = rng.randrange(len(w))
            w[at:at] = part
        rows.append((d, "; ".join(w).upper()))
    rows.append(rows[-1])
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: [x.decode() for x in dc.words((t or "").encode())]
    for shortest in (1, 5):
        want = {}
        for d, t in rows:
            for i, x in items:
                if len(split(x)) >= shortest and (found := plain_overlaps(split(t), split(x))):
                    want[d, i] = max(want.get((d, i), found), found, key=lambda f: (f[2], -f[0], -f[1]))
        got = {(r.doc_id, r.item_id): (r.start_word, r.n_words, r.n_equal) for r in dc.overlaps(docs, bench, block_words=50, shortest=shortest).collect()}
        assert got == want
        kept = [r.doc_id for r in dc.keep_clean(docs.withColumn("name", F.lit(1)).withColumn("__id", F.lit(2)), bench, shortest).collect()]
        assert Counter(kept) == Counter(d for d, _ in rows if not any(k == d for k, _ in want))


def test_one_id_over_clean_and_leaked_texts(spark):
    item = " ".join(f"b{k}" for k in range(20))
    docs = spark.createDataFrame([(1, "clean words here"), (1, f"now {item}"), (None, "also clean"), (None, item)], "doc_id long, text string")
    assert sorted(r.text for r in dc.keep_clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()) == ["also clean", "clean words here"]


def test_radius_over_thousands(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 62), 1 << 62, (1500, 2))
    flips = base[rng.integers(0, 1500, 1500)].copy()
    for k in range(4):
        at = rng.integers(0, 126, 1500)
        on = rng.random(1500) < 0.8
        flips[np.arange(1500), at // 63] ^= np.where(on, np.int64(1) << (at % 63), 0)
    rows = np.unique(np.concatenate([base, flips]), axis=0)
    a, b = rows[:, 0].view(np.uint64), rows[:, 1].view(np.uint64)
    far = np.bitwise_count(a[:, None] ^ a[None]) + np.bitwise_count(b[:, None] ^ b[None])
    prints = spark.createDataFrame([tuple(map(int, r)) for r in [*rows, *rows[:50]]], "lo long, hi long")
    for radius in (0, 3, 5):
        want = {frozenset((tuple(rows[i]), tuple(rows[j]))) for i, j in zip(*np.nonzero(np.triu(far <= radius, 1)))}
        got = [frozenset(((r.a_lo, r.a_hi), (r.b_lo, r.b_hi))) for r in simhash.within_radius(prints, radius).collect()]
        assert len(got) == len(want) and set(got) == want


def test_fingerprint_search_and_hot_ids(spark):
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[:k] + ["z"] + words[k:])) for k in range(0, 40, 4)] + [(k, "the same text of a few words") for k in (50, 51, None)] + [(7, f"text {k} of one id") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = simhash.fingerprint_documents(docs).collect()
    prints = {int(r.fingerprint, 16) for r in out}
    assert len(out) == len(rows)
    for r in out:
        mine = int(r.fingerprint, 16)
        assert r.n_near == sum(p != mine and (p ^ mine).bit_count() <= 3 for p in prints)
        assert r.class_id == min((x.doc_id for x in out if x.fingerprint == r.fingerprint and x.doc_id is not None), default=None)
    near = simhash.neighbours(docs, 300)
    assert near.filter("doc_id = 7 and not ghost").select("bucket").distinct().count() > 1
    got = Counter((r.doc_id, r.text, r.next_text) for r in near.filter("not ghost").collect())
    after = {d: {n for (x, _, n), _ in got.items() if x == d} for d, _ in rows}
    assert sum(got.values()) == len(rows) and after[51] == {"the same text of a few words"} and after[None] == {rows[12][1]} - {rows[11][1]} | {"the same text of a few words"}


def test_ledger_outlives_its_session_object(spark, tmp_path):
    docs = spark.createDataFrame([(1, "token=aaaaaaaaaa"), (2, "token=aaaaaaaaaa"), (3, None)], "doc_id long, text string")
    ledger = secrets.Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.scan(docs) == 2 * len(secrets.RULES)
    again = secrets.Ledger(spark, str(tmp_path / "ledger"))
    new = docs.unionByName(spark.createDataFrame([(4, "xoxb-0123456789ab sk_live_0123456789abcdef")], docs.schema))
    assert again.scan(docs) == 0 and again.scan(new) == len(secrets.RULES)
    changed = (secrets.Rule("assign", "never", 2), *secrets.RULES[1:])
    out = {r.doc_id: r.spans for r in secrets.scan_documents(new, again).collect()}
    assert out == {1: "assign:0:16", 2: "assign:0:16", 3: "", 4: "vendor:0:17,vendor:18:42"}
    assert {r.spans for r in secrets.scan_documents(new, again, changed).collect()} == {"", "vendor:0:17,vendor:18:42"}
    (tmp_path / "ledger" / "scan-lost" / "pairs").mkdir(parents=True)
    assert secrets.Ledger(spark, str(tmp_path / "ledger")).scan(new) == 0
    stale = secrets.Ledger(spark, str(tmp_path / "ledger"))
    stale.files.names = lambda folder, names=stale.files.names: names(folder)[:1] if folder == "_log" else names(folder)
    with pytest.raises(FileExistsError):
        stale.scan(new)


def test_redaction(spark):
    texts = ["é token=" + "0" * 40 + " passwd=abcdefgh1 tail", "AKIA" + "A" * 16, "no secret", None, "x sk_live_" + "a" * 32 + "é", " ".join(f"token=abcdefgh{k}" for k in range(500))]
    docs = spark.createDataFrame([(k, t, "kept") for k, t in enumerate(texts)], "doc_id long, text string, __at string").withColumnRenamed("__at", "blob")
    got = {r.doc_id: (r.text, r.blob) for r in secrets.redact(docs).collect()}
    assert got == {0: ("é [secret] [secret] tail", "kept"), 1: ("[secret]", "kept"), 2: ("no secret", "kept"), 3: (None, "kept"), 4: ("x [secret]é", "kept"), 5: (" ".join(["[secret]"] * 500), "kept")}


def best_chain(found, gap):
    """Covered tokens of the best chain, by trying all."""
    best = 0
    for i, (start, stop, end) in enumerate(found):
        total = stop - start
        stack = [(i, total)]
        while stack:
            k, n = stack.pop()
            best = max(best, n)
            for j, (a, b, e) in enumerate(found):
                shared = max(0, found[k][1] - a, found[k][2] - (e - (b - a)))
                if a > found[k][0] and e > found[k][2] and shared < b - a and a + shared - found[k][1] <= gap and e - (b - a) + shared - found[k][2] <= gap:
                    stack.append((j, n + b - a - shared))
    return best


def test_licence_chains():
    scanner = licences.Scanner()
    t = max(range(len(scanner.sizes) - len(licences.PHRASES)), key=lambda k: scanner.sizes[k])
    rng = random.Random(6)
    for _ in range(300):
        found = []
        for _ in range(rng.randrange(1, 8)):
            n, start = rng.randrange(4, 12), rng.randrange(40)
            found.append((start, start + n, rng.randrange(n, scanner.sizes[t])))
        found = sorted(set(found))
        out = scanner._chain(t, found)
        most = best_chain(found, scanner.gap)
        assert bool(out) == (most >= scanner.cover * scanner.sizes[t])
        if out:
            assert max(x[3] for x in out) == pytest.approx(min(1, most / scanner.sizes[t]))


def test_licence_templates_cut_by_their_own_words():
    scanner = licences.Scanner()
    for label, text in licences.TEMPLATES:
        w = text.split()
        if len(w) < 20:
            continue
        cut = w[: len(w) // 2] + w[:5] + w[len(w) // 2 :]
        assert label in scanner.scan(" ".join(cut).encode())["labels"].split(",")
        assert label in scanner.scan(" ".join(["zz"] * 3 + w).encode())["labels"].split(",")
    assert licences.Scanner((), (("gplv3", "gpl"),)).scan(b"a gplv3, GPLV3!")["n_base"] == 2


def test_mixture_against_plain_em():
    rng = np.random.default_rng(4)
    for _ in range(20):
        ll = rng.normal(-30, 4, (40, 3))
        share = np.full(3, 1 / 3)
        for _ in range(30):
            rows = [[s * np.exp(x - max(r)) for s, x in zip(share, r)] for r in ll]
            new = np.mean([[p / sum(r) for p in r] for r in rows], 0)
            done, share = np.abs(new - share).max() < 1e-4, new
            if done:
                break
        value = sum(max(r) + np.log(sum(s * np.exp(x - max(r)) for s, x in zip(share, r))) for r in ll)
        got, total = language.em(ll)
        assert np.allclose(got, share, atol=1e-9) and total == pytest.approx(value)
        chosen = language.mixture(ll)
        one = max(ll.sum(0))
        # greedy growth: no single further language is worth its penalty
        kept = sorted(chosen)
        here = language.em(ll[:, kept])[1] if len(kept) > 1 else one
        for k in set(range(3)) - {*kept}:
            assert language.em(ll[:, kept + [k]])[1] - here <= language.PENALTY + 0.5 * np.log(40) + 1e-6


def test_lasso_is_optimal():
    rng = np.random.default_rng(9)
    z = (rng.random((500, 12)) < 0.4).astype(float)
    y = (rng.random(500) < 1 / (1 + np.exp(-(1.5 * z[:, 0] - 2 * z[:, 1] + 0.3)))).astype(float)
    for penalty in (0.002, 0.02):
        w, b = quality.lasso(z, y, penalty, rounds=4000)
        r = 1 / (1 + np.exp(-(z @ w + b))) - y
        slope = z.T @ r / 500
        assert abs(r.mean()) < 1e-5
        assert np.allclose(slope[w != 0], -penalty * np.sign(w[w != 0]), atol=1e-5) and (abs(slope[w == 0]) <= penalty + 1e-5).all()
    assert (w[[0, 1]] != 0).all() and (w == 0).sum() >= 5


def test_rules_against_a_plain_tree():
    """The first rule of a stump is the split of the greatest gain."""
    rng = np.random.default_rng(2)
    x = rng.random((400, 3))
    y = (x[:, 1] > 0.37).astype(float)
    rules = [r for r in quality.grow(x, y, trees=6, depth=1, bins=64) if r[0][0] == 1]
    assert rules and all(abs(r[0][2] - 0.37) < 0.05 for r in rules)


def test_texts_that_are_not_utf8(spark):
    raw = [b"ab \xff cd", b"\xe9t\xe9 tok", b"http://\xffa.net/\xe9", b"fine"]
    docs = spark.createDataFrame([(k, bytearray(t), "en") for k, t in enumerate(raw)], "doc_id long, b binary, lang string").selectExpr("doc_id", "cast(b as string) as text", "lang")
    out = packing.pack_documents(docs, tokenizer_path()).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    assert {r.doc_id: r.length for r in out} == {k: len(t.encode(x.decode("utf-8", "replace"), add_special_tokens=False).ids) + 1 for k, x in enumerate(raw)}
    assert language.identify_documents(docs).count() == 4
    got = {r.page_id: (r.host, r.rule) for r in urls.judge_pages(docs.selectExpr("doc_id as page_id", "text as url")).collect()}
    assert got[2] == ("�a.net", "net/") and got[3] == ("", None)
    assert near_duplicates.find_documents(docs).count() == 4 and secrets.scan_documents(docs).count() == 4 and licences.scan_documents(docs).count() == 4


def test_tokenizer_without_short_cuts(spark, tmp_path):
    with open(tokenizer_path(), encoding="utf-8") as f:
        settings = json.load(f)
    assert packing.has_short_cuts(settings)
    settings["normalizer"] = None
    assert not packing.has_short_cuts(settings) and not packing.has_short_cuts(settings | {"normalizer": packing._SETTINGS["normalizer"], "added_tokens": [{"content": "abc"}]})
    with open(tmp_path / "t.json", "w", encoding="utf-8") as f:
        json.dump(settings, f)
    from tokenizers import Tokenizer

    t, text = Tokenizer.from_file(str(tmp_path / "t.json")), "Some Text, with  Upper Case\nand lines."
    out = packing.pack_documents(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), str(tmp_path / "t.json")).collect()
    assert {r.doc_id: r.length for r in out} == {1: len(t.encode(text, add_special_tokens=False).ids) + 1, 2: 1}


def test_url_rules_may_be_globs(spark):
    rules = (("block", "*.evil.*", "/"), ("allow", "good.evil.io", "/a?c/"), ("block", "shop", "/*/buy"))
    pages = spark.createDataFrame([(1, "http://x.evil.org/q"), (2, "http://good.evil.io/abc/d"), (3, "http://a.shop/x/buy/1"), (4, "http://a.shop/buy"), (5, "http://%53PAM.com:80/")], "page_id long, url string")
    assert {r.page_id: (r.rule, r.verdict) for r in urls.judge_pages(pages, rules).collect()} == {1: ("*.evil.*/", "block"), 2: ("good.evil.io/a?c/", "allow"), 3: ("shop/*/buy", "block"), 4: (None, "allow"), 5: (None, "block")}


def test_pipeline_over_odd_rows(spark, tmp_path):
    """Repeated ids over different texts, null ids, clashing names: what goes is what plain versions say."""
    base = spark.read.parquet(f"{D}/documents.parquet")
    d = str(tmp_path)
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{D}/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
    rows = base.select((F.col("doc_id") % 7).alias("doc_id"), "text").withColumn("doc_id", F.when(F.col("doc_id") != 3, F.col("doc_id"))).withColumn("__rk", F.lit("r")).withColumn("at", F.lit(1)).withColumn("name", F.lit("n"))
    docs, before = rows.cache(), None
    for name, stage in corpus_pipeline.STAGES[:4]:
        columns, before = docs.columns, Counter((r.doc_id, r.text) for r in docs.collect())
        docs = Scratch(spark).table(stage(spark, docs, d))
        assert docs.columns == columns and {(r["__rk"], r["at"], r["name"]) for r in docs.collect()} <= {("r", 1, "n")}
        after = Counter((r.doc_id, r.text) for r in docs.collect())
        if name == "near_duplicates":
            texts = sorted({t or "" for _, t in before})
            where = near_components([*enumerate(texts)], 80)
            group = {t: where[k][1] for k, t in enumerate(texts)}
            full = [(i, t) for i, t in before if shingle_set(t)]
            assert sorted(Counter(group[t or ""] for i, t in after.elements() if shingle_set(t)).items()) == sorted((g, 1) for g in {group[t or ""] for _, t in full})
            assert {(i, t) for i, t in after if not shingle_set(t)} == {(i, t) for i, t in before if not shingle_set(t)}
        if name == "decontamination":
            items = [dc.words(r.text.encode()) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
            grams = {tuple(x[i : i + 13]) for x in items for i in range(len(x) - 12)}
            for i, t in before.elements():
                w = dc.words((t or "").encode())
                assert not ((i, t) in after and any(tuple(w[k : k + 13]) in grams for k in range(len(w) - 12)))
        if name != "secrets":
            assert not after - before
