"""Language identification by multilingual mixture inference.

Each language is a distribution over hashed character trigrams, counted over all documents that may teach.
A document is a mixture: its trigrams, in blocks, are drawn from languages in unknown proportions, which
expectation-maximisation estimates from the blocks' likelihoods. The set of languages grows greedily while
the log-likelihood gains more than a penalty for each further language; the largest share is the answer.

A null text, or one without a letter, is `und` with score 0, and so is everything when nothing can be
learned. Bytes that aren't UTF-8 count as U+FFFD, which is no letter. Texts are read whole. Repeated rows give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, readable, small_batches

BUCKETS = 1 << 15
BLOCK = 32
PENALTY = 8.0
#: The model has a row of BUCKETS numbers for each language, and comes to the driver: more languages than `most` (0.25 GB of counts) are an error.
MAX_LANGUAGES = 2000
_A, _B = np.uint32(2654435761), np.uint32(2246822519)
_LOW = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)


def trigrams(text: str) -> np.ndarray:
    """Buckets of the trigrams of the lower-cased text with one space at both ends; ASCII other than letters counts as space."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    low = c < 128
    c = np.where(low, _LOW[np.where(low, c, 0)], c)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c = c[keep]
    h = (c[:-2] * _A + c[1:-1]) * _B + c[2:]
    h ^= h >> np.uint32(15)
    return (h * _A) >> np.uint32(32 - 15)


def learn(docs: DataFrame, most: int = MAX_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """The languages and their log-probabilities (languages x BUCKETS), from text and lang of docs."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), readable(b.column(1)).to_pylist()):
                total[lang] = total.get(lang, 0) + np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    taught = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    if docs.filter(F.col("lang").isNotNull()).select("lang").distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} languages")
    counts = taught.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    names = sorted(set(table["lang"].to_pylist()))
    n = np.zeros((len(names), BUCKETS))
    index = {x: i for i, x in enumerate(names)}
    n[[index[x] for x in table["lang"].to_pylist()], table["bucket"].to_numpy()] = table["n"].to_numpy()
    n += 0.5
    return names, np.log(n / n.sum(1, keepdims=True)).astype(np.float32)


def em(likelihood: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Proportions of the columns' languages and the log-likelihood of blocks (rows of log-likelihoods)."""
    top = likelihood.max(1, keepdims=True)
    p = np.exp(likelihood - top)
    share = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(rounds):
        r = p * share
        r /= r.sum(1, keepdims=True) + 1e-300
        new = r.mean(0)
        if np.abs(new - share).max() < 1e-4:
            share = new
            break
        share = new
    return share, float((top[:, 0] + np.log((p * share).sum(1) + 1e-300)).sum())


def mixture(blocks: np.ndarray, penalty: float = PENALTY) -> dict[int, float]:
    """The chosen languages (column numbers) with their proportions."""
    best = blocks.argmax(1)
    if (best == best[0]).all():
        return {int(best[0]): 1.0}
    single = blocks.sum(0)
    chosen, shares, value = [int(single.argmax())], np.ones(1), float(single.max())
    while len(chosen) < blocks.shape[1]:
        tries = [(em(blocks[:, chosen + [k]]), k) for k in set(best.tolist()) - set(chosen)]
        if not tries:
            break
        (new, ll), k = max(tries, key=lambda x: x[0][1])
        if ll - value <= penalty + 0.5 * np.log(len(blocks)):
            break
        chosen, shares, value = chosen + [k], new, ll
    return dict(zip(chosen, shares.tolist()))


def infer(text: str | None, names: list[str], logp: np.ndarray) -> tuple[str, float, str]:
    """lang_pred, its proportion, and all proportions as text."""
    if not names or text is None or not any(map(str.isalpha, text)):
        return "und", 0.0, ""
    g = trigrams(text)
    blocks = np.add.reduceat(logp[:, g], np.arange(0, len(g), BLOCK), axis=1, dtype=np.float64).T
    shares = mixture(blocks)
    lang = max(shares, key=lambda k: (shares[k], -k))
    return names[lang], min(1.0, max(0.0, shares[lang])), ",".join(f"{names[k]}:{shares[k]:.3f}" for k in sorted(shares, key=shares.get, reverse=True))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score, mixture for each document."""
    names, logp = model
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [infer(t, names, logp) for t in readable(b.column(1)).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), pa.string())))], ["doc_id", "lang_pred", "score", "mixture"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, lang_pred string, score double, mixture string")


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, mixture; learns from rows whose crc32(doc_id) mod 4 is not 2. A null id teaches nothing and isn't held out."""
    held = F.coalesce(id_crc() % 4 == 2, F.lit(False))
    model = learn(docs.filter(id_crc() % 4 != 2))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "mixture")
