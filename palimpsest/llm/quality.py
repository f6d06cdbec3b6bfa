"""Quality classifier: a sparse rule ensemble over statistics of the text, compiled to Spark columns.

Small boosted trees give paths; every path from a root is a rule, a conjunction of bounds on statistics.
A logistic model with an L1 penalty picks and weighs few of the rules, and the survivors become one
column expression: 1 / (1 + exp(-(bias + sum of weights of the rules that hold))).

Statistics come from the whole text and nothing else. The model is fitted on a bounded sample of labelled
rows (`sample`, the least hashes of doc_id); statistics and scores cover all rows.

Null and empty texts have statistics 0 and a score like any other. Without labels of both classes the
score is the share of label 1 (0.5 without any label). Repeated rows score alike; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_crc, small_batches

STATS = (
    "log_bytes", "log_words", "word_bytes", "longest", "distinct", "top_word", "upper", "capital_words", "digit", "space", "newline",
    "other", "stop", "comma", "odd", "odd_words", "alone", "dup_lines", "line_words", "repeat",
)
PREFIX = "__quality_"
SAMPLE = 20_000
_KIND = np.zeros(256, np.int64)
for _c in range(256):
    _s = chr(_c)
    _KIND[_c] = 1 if _s in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 2 if _s in "0123456789" else 3 if _s in " \t\r\v\f" else 4 if _s == "\n" else 5 if _c >= 128 else 6 if _s in ".!?" else 7 if _s in ",;:'\"-()" else 8 if 32 < _c < 127 and not _s.isalnum() else 0


def statistics(text: bytes) -> list[float]:
    """One number for each name in STATS."""
    n = len(text)
    if not n:
        return [0.0] * len(STATS)
    by = np.bincount(_KIND, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=9)
    words = text.split()
    w = max(len(words), 1)
    counts: dict[bytes, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    lines = [x for x in text.split(b"\n") if x]
    letters = max(by[0] + by[1] + by[5], 1)
    odd = sum(k for x, k in counts.items() if not (x[-1:].isalnum() or x[-1] >= 128 or x[-1:] in b".,;:'\")-"))
    alone = sum(k for x, k in counts.items() if len(x) == 1 and not x.isalnum() and x[0] < 128)
    capital = sum(k for x, k in counts.items() if len(x) > 2 and x.isupper())
    again = sum(a == b for a, b in zip(words, words[1:]))
    return [
        np.log1p(n), np.log1p(len(words)), (n - by[3] - by[4]) / w, np.log1p(max(map(len, words), default=0)), len(counts) / w, max(counts.values(), default=0) / w, by[1] / letters, capital / w, by[2] / n, by[3] / n, by[4] / n,
        by[5] / n, by[6] / w, by[7] / w, by[8] / w, odd / w, alone / w, 1 - len(set(lines)) / max(len(lines), 1), np.log1p(w / max(len(lines), 1)), again / w,
    ]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a double column for each statistic, named with PREFIX; other columns pass through untouched."""
    names, at = docs.columns, docs.columns.index(text)
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([statistics(t or b"") for t in b.column(at).cast(pa.binary()).to_pylist()], np.float64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(rows[:, i]) for i in range(len(STATS)))], [*names, *(PREFIX + s for s in STATS)])

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, *(T.StructField(PREFIX + s, T.DoubleType()) for s in STATS)]))


@dataclass
class Model:
    """Rules are tuples of (statistic, '<=' or '>', bound)."""

    bias: float = 0.0
    rules: list[tuple[tuple[tuple[int, str, float], ...], float]] = field(default_factory=list)

    def column(self, prefix: str = PREFIX) -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = None
            for i, side, bound in rule:
                c = F.col(prefix + STATS[i])
                c = c <= bound if side == "<=" else c > bound
                holds = c if holds is None else holds & c
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            total += weight * _holds(rule, x)
        return 1 / (1 + np.exp(-total))


def _holds(rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for i, side, bound in rule:
        out &= x[:, i] <= bound if side == "<=" else x[:, i] > bound
    return out


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, seed: int = 7) -> list[tuple]:
    """Paths of boosted trees for the logistic loss, each fitted to half of the rows and statistics."""
    rng, margin, rules = np.random.default_rng(seed), np.zeros(len(x)), {}
    cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1])) for i in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], 1)

    def split(rows: np.ndarray, path: tuple, columns: np.ndarray) -> None:
        if path:
            rules.setdefault(path, None)
        g, h = grad[rows], hess[rows]
        best = (1e-6, -1, -1)
        if len(path) < depth and len(rows) >= 40:
            whole = g.sum() ** 2 / (h.sum() + 1)
            for i in columns:
                if not len(cuts[i]):
                    continue
                left_g = np.bincount(code[rows, i], g, len(cuts[i]) + 1).cumsum()[:-1]
                left_h = np.bincount(code[rows, i], h, len(cuts[i]) + 1).cumsum()[:-1]
                size = np.bincount(code[rows, i], minlength=len(cuts[i]) + 1).cumsum()[:-1]
                gain = left_g**2 / (left_h + 1) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1) - whole
                gain[(size < 10) | (len(rows) - size < 10)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), int(i), k)
        if best[1] < 0:
            margin[_rows_of(path)] += rate * g.sum() / (h.sum() + 1)
            return
        _, i, k = best
        low = code[rows, i] <= k
        split(rows[low], (*path, (i, "<=", float(cuts[i][k]))), columns)
        split(rows[~low], (*path, (i, ">", float(cuts[i][k]))), columns)

    def _rows_of(path: tuple) -> np.ndarray:
        return _holds(path, x)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        rows = np.flatnonzero(rng.random(len(x)) < 0.5)
        split(rows, (), rng.permutation(x.shape[1])[: max(1, x.shape[1] // 2)])
    return list(rules)


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of least mean logistic loss + penalty x sum of |weights|, by accelerated proximal steps."""
    n, k = z.shape
    w = v = np.zeros(k)
    b = c = float(np.log(y.mean() / (1 - y.mean())))
    u = np.ones(k)  # the largest eigenvalue of Z'Z / n bounds the curvature
    for _ in range(20):
        u = z.T @ (z @ (u / np.linalg.norm(u))) / n
    step, t = 1 / (0.25 * (np.linalg.norm(u) + 1)), 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(z @ v + c))) - y
        new = v - step * (z.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        bias, t2 = c - step * r.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t2 * (new - w), bias + (t - 1) / t2 * (bias - b)
        w, b, t = new, bias, t2
    return w, b


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 5e-4) -> Model:
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Model(float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    rules = grow(x, y)
    z = np.stack([_holds(r, x) for r in rules], 1).astype(np.float64) if rules else np.zeros((len(x), 0))
    spread = z.std(0)
    rules, z = [r for r, s in zip(rules, spread) if s > 0], z[:, spread > 0]
    w, b = lasso(z, y, penalty)
    keep = np.flatnonzero(np.abs(w) > 1e-6)
    return Model(float(b), [(rules[i], float(w[i])) for i in keep])


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits on at most `sample` labelled rows, those with the least hashes of doc_id among rows whose crc32(doc_id) mod 5 isn't 0.

    Where ids repeat, a doc_id and label count once, with the text of the least hash.
    """
    chosen = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (id_crc() % 5 != 0)).select("doc_id", F.col(label).alias("__label")).distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "__label").limit(sample)
    # at most `sample` rows of a long and an int: a bounded broadcast
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "__label"))
    # the statistics alone are exchanged and come to the driver
    one = rows.groupBy("doc_id", "__label").agg(F.min(F.struct(F.xxhash64("text").alias("th"), *(PREFIX + s for s in STATS))).alias("s"))
    table = one.select("__label", *(F.col(f"s.{PREFIX}{s}") for s in STATS)).toArrow()
    x = np.stack([table[PREFIX + s].to_numpy() for s in STATS], 1) if table.num_rows else np.zeros((0, len(STATS)))
    y = table["__label"].to_numpy().astype(float)
    order = np.lexsort([*x.T, y])  # the same model however the rows arrive
    return fit(x[order], y[order])


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = learn(docs, labels)
    scored = with_statistics(docs.select("doc_id", "text")).withColumn("score", model.column())
    return scored.select("doc_id", F.coalesce(id_crc() % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that score at least the threshold, with their columns."""
    return with_statistics(docs).filter(learn(docs, labels).column() >= threshold).select(*docs.columns)
