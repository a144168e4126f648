"""Quality rules: gradient-boosted trees over document statistics, scored from flat node arrays.

Fixed base rules reject short and repetitive texts; a boosted model, trained here on a bounded sample of labelled rows,
judges the rest.  Trees are grown on quantile bins with Newton leaf values; chosen features are held monotone by
refusing splits against the direction and by passing the middle of a split down as a bound on the leaves below.  The
model is flattened into arrays (feature, threshold, children, value) and all rows walk a tree level by level.

Input columns with the names of results give way to these.  Null and empty texts have no words and fail the base rules.  Without labels of both classes the model keeps every
text that passes the base rules.  Equal texts get equal verdicts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowscope.llm.common import map_text, stored, texts
from rowscope.llm.stats import FEATURES, features, measure

SAMPLE_ROWS = 20_000
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "bang_rate": -1}


@dataclass
class Trees:
    """Flat trees: node i of all trees; leaves have feature -1 and point to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                low = x[rows, np.maximum(f, 0)] <= self.threshold[at]
                at = np.where(low, self.left[at], self.right[at])
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, lam: float = 1.0, least: float = 8.0) -> Trees:
    n, k = len(x), np.size(x, 1)
    if not n or y.min() == y.max():
        z = np.zeros(1, np.int64)
        return Trees(np.array([-1]), np.zeros(1), z, z, np.zeros(1), np.zeros(0, np.int64), 1, 4.0 if not n or y.max() > 0 else -4.0)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    b = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], 1)
    bias = float(np.log(y.mean() / (1 - y.mean())))
    m = np.full(n, bias)
    nodes: list[list] = []
    roots = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, lo: float, hi: float) -> int:
        me = len(nodes)
        G, H = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-G / (H + lam), lo, hi))
        nodes.append([-1, 0.0, me, me, value * rate])
        if level == depth or len(rows) < 2 * least:
            m[rows] += value * rate
            return me
        best = (1e-6, -1, 0, 0.0)
        for j in range(k):
            if not len(cuts[j]):
                continue
            gs = np.cumsum(np.bincount(b[rows, j], g[rows], len(cuts[j]) + 1))[:-1]
            hs = np.cumsum(np.bincount(b[rows, j], h[rows], len(cuts[j]) + 1))[:-1]
            vl, vr = np.clip(-gs / (hs + lam), lo, hi), np.clip(-(G - gs) / (H - hs + lam), lo, hi)
            gain = gs**2 / (hs + lam) + (G - gs) ** 2 / (H - hs + lam) - G**2 / (H + lam)
            gain[(hs < least / 8) | (H - hs < least / 8) | ((vr - vl) * signs[j] < 0)] = 0
            c = int(gain.argmax())
            if gain[c] > best[0]:
                best = (gain[c], j, c, (vl[c] + vr[c]) / 2)
        if best[1] < 0:
            m[rows] += value * rate
            return me
        _, j, c, mid = best
        low = b[rows, j] <= c
        lb = (lo, mid) if signs[j] > 0 else (mid, hi) if signs[j] < 0 else (lo, hi)
        rb = (mid, hi) if signs[j] > 0 else (lo, mid) if signs[j] < 0 else (lo, hi)
        left = grow(rows[low], g, h, level + 1, *lb)
        right = grow(rows[~low], g, h, level + 1, *rb)
        nodes[me][:4] = [j, float(cuts[j][c]), left, right]
        return me

    every = np.arange(n)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-m))
        roots.append(grow(every, p - y, np.maximum(p * (1 - p), 1e-6), 0, -np.inf, np.inf))
    f, t, left, right, v = map(np.array, zip(*nodes, strict=True))
    return Trees(f, t, left, right, v, np.array(roots), depth, bias)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, key: str = "doc_id") -> DataFrame:
    """At most ``rows`` labelled documents, chosen by a hash of the key; one label a key, and of documents that share a key one.

    The join's small side has at most ``rows`` rows.
    """
    picked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias(label))
    picked = stored(picked.orderBy(F.xxhash64(key), key).limit(rows))
    found = docs.drop(label).join(F.broadcast(picked), key)
    if found.select(key).count() <= picked.count():
        return found
    others = [c for c in found.columns if c != key]
    return found.groupBy(key).agg(F.min(F.struct(*others)).alias("__x")).select(key, "__x.*")


def stats_rows(docs: DataFrame, text: str, *carry: str) -> DataFrame:
    """The model's features of each row, with the ``carry`` columns."""
    schema = T.StructType([*(docs.schema[c] for c in carry), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batch: pa.RecordBatch) -> dict:
        x = features(measure(texts(batch, text)))
        return {"x": pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, np.size(x, 1), dtype=np.int32)), pa.array(x.ravel()))}

    return map_text(docs.select(*carry, text), text, run, schema)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS) -> Trees:
    got = stats_rows(labelled_sample(docs.select("doc_id", text), labels, label, rows), text, label).toPandas()
    x = np.array(got["x"].tolist()).reshape(len(got), len(FEATURES))
    y = got[label].to_numpy(float)
    order = np.lexsort([*x.T, y])  # the same model however the rows arrive
    return fit_trees(x[order], y[order], np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def apply_rules(docs: DataFrame, model: Trees, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """All columns but the text, with the statistics, the base verdict, the model's score and the verdict."""
    new = [(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    new += [("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("score", T.DoubleType())]
    taken = {n for n, _ in new}
    keep = [c for c in docs.columns if c != text and c not in taken]
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(n, t) for n, t in new)])

    def run(batch: pa.RecordBatch) -> dict:
        m = measure(texts(batch, text))
        p = model.probability(features(m))
        failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        return {c: m[c] for c, _ in new[:5]} | {"base_failed": failed, "kept": ~failed & (p >= threshold), "score": p}

    return map_text(docs.select(*keep, text), text, run, schema)
