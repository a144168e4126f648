"""Benchmark decontamination by latent semantic retrieval and checks of the words.

Words are hashed to a fixed number of buckets; in how many of all documents a bucket occurs gives its inverse
frequency.  A randomised SVD of TF-IDF passages gives the latent space: tasks accumulate A'(A Omega) for a random Omega
with more columns than the space has axes, the range of that bounded matrix is found, all passages are projected on it,
and the greatest axes of their covariance are kept and whitened.  The range is fitted on all documents and on the
benchmark, which weighs more.  Every word of every document is counted, fitted and searched.  A text is cut into
overlapping windows of two sizes, windows and benchmark passages are projected, and windows whose cosine with a passage
of their size reaches ``cosine`` are candidates.  Each candidate is checked by the words: a passage is present if the
longest common subsequence covers ``sure`` of the passage, or ``likely`` of it while half of the passage's answer, its
last fifth, occurs too, or if nearly all of its words are there and nearly half of them in its order.

The benchmark is matched in blocks of a fixed number of passages, so no block grows with it.  Null and empty texts and
passages match nothing.  Repeated rows each give their matches.  All columns other than the named ones pass through.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowscope.llm.common import dropped, map_text, raw, slices, stored, texts, words_of
from rowscope.llm.stats import Hasher, mix

BUCKETS = 1 << 16
RANK, OVERSAMPLE = 32, 8
#: Parts in which tasks send the matrix of buckets.
PARTS = 64
BENCHMARK_WEIGHT = 3.0
#: Classes of words by which candidates are counted before they are compared word by word.
CLASSES = 4_096
WIDTH = 64
ITEMS_PER_BLOCK = 4_096
COSINE, PART, LIKELY, SURE = 0.3, 0.2, 0.6, 0.8
#: Of a passage whose order is changed: the least share of its words, and the least share in its order.
WORDS, ORDER = 0.9, 0.4
#: Words a window, words a step, and the most words of the passages matched with it.
SCALES = ((32, 8, 26), (64, 16, 1 << 30))

_FOLD = np.full(256, 32, np.uint8)
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_GAP = np.arange(256) == 32


def tokens(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, words before each text): words are runs of ASCII letters and digits, lowered, and other characters."""
    buf, off = raw(arr)
    low = _FOLD[buf]
    s, e, doc = words_of(low, off, _GAP)
    return mix(Hasher(low).range(s, e) + (e - s).astype(np.uint64)), np.searchsorted(doc, np.arange(len(off)))


def bucket(w: np.ndarray) -> np.ndarray:
    return (w >> np.uint64(48)).astype(np.int64) % BUCKETS


def word_class(w: np.ndarray) -> np.ndarray:
    return (w & np.uint64(CLASSES - 1)).astype(np.int64)


def bucketed(docs: DataFrame, text: str) -> DataFrame:
    """Stored (first, b): the buckets of the words of some texts, two bytes each, and the words before each text."""

    def run(batches):
        for whole in batches:
            for part in slices(whole, text, 1 << 20):
                w, first = tokens(texts(part, text))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (first.astype(np.int64), bucket(w).astype(np.uint16))], names=["first", "b"])

    return stored(docs.select(text).mapInArrow(run, "first binary, b binary"))


def _parts(batches):
    """(words before each text, buckets) of each row of ``bucketed``."""
    for batch in batches:
        for first, b in zip(batch.column("first"), batch.column("b"), strict=True):
            yield np.frombuffer(first.as_buffer(), np.int64), np.frombuffer(b.as_buffer(), np.uint16).astype(np.int64)


def counted(words: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents and places in which each bucket occurs, and the number of documents; a task sends one row a bucket."""

    def run(batches):
        docs, places, n = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), 0
        for first, b in _parts(batches):
            key = np.repeat(np.arange(len(first) - 1), np.diff(first)) << 16 | b
            key.sort()
            new = np.r_[True, key[1:] != key[:-1]][: len(key)]
            docs += np.bincount(key[new] & (BUCKETS - 1), minlength=BUCKETS)
            places += np.bincount(b, minlength=BUCKETS)
            n += len(first) - 1
        own = np.flatnonzero(places)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[own, -1]), pa.array(np.r_[docs[own], n]), pa.array(np.r_[places[own], 0])], names=["b", "d", "p"])

    docs, places, n = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), 0
    for r in words.mapInArrow(run, "b long, d long, p long").groupBy("b").agg(F.sum("d").alias("d"), F.sum("p").alias("p")).collect():
        if r["b"] < 0:
            n = int(r["d"])
        else:
            docs[r["b"]], places[r["b"]] = r["d"], r["p"]
    return docs, places, n


def inverse(counts: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequency, 1 for what occurs nowhere; squared, as passages repeat few of their words."""
    return ((np.log((n + 1) / (counts + 1)) / np.log(n + 2)) ** 2).astype(np.float32)


def _passages(b: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The sums of ``table`` over each WIDTH words, the last filled up with nothing."""
    n = -(-len(b) // WIDTH)
    rows = np.r_[table, np.zeros((1, np.size(table, 1)), table.dtype)]
    return rows.take(np.r_[b, np.full(n * WIDTH - len(b), BUCKETS)], axis=0).reshape(n, WIDTH, -1).sum(1)


def _accumulate(g: np.ndarray, b: np.ndarray, idf: np.ndarray, weighted: np.ndarray) -> None:
    """g += A' (A omega) over passages of WIDTH words; ``weighted`` is omega times the weights, g has a row an axis."""
    if not len(b):
        return
    y = _passages(b, np.c_[weighted, idf**2])
    y = np.ascontiguousarray((y[:, :-1] / np.maximum(1e-6, np.sqrt(y[:, -1:]))).T)
    w = idf[b]
    for axis, own in zip(g, y, strict=True):
        axis += np.bincount(b, np.repeat(own, WIDTH)[: len(b)] * w, minlength=BUCKETS)


def _summed(arrays: DataFrame) -> np.ndarray:
    """The sum of arrays (k: part, x: float32 bytes) that tasks send, part after part."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("k").to_pylist(), b.column("x"), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(x.as_buffer(), np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int64()), pa.array([x.astype(np.float32).tobytes() for x in total.values()], pa.binary())], names=["k", "x"])

    got = arrays.repartition(PARTS, "k").mapInArrow(add, "k long, x binary").collect()
    return np.concatenate([np.frombuffer(r["x"], np.float32) for r in sorted(got, key=lambda r: r["k"])] or [np.zeros(0, np.float32)])


def _sent(total: np.ndarray):
    cut = np.array_split(total.astype(np.float32).ravel(), PARTS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS)), pa.array([x.tobytes() for x in cut], pa.binary())], names=["k", "x"])


def fit(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", rank: int | None = None, more: int | None = None) -> np.ndarray:
    """The projection of each bucket, weighted, centred and whitened over passages: an array of BUCKETS x rank.

    One pass finds the range of A'A on a random Omega of ``rank`` + ``more`` columns, the next projects all passages on
    it; the ``rank`` greatest axes of their covariance are the space.  Passages are each WIDTH words of a task's texts.
    """
    rank, more = rank or RANK, OVERSAMPLE if more is None else more
    words = bucketed(docs, text)
    in_docs, places, n_docs = counted(words)
    idf = inverse(in_docs, n_docs)
    wide = rank + more
    omega = idf[:, None] * np.random.default_rng(11).standard_normal((BUCKETS, wide)).astype(np.float32)

    def gather(batches):
        g = np.zeros((wide, BUCKETS))
        for _, b in _parts(batches):
            _accumulate(g, b, idf, omega)
        yield from _sent(g)

    g = _summed(words.mapInArrow(gather, "k long, x binary"))
    g = g.reshape(wide, BUCKETS) if len(g) else np.zeros((wide, BUCKETS), np.float32)
    own = np.zeros((wide, BUCKETS))
    for block in _blocks(benchmark, text, item):
        w, first = tokens(pa.array([t for _, t in block], pa.large_string()))
        for a, z in zip(first[:-1], first[1:], strict=True):
            _accumulate(own, bucket(w[a:z]), idf, omega)
    g = g / max(1e-9, np.linalg.norm(g)) + (BENCHMARK_WEIGHT * own / max(1e-9, np.linalg.norm(own))).astype(np.float32)
    q, _ = np.linalg.qr(g.T)
    table = (q * idf[:, None]).astype(np.float32)

    def moments(batches):
        total, outer, n = np.zeros(wide), np.zeros((wide, wide)), 0
        for _, b in _parts(batches):
            v = _passages(b, table).astype(np.float64)
            total += v.sum(0)
            outer += v.T @ v
            n += len(v)
        yield from _sent(np.r_[n, total, outer.ravel()] / 1024)  # within the range of float32

    got = _summed(words.mapInArrow(moments, "k long, x binary")).astype(np.float64)
    dropped(words)
    if not len(got) or not got[0]:
        return np.ascontiguousarray(table[:, :rank])
    total, outer = got[1 : 1 + wide] / got[0], got[1 + wide :].reshape(wide, wide) / got[0]
    value, axes = np.linalg.eigh(outer - np.outer(total, total))
    value, axes = value[::-1][:rank], axes[:, ::-1][:, :rank]
    if value[0] <= 0:
        return np.ascontiguousarray(table[:, :rank])
    centre = (places @ table.astype(np.float64) / max(1, places.sum())).astype(np.float32)
    return ((table - centre) @ (axes / np.sqrt(np.maximum(value, 1e-9 * value[0])))).astype(np.float32)


def _blocks(benchmark: DataFrame, text: str, item: str):
    """Lists of (item, text) of about ITEMS_PER_BLOCK rows."""
    rows = benchmark.select(item, F.coalesce(F.col(text), F.lit("")).alias("t")).distinct()
    n = rows.count()
    parts = max(1, -(-n // ITEMS_PER_BLOCK))
    for i in range(parts):
        own = rows if parts == 1 else rows.where(F.pmod(F.xxhash64(item, "t"), F.lit(parts)) == i)
        yield sorted(((r[item], r["t"]) for r in own.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


@dataclass
class Items:
    ids: list
    words: list[np.ndarray]
    masks: list[dict[int, int]]
    scales: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # the item of each vector of a scale, unit vectors and lengths
    size: np.ndarray
    holds: np.ndarray  # whether an item has a word of the class

    @staticmethod
    def of(block: list[tuple], table: np.ndarray) -> Items:
        w, first = tokens(pa.array([t for _, t in block], pa.large_string()))
        words = [w[a:z] for a, z in zip(first[:-1], first[1:], strict=True)]
        masks = []
        for x in words:
            m: dict[int, int] = {}
            for i, v in enumerate(x.tolist()):
                m[v] = m.get(v, 0) | 1 << i
            masks.append(m)
        size = np.array([len(x) for x in words], np.int64)
        low, scales = 0, []
        for width, _, most in SCALES:
            # a passage longer than the window has a vector for each window's length of it, the last up to its end
            own = [(i, a) for i in np.flatnonzero((size > low) & (size <= most)).tolist() for a in sorted({*range(0, max(1, size[i] - width), width), max(0, size[i] - width)})]
            vec = np.array([table[bucket(words[i][a : a + width])].sum(0) for i, a in own], np.float32).reshape(-1, np.size(table, 1))
            norm = np.maximum(1e-9, np.linalg.norm(vec, axis=1))
            scales.append((np.array([i for i, _ in own], np.int64), np.ascontiguousarray((vec / norm[:, None]).T), norm))
            low = most
        holds = np.zeros((len(words), CLASSES), bool)
        holds[np.repeat(np.arange(len(words)), size), word_class(w)] = True
        return Items([i for i, _ in block], words, masks, scales, size, holds)


def lcs(words: list[int], masks: dict[int, int], m: int) -> int:
    """Length of the longest common subsequence, bit-parallel over the passage."""
    full = (1 << m) - 1
    v = full
    for w in words:
        k = masks.get(w)
        if k is not None:
            u = v & k
            v = (v + u | v - u) & full
    return m - v.bit_count()


def search(arr: pa.Array, items: Items, table: np.ndarray, cosine: float, likely: float, sure: float) -> list[dict[int, tuple[float, float, int]]]:
    """For each text, item number -> (share of the passage, cosine, first word of the window) of its best match."""
    w, first = tokens(arr)
    out: list[dict[int, tuple[float, float, int]]] = [{} for _ in range(len(first) - 1)]
    if not len(w):
        return out
    step = min(s for _, s, _ in SCALES)
    count = np.diff(first)
    parts = -(-count // step)  # steps of each text, the last may be short
    cut = np.repeat(first[:-1], parts) + step * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    text_of = np.repeat(np.arange(len(count)), parts)
    # the words of a step, one column after another; past a text's end stands a row of zeros
    rows, b, stop = np.r_[table, np.zeros((1, np.size(table, 1)), np.float32)], np.r_[bucket(w), BUCKETS], first[text_of + 1]
    sums = rows.take(b[cut], axis=0)
    for i in range(1, step):
        sums += rows.take(np.where(cut + i < stop, b[np.minimum(cut + i, len(w))], BUCKETS), axis=0)
    run = np.r_[np.zeros((1, np.size(sums, 1)), np.float64), np.cumsum(sums, axis=0, dtype=np.float64)]
    last_part, classes = np.cumsum(parts)[text_of], word_class(w)
    for (width, stride, _), (own, vectors, norm) in zip(SCALES, items.scales, strict=True):
        if not len(own):
            continue
        k = np.arange(len(cut))
        begin = k[((k - (last_part - parts[text_of])) * step) % stride == 0]
        end = np.minimum(begin + width // step, last_part[begin])
        vec = (run[end] - run[begin]).astype(np.float32)
        length = np.maximum(1e-9, np.linalg.norm(vec, axis=1))[:, None]
        for at in range(0, len(vec), 16_384):
            dot = vec[at : at + 16_384] @ vectors
            # the window must hold enough of the passage's length and point its way
            i, j = np.nonzero(dot >= PART * norm)
            score = dot[i, j] / length[at + i, 0]
            ok = score >= cosine
            i, item, score = begin[at + i[ok]], own[j[ok]], score[ok]
            best = np.lexsort((-score, item, i))  # of several parts of a passage the nearest stands for it
            best = best[np.r_[True, (np.diff(i[best]) != 0) | (np.diff(item[best]) != 0)]] if len(best) else best
            i, item, score = i[best], item[best], score[best]
            m, d = items.size[item], text_of[i]
            pad = np.where(m <= width, 16, m)  # a passage longer than the window is looked for around it
            lo, hi = np.maximum(first[d], cut[i] - pad), np.minimum(first[d + 1], cut[i] + width + pad)
            ok = _shared(classes, lo, hi, items.holds, item) >= likely * m
            for i, item, d, lo, hi, score in zip(*(x[ok].tolist() for x in (cut[i], item, d, lo, hi, score)), strict=True):
                m, mask = int(items.size[item]), items.masks[item]
                near = [x for x in w[lo:hi].tolist() if x in mask]
                if len(near) < likely * m:
                    continue
                share = lcs(near, mask, m) / m
                if share >= sure or share >= likely and _answered(items.words[item], near) or share >= ORDER and _held(mask, near) >= WORDS * m:
                    old = out[d].get(item)
                    if old is None or share > old[0]:
                        out[d][item] = (share, float(score), int(i - first[d]))
    return out


def _shared(classes: np.ndarray, lo: np.ndarray, hi: np.ndarray, holds: np.ndarray, item: np.ndarray) -> np.ndarray:
    """How many words from ``lo`` to ``hi`` are of a class that the item holds: never fewer than its words there."""
    out = np.zeros(len(lo), np.int64)
    most = int((hi - lo).max()) if len(lo) else 1
    rows = max(1, (1 << 20) // most)
    for at in range(0, len(lo), rows):
        own = slice(at, at + rows)
        pos = lo[own, None] + np.arange(most)
        seen = holds[item[own, None], classes[np.minimum(pos, len(classes) - 1)]]
        out[own] = np.count_nonzero(seen & (pos < hi[own, None]), axis=1)
    return out


def _answered(passage: np.ndarray, near: list[int]) -> bool:
    answer = set(passage[-max(3, len(passage) // 5) :].tolist())
    return 2 * len(answer & set(near)) >= len(answer)


def _held(mask: dict[int, int], near: list[int]) -> int:
    """How many of a passage's words occur, each as often as it has it at most."""
    have = Counter(near)
    return sum(min(n, mask[w].bit_count()) for w, n in have.items())


def _matches(docs: DataFrame, table: np.ndarray, block: list[tuple], text: str, item_type: T.DataType, cosine: float, likely: float, sure: float) -> DataFrame:
    """``docs`` and ``__matches``: those of each row with the passages of the block."""
    hit = T.StructType([T.StructField("item", item_type), T.StructField("share", T.DoubleType()), T.StructField("cosine", T.DoubleType()), T.StructField("word", T.LongType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("__matches", T.ArrayType(hit))])
    items = Items.of(block, table)

    def run(batch: pa.RecordBatch) -> dict:
        found = search(texts(batch, text), items, table, cosine, likely, sure)
        return {"__matches": [[{"item": items.ids[i], "share": s, "cosine": c, "word": a} for i, (s, c, a) in sorted(f.items())] for f in found]}

    return map_text(docs, text, run, schema)


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", cosine: float = COSINE, likely: float = LIKELY, sure: float = SURE) -> DataFrame:
    """A row for each document and passage in it: (key, item, lcs_share, cosine, first_word)."""
    table = fit(docs, benchmark, text, item)
    kind = benchmark.schema[item].dataType
    out = None
    for block in _blocks(benchmark, text, item):
        got = _matches(docs.select(key, text), table, block, text, kind, cosine, likely, sure)
        part = got.select(key, F.explode("__matches").alias("m")).select(key, F.col("m.item").alias(item), F.col("m.share").alias("lcs_share"), F.col("m.cosine").alias("cosine"), F.col("m.word").alias("first_word"))
        out = part if out is None else out.unionAll(part)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", cosine: float = COSINE, likely: float = LIKELY, sure: float = SURE) -> DataFrame:
    """The rows of ``docs`` without any passage of the benchmark; columns as they were."""
    table = fit(docs, benchmark, text, item)
    kind = benchmark.schema[item].dataType
    out = docs.withColumnsRenamed({"__matches": "__own_matches"})
    for block in _blocks(benchmark, text, item):
        out = _matches(out, table, block, text, kind, cosine, likely, sure).where(F.size("__matches") == 0).drop("__matches")
    return out.withColumnsRenamed({"__own_matches": "__matches"})
