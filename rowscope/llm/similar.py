"""Exact Jaccard similarity of word shingle sets, for verifying and completing near-duplicate links.

``similar_links`` starts from links that another method proposes (SimHash, see ``simhash``) and completes them: shingles
have one order, rarest first, and two sets that are similar enough share one among the first fifth of both (prefix
filter).  Sets that meet there are tried round by round.  Each round a set tries the set before it and the best linked
set in every bucket that still holds sets of several classes, what is verified is contracted, and once few pairs of
different classes are left, or hardly one try in fifty is a link, all of them are tried.  So a group of near copies costs rows
in proportion to its members, and no pair that can reach the similarity is left out.  Where all are tried, the join of
the buckets compares parities of the sets (512 bits, each different shingle turns one), so pairs of a crowd of texts
that are too different end there, and what is verified follows the pairs that are similar, not the crowd's square.

A pair is first compared by bitmaps, which bound the difference of two sets from below, and then by the sets.  Sets are
of 32-bit hashes; the search is by 64-bit hashes.  A text of fewer words is one shingle; texts without words are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscope.llm.common import dropped, join_small, lower_az, raw, slices, stored, texts, words_of
from rowscope.llm.components import components
from rowscope.llm.stats import Hasher, mix

SEED = 42
#: Classes of shingles by whose counts the shingles are ordered; any order gives the same links.
COUNTERS = 1 << 17
MOST_BITS = 1 << 16
#: Words of 64 bits of a set's parities.
PARITY = [f"p{i}" for i in range(8)]


def shingle_sets(arr: pa.Array, width: int = 5) -> list[np.ndarray]:
    """The distinct hashes of each text's word shingles, ascending; a text of fewer words is one shingle."""
    buf, off = raw(arr)
    low = lower_az(buf)
    s, e, doc = words_of(low, off)
    n = len(off) - 1
    if not len(s):
        return [np.zeros(0, np.uint64)] * n
    word = mix(Hasher(low).range(s, e) + (e - s).astype(np.uint64))
    first = np.searchsorted(doc, np.arange(n + 1))
    out = []
    for i in range(n):
        w = word[first[i] : first[i + 1]]
        k = max(1, len(w) - width + 1)
        h = w[:k].copy()
        for j in range(1, min(width, len(w))):
            h = mix(h * np.uint64(3) + w[j : j + k])
        out.append(np.unique(h))
    return out


def set_name(h: np.ndarray) -> int:
    """One number for a set: equal sets, equal names."""
    x = xxhash.xxh64_intdigest(h.tobytes(), SEED)
    return x - (1 << 64) if x >> 63 else x


def _set_batches(batches, width: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(names, shingle sets) of the rows of (__t), slice by slice; a task gives each set once."""
    seen: set[int] = set()
    for whole in batches:
        for b in slices(whole, "__t"):
            names, sets = [], []
            for h in shingle_sets(texts(b, "__t"), width):
                f = set_name(h)
                if f not in seen:
                    seen.add(f)
                    names.append(f)
                    sets.append(h)
            if names:
                yield np.array(names, np.int64), sets


def shingle_counts(lean: DataFrame, width: int) -> np.ndarray:
    """In how many texts shingles of each of COUNTERS classes occur; a task sends one row a class."""

    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for _, sets in _set_batches(batches, width):
            total += np.bincount((np.concatenate(sets) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["b", "n"])

    out = np.zeros(COUNTERS, np.int64)
    for r in lean.select("__t").mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():
        out[r["b"]] = r["n"]
    return out


def _prefixes(lean: DataFrame, counts: np.ndarray, similarity: float, width: int) -> DataFrame:
    """(v, f, n, i): the rarest shingles v of each set of n shingles, at place i of the order by (count, hash)."""

    def run(batches):
        for fs, sets in _set_batches(batches, width):
            v, f, n, at = [], [], [], []
            for own, h in zip(fs.tolist(), sets, strict=True):
                if not len(h):
                    continue
                most = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1
                order = np.lexsort((h, counts[(h % np.uint64(COUNTERS)).astype(np.int64)]))[:most]
                v.append(h[order])
                f.append(np.full(len(order), own))
                n.append(np.full(len(order), len(h), np.int32))
                at.append(np.arange(len(order), dtype=np.int32))
            if v:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (f, n, at))], names=["v", "f", "n", "i"])

    return lean.select("__t").mapInArrow(run, "v long, f long, n int, i int")


def _may_reach(n, i, m, j, similarity: float):
    """Whether sets of n and m shingles whose first common one is at places i and j can be similar enough (arrays or columns)."""
    least = similarity * (n + m) - 1e-6
    return ((n - i) * (1 + similarity) >= least) & ((m - j) * (1 + similarity) >= least)


def _met(prefixes: DataFrame) -> DataFrame:
    """The rows of ``prefixes`` whose shingle another set has, each (v, f) once."""

    def run(batches):
        held, tied = None, False  # the last row waits for the next one
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
            v, f = (t.column(c).to_numpy() for c in ("v", "f"))
            once = np.r_[True, (v[1:] != v[:-1]) | (f[1:] != f[:-1])]  # tasks that hold equal texts send them each
            at = np.flatnonzero(once)
            same = v[at][1:] == v[at][:-1]
            keep = np.r_[tied, same] | np.r_[same, False]
            keep[-1] = False
            out = t.take(pa.array(at[keep]))
            tied = bool(same[-1]) if len(same) else tied
            held = t.take(pa.array(at[-1:])).combine_chunks().to_batches()[0]
            yield from out.to_batches()
        if held is not None and tied:
            yield held

    n = int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return prefixes.repartition(n, "v").sortWithinPartitions("v", "f").mapInArrow(run, "v long, f long, n int, i int")


def _tries(open_: DataFrame, similarity: float, turn: int) -> DataFrame:
    """Distinct pairs (a, b) of different classes: each set with its bucket's best linked set and with the set before it."""

    def run(batches):
        hub = last = None
        for b in batches:
            if not b.num_rows:
                continue
            v, f, c, n, i = (b.column(x).to_numpy() for x in ("v", "f", "c", "n", "i"))
            rows = np.stack([v, f, c, n, i])
            new = np.r_[True, v[1:] != v[:-1]]
            if hub is not None and hub[0] == v[0]:
                new[0] = False
            at = np.maximum.accumulate(np.where(new, np.arange(len(v)), -1))
            head = rows[:, np.maximum(at, 0)]
            if hub is not None:
                head[:, at < 0] = hub[:, None]
            before = np.c_[rows[:, :1] if last is None else last[:, None], rows[:, :-1]]
            hub, last = head[:, -1], rows[:, -1]
            for other in (head, before):
                ok = (other[0] == v) & (other[2] != c) & _may_reach(n, i, other[3], other[4], similarity)
                if ok.any():
                    pair = np.unique(np.stack([np.minimum(f[ok], other[1][ok]), np.maximum(f[ok], other[1][ok])], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    n = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = open_.repartition(n, "v").sortWithinPartitions("v", F.col("d").desc(), F.xxhash64("f", "v", F.lit(turn)))
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _bitmap(h: np.ndarray) -> bytes:
    size = min(MOST_BITS, max(64, 1 << int(2 * len(h)).bit_length()))
    flag = np.zeros(size, bool)
    flag[(h & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(flag).tobytes()


def _parity(h: np.ndarray) -> np.ndarray:
    """A bit for each residue: whether an odd number of hashes has it.  Two sets differ in as many hashes as bits at least."""
    odd = np.bincount(h % np.uint32(64 * len(PARITY)), minlength=64 * len(PARITY)) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _may_agree(x: str, y: str, similarity: float):
    """Whether sets ``x`` and ``y`` of a join can be similar enough by their sizes and parities."""
    apart = sum((F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))) for p in PARITY[1:]), F.bit_count(F.col(f"{x}.p0").bitwiseXOR(F.col(f"{y}.p0"))))
    return apart <= (F.col(f"{x}.size") + F.col(f"{y}.size")) * ((1 - similarity) / (1 + similarity)) + 1e-6


def _fold(a: np.ndarray, size: int) -> np.ndarray:
    return a if len(a) == size else np.bitwise_or.reduce(a.reshape(-1, size), 0)


def _buffers(b: pa.RecordBatch, name: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint8) for x in b.column(name)]


class Sets:
    """Bitmaps of the wanted sets, stored, and the verification of pairs by them and by the sets that they leave."""

    def __init__(self, lean: DataFrame, one: DataFrame, wanted: DataFrame, width: int, similarity: float):
        self.lean, self.one, self.width, self.similarity = lean, one, width, similarity
        self.table = self._gathered(wanted, False)

    def _gathered(self, wanted: DataFrame, whole: bool) -> DataFrame:
        """(f, n, s) of the wanted names: s is the set or its bitmap, which comes with parities."""
        width = self.width
        parity = [] if whole else PARITY

        def run(batches):
            for fs, sets in _set_batches(batches, width):
                short = [np.unique((h >> np.uint64(32)).astype(np.uint32)) for h in sets]
                s = [x.tobytes() if whole else _bitmap(x) for x in short]
                odd = np.stack([_parity(x) for x in short]) if parity else np.zeros((len(short), 0))
                yield pa.RecordBatch.from_arrays([pa.array(fs), pa.array([len(x) for x in short], pa.int32()), pa.array(s, pa.binary()), *(pa.array(odd[:, i]) for i in range(len(parity)))], names=["f", "n", "s", *parity])

        rows = stored(wanted.join(self.one, "f").select("__key", "__text"))
        out = stored(join_small(self.lean, rows, ["__key", "__text"], "left_semi", 1_000_000).select("__t").mapInArrow(run, ", ".join(["f long, n int, s binary", *(f"{p} long" for p in parity)])))
        if out.count() > rows.count():  # repeated rows in different tasks
            out, many = stored(out.dropDuplicates(["f"])), out
            dropped(many)
        dropped(rows)
        return out

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the stored pairs (a, b) that are similar enough."""
        similarity = self.similarity
        share = similarity / (1 + similarity)

        def bound(batches):
            for b in batches:
                n, m = (b.column(x).to_numpy().astype(np.int64) for x in ("n0", "n1"))
                least = share * (n + m) - 1e-6
                keep = []
                for k, (x, y) in enumerate(zip(_buffers(b, "s0"), _buffers(b, "s1"), strict=True)):
                    size = min(len(x), len(y))
                    x, y = _fold(x, size), _fold(y, size)
                    if np.bitwise_count(x & ~y).sum(dtype=np.int64) <= n[k] - least[k] and np.bitwise_count(y & ~x).sum(dtype=np.int64) <= m[k] - least[k]:
                        keep.append(k)
                yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))

        def exact(batches):
            for b in batches:
                keep = []
                for k, (x, y) in enumerate(zip(_buffers(b, "s0"), _buffers(b, "s1"), strict=True)):
                    x, y = x.view(np.uint32), y.view(np.uint32)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    both = len(x) + len(y) - common
                    if not both or common >= similarity * both - 1e-9:
                        keep.append(k)
                yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))

        def joined(left: DataFrame, table: DataFrame) -> DataFrame:
            for k, of in enumerate("ab"):
                left = left.join(table.select(F.col("f").alias(of), F.col("n").alias(f"n{k}"), F.col("s").alias(f"s{k}")), of)
            return left

        near = stored(joined(pairs, self.table).mapInArrow(bound, "a long, b long"))
        sets = self._gathered(near.select(F.col("a").alias("f")).unionAll(near.select(F.col("b").alias("f"))).distinct(), True)
        out = stored(joined(near, sets).mapInArrow(exact, "a long, b long"))
        dropped(near, sets)
        return out


def _several(classed: DataFrame) -> tuple[DataFrame, int]:
    """(v, major): buckets of several classes and the class with most sets in each; and the pairs of different classes."""
    sizes = classed.groupBy("v", "c").agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("k"))
    g = sizes.groupBy("v").agg(F.max_by("c", F.struct("k", "c")).alias("major"), F.count(F.lit(1)).alias("kinds"), ((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).cast("double").alias("pairs"))
    got = stored(g.where("kinds > 1"))
    return got, int(got.agg(F.sum("pairs")).first()[0] or 0)


def similar_links(lean: DataFrame, one: DataFrame, proposed: DataFrame, similarity: float, width: int = 5) -> DataFrame:
    """(f, c) for the sets that have links: c is the class.  Each link is verified by the exact Jaccard similarity.

    ``lean``: (__key, __text, __t) rows; ``one``: (f, __key, __text), a row of each set; ``proposed``: pairs (a, b).
    """
    met = stored(_met(_prefixes(lean, shingle_counts(lean, width), similarity, width)))
    first = stored(proposed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    wanted = met.select("f").unionAll(first.select(F.col("a").alias("f"))).unionAll(first.select(F.col("b").alias("f"))).distinct()
    sets = Sets(lean, one, wanted, width, similarity)
    links = sets.verified(first)
    dropped(first)
    known = stored(components(links).withColumnsRenamed({"node": "f", "root": "c"}))
    found, tried, turn, last = 1, 0, 0, False
    while True:
        degree = links.select(F.explode(F.array("a", "b")).alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("d"))
        told = known.join(degree, "f", "left")
        classed = stored(met.join(told, "f", "left").withColumns({"c": F.coalesce("c", "f"), "d": F.coalesce("d", F.lit(0))}))
        several, pairs = _several(classed)
        if last or not pairs:
            dropped(classed, several)
            break
        open_ = stored(classed.join(several.select("v"), "v", "left_semi"))
        last = 50 * found <= tried or pairs <= 2 * open_.count()
        if last:
            # of each pair one set at least is not of the bucket's greatest class
            marks = sets.table.select("f", F.col("n").alias("size"), *PARITY)
            crowd = stored(open_.join(several.select("v", "major"), "v").join(marks, "f"))
            x, y = crowd.where("c <> major").alias("x"), crowd.alias("y")
            reach = _may_reach(F.col("x.n"), F.col("x.i"), F.col("y.n"), F.col("y.i"), similarity)
            met2 = x.join(y, (F.col("x.v") == F.col("y.v")) & (F.col("x.c") != F.col("y.c")) & ((F.col("y.c") == F.col("y.major")) | (F.col("x.f") < F.col("y.f"))) & reach & _may_agree("x", "y", similarity))
            tries = stored(met2.select(F.least("x.f", "y.f").alias("a"), F.greatest("x.f", "y.f").alias("b")).distinct())
            dropped(crowd)
        else:
            tries = stored(_tries(open_, similarity, turn))
        new = sets.verified(tries)
        found, tried, turn = new.count(), tries.count(), turn + 1
        if found:
            links, old = stored(links.unionAll(new)), links
            known, was = stored(components(links).withColumnsRenamed({"node": "f", "root": "c"})), known
            dropped(old, was)
        dropped(tries, new, classed, several, open_)
    dropped(sets.table, met, links)
    return known
