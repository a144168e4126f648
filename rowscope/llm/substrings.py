"""Exact removal of repeated byte strings by a distributed prefix-free parse.

Rolling-hash triggers: of the 48-byte grams in each 200-byte window the one with the least hash is its trigger, so a
window's trigger depends on its content alone and equal windows have equal triggers.  A phrase is a maximal run of
windows with one trigger; phrases overlap by the window length, so none is a prefix of another of the same trigger.
The dictionary holds the distinct phrases with their counts, the parse is each text's sequence of phrases.

A window repeats if and only if an equal window of the same trigger exists elsewhere.  A trigger found once clears all
windows of its phrase; a phrase found twice marks all of them.  Phrases that one text repeats are marked there, as runs,
and stand in the dictionary once for the text, with their count.  What is left, phrases found once whose trigger is
shared, is refined: blocks of 16 windows are compared by the 185 bytes that their windows have in common, and blocks
that share those are compared window by window, from the 30 bytes around them.  Only equality at depth 200 is needed,
so hash classes of the dictionary and the parse stand in for their suffix arrays and no total order of the corpus, and
no task that holds it, is ever built.

Every count is combined on the map side and every join back reads stored tables, so AQE can split hot keys.  What counts
as equal agrees in 128 bits of two independent hashes.  Null texts are empty; a text of under 200 bytes loses nothing; matches never cross texts; repeated rows
are copies of each other and lose all that 200-byte windows cover.  Long texts are parsed in segments, whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowscope.llm.common import dropped, map_text, raw, slices, stored, texts
from rowscope.llm.stats import Hasher, mix

LENGTH = 200
GRAM = 48
BLOCK = 16
SEGMENT = 8 << 20
#: Windows of a span; its place and its length share a number.
MOST = 0xFFFF
_LOW = np.uint64(0xFFFFFF)


def parse(buf: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Phrases of concatenated texts: (first window, number of windows, trigger position, trigger hash, two phrase hashes)."""
    n = len(buf)
    if n < length:
        z, u = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return z, z, z, u, u, u
    h = Hasher(buf)
    g = mix(h.grams(gram))
    # the least gram hash of each window, the rightmost of equal ones
    m = (g & ~_LOW) | (_LOW - np.arange(len(g), dtype=np.uint64))
    width, have = length - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        m = np.minimum(m[: len(m) - step], m[step:])
        have += step
    at = (_LOW - (m & _LOW)).astype(np.int64)
    cross = np.zeros(n + 1, np.int32)  # windows that begin in one text and end in another
    np.add.at(cross, np.maximum(0, off[1:-1] - length + 1), 1)
    np.add.at(cross, off[1:-1], -1)
    ok = np.cumsum(cross[: len(at)]) == 0
    edge = np.zeros(len(at), bool)
    edge[off[off < len(at)]] = True
    new = np.r_[True, at[1:] != at[:-1]] | ~ok | np.r_[True, ~ok[:-1]] | edge
    first = np.flatnonzero(new & ok)
    ends = np.flatnonzero(np.r_[new[1:], True])
    last = ends[np.searchsorted(ends, first)]
    t = at[first]
    place = ((t - first) * 1_000_003 + (last - first)).astype(np.uint64)
    return first, last - first + 1, t, g[t], mix(h.range(first, last + length) + mix(place)), mix(Hasher(buf, True).range(first, last + length) + place)


def _pieces(arr: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, rows, position of the first byte): texts together, and long texts in overlapping segments."""
    buf, off = raw(arr)
    size = np.diff(off)
    if not len(size) or size.max() <= SEGMENT:
        yield buf, off, np.arange(len(size)), 0
        return
    for i, n in enumerate(size):
        for a in range(0, max(1, n - LENGTH + 1), SEGMENT):
            part = buf[off[i] + a : off[i] + min(n, a + SEGMENT + LENGTH - 1)]
            yield part, np.array([0, len(part)]), np.array([i]), a


def phrases(arr: pa.Array) -> tuple[np.ndarray, ...]:
    """(row, packed place, trigger hash, two phrase hashes) of a batch's phrases.  place: window << 16 | windows - 1 << 8 | trigger offset."""
    out = []
    for buf, off, rows, base in _pieces(arr):
        first, n, t, a, c, c2 = parse(buf, off)
        doc = np.searchsorted(off, first, side="right") - 1
        out.append((rows[doc], (first - off[doc] + base) << 16 | (n - 1) << 8 | (t - first), a, c, c2))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _key(text: str) -> F.Column:
    return F.xxhash64(F.col("__id"), F.coalesce(F.col(text), F.lit("")))


def _found_again(row: np.ndarray, a: np.ndarray, c: np.ndarray, c2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first occurrences, how often each is in its text, occurrences of phrases that their own text repeats)."""
    order = np.lexsort((c2, c, a, row))  # stable: places stay in order
    new = np.arange(len(row)) == 0
    for x in (row, a, c, c2):
        new[1:] |= x[order[1:]] != x[order[:-1]]
    at = np.flatnonzero(new)
    times = np.diff(np.r_[at, len(row)])
    return order[at], times, np.sort(order[np.repeat(times, times) > 1])


def _runs(row: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, window << 16 | windows) of the phrases ``p``, in the order of their texts, those that follow each other in one."""
    start, end = p >> 16, (p >> 16) + ((p >> 8) & 255) + 1
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (start[1:] != end[:-1])][: len(p)])
    start, end = start[new], end[np.r_[new[1:], len(p)][: len(new)] - 1]
    parts = -((start - end) // MOST)
    first = np.repeat(start, parts) + MOST * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    return np.repeat(row[new], parts), first << 16 | np.minimum(MOST, np.repeat(end, parts) - first)


def _phrase_table(docs: DataFrame, places: bool) -> DataFrame:
    """Each text's different phrases, how often it holds them (``m``) and a place; m = 0: its runs of those held twice, under one's trigger."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, "__t"):
                row, p, *hashes = phrases(texts(b, "__t"))
                own, m, twice = _found_again(row, *hashes)
                cols, names = [*(x[own].view(np.int64) for x in hashes), m], ["a", "c", "c2", "m"]
                if places:
                    of, run = _runs(row[twice], p[twice])
                    trigger = hashes[0][twice].view(np.int64)[np.searchsorted(row[twice], of)]
                    none = np.zeros(len(of), np.int64)
                    cols = [np.r_[x, y] for x, y in zip(cols, (trigger, none, none, none), strict=True)]
                    cols, names = [*cols, b.column("k").to_numpy()[np.r_[row[own], of]], np.r_[p[own], run]], [*names, "k", "p"]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=names)

    return docs.mapInArrow(run, "a long, c long, c2 long, m long" + ", k long, p long" * places)


def _shared(df: DataFrame, keys: list[str], kinds: list, times: str = "1") -> DataFrame:
    """(keys, many): keys found two ``times`` or more, and whether their rows are of more than one kind."""
    ends = [f(k).alias(f"{n}{i}") for i, k in enumerate(kinds) for n, f in (("x", F.min), ("y", F.max))]
    g = df.groupBy(*keys).agg(F.expr(f"sum({times})").alias("n"), *ends)
    return stored(g.where("n > 1").select(*keys, F.expr(" or ".join(f"x{i} <> y{i}" for i in range(len(kinds)))).alias("many")))


def _block_table(docs: DataFrame, fine: DataFrame) -> DataFrame:
    """Blocks of the phrases ``fine`` (k, p): hash of the common bytes, the 30 bytes around them, text key and place."""
    lists = fine.groupBy("k").agg(F.collect_set("p").alias("ps"))
    joined = docs.join(lists, "k").select("k", "__t", "ps")
    j_max = (LENGTH - GRAM) // BLOCK + 1

    def run(batches):
        for whole in batches:
            for b in slices(whole, "__t"):
                buf, off = raw(texts(b, "__t"))
                ps = b.column("ps")
                row = np.repeat(np.arange(len(b)), ps.value_lengths().to_numpy())
                p = ps.flatten().to_numpy()
                s0, n, to = p >> 16, ((p >> 8) & 255) + 1, p & 255
                t = s0 + to
                h, h2 = Hasher(buf), Hasher(buf, True)
                pad = np.r_[np.zeros(BLOCK, np.uint8), buf, np.zeros(BLOCK, np.uint8)]
                for j in range(j_max):
                    # windows of this block have the trigger BLOCK * j + x bytes in, x from lo to hi
                    lo, hi = np.maximum(0, to - n + 1 - BLOCK * j), np.minimum(BLOCK - 1, to - BLOCK * j)
                    own = np.flatnonzero(lo <= hi)
                    if not len(own):
                        continue
                    at = off[row[own]] + t[own] - BLOCK * j
                    core = mix(h.range(at, at + LENGTH - BLOCK + 1) + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
                    core2 = mix(h2.range(at, at + LENGTH - BLOCK + 1) + np.uint64(j + 1))
                    near = at[:, None] + np.r_[np.arange(-BLOCK + 1, 0), LENGTH - BLOCK + 1 + np.arange(BLOCK - 1)] + BLOCK
                    around = pad[np.clip(near, 0, len(pad) - 1)]
                    place = (t[own] - BLOCK * j) << 8 | lo[own] << 4 | hi[own]
                    flat = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(np.arange(0, around.size + 1, np.size(around, 1), dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(around))])
                    yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(core2.view(np.int64)), flat, b.column("k").take(pa.array(row[own])), pa.array(place)], names=["core", "core2", "around", "k", "p"])

    return joined.mapInArrow(run, "core long, core2 long, around binary, k long, p long")


def _windows(batches):
    """(window hash, second hash, k, window) from blocks: hashes of the common bytes and of the fifteen that differ, as they are."""
    for b in batches:
        around = np.frombuffer(b"".join(b.column("around").to_pylist()), np.uint8).reshape(len(b), 2 * BLOCK - 2)
        core, core2, k, p = (b.column(c).to_numpy() for c in ("core", "core2", "k", "p"))
        lo, hi = (p >> 4) & 15, p & 15
        for x in range(BLOCK):
            own = np.flatnonzero((lo <= x) & (x <= hi))
            rest = np.zeros((len(own), BLOCK), np.uint8)
            rest[:, : BLOCK - 1] = around[own, BLOCK - 1 - x : 2 * BLOCK - 2 - x]
            rest[:, BLOCK - 1] = x
            half = rest.view("<u8")  # all bytes that differ inside a block, in two numbers
            w, w2 = mix(core[own].view(np.uint64)) ^ mix(half[:, 0] * np.uint64(3)), mix(core2[own].view(np.uint64)) ^ mix(half[:, 1] + np.uint64(1))
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(k[own]), pa.array((p[own] >> 8) - x)], names=["w", "w2", "k", "s"])


def repeated(docs: DataFrame) -> list[DataFrame]:
    """Stored tables (k, s, n): windows s to s + n - 1 of text k also start elsewhere.  ``docs`` has k and __t."""
    shared = _shared(_phrase_table(docs, False), ["a"], [F.col("c"), F.col("c2")], "m")
    found = stored(_phrase_table(docs, True).join(shared, "a"))
    many = found.where("many and m > 0")
    # a place of each phrase comes with its count, so only those found more often are looked up again; what a text itself
    # repeats is in its runs
    counts = stored(many.groupBy("a", "c", "c2").agg(F.sum("m").alias("n"), F.min("k").alias("k"), F.min_by("p", "k").alias("p")))
    again = many.where("m = 1").join(counts.where("n > 1"), ["a", "c", "c2"], "left_semi")
    whole = found.where("not many and m = 1").select("k", "p").unionAll(again.select("k", "p"))
    spans = whole.select("k", F.shiftright("p", 16).alias("s"), (F.shiftright("p", 8).bitwiseAND(F.lit(255)) + 1).alias("n"))
    runs = found.where("m = 0").select("k", F.shiftright("p", 16).alias("s"), F.col("p").bitwiseAND(F.lit(MOST)).alias("n"))
    spans = stored(spans.unionAll(runs))
    dropped(shared, found)
    # a phrase found once, and one of each found more often, may share windows with other phrases of its trigger
    blocks = stored(_block_table(docs, counts.select("k", "p")))
    cores = _shared(blocks, ["core", "core2"], [F.xxhash64("around"), F.hash("around")])
    met = stored(blocks.join(cores, ["core", "core2"]).select("core", "core2", "around", "k", "p", "many"))
    dropped(counts, blocks, cores)
    sure = met.where("not many").select("k", (F.shiftright("p", 8) - F.col("p").bitwiseAND(F.lit(15))).alias("s"), (F.col("p").bitwiseAND(F.lit(15)) - F.shiftright("p", 4).bitwiseAND(F.lit(15)) + 1).alias("n"))
    sure = stored(sure.where("n > 0"))
    windows = stored(met.where("many").select("core", "core2", "around", "k", "p").mapInArrow(_windows, "w long, w2 long, k long, s long"))
    twice = stored(windows.groupBy("w", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w", "w2"))
    single = stored(windows.join(twice, ["w", "w2"]).select("k", "s", F.lit(1).cast("long").alias("n")))
    dropped(met, windows, twice)
    return [spans, sure, single]


def cut(data: bytes, starts: np.ndarray, counts: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of ``data``, and the removed spans, if windows starts[i] to starts[i] + counts[i] - 1 repeat."""
    n = len(data)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + counts - 1 + LENGTH, -1)
    gone = np.cumsum(change[:n]) > 0
    turn = np.flatnonzero(np.diff(np.r_[False, gone, False]))
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), list(zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True))


def _with_spans(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with ``__ws``: packed spans of repeated windows (null: none)."""
    base = docs.withColumn("__id", F.col(key).cast("string"))
    lean = base.select(_key(text).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    parts = repeated(lean)
    spans = parts[0].unionAll(parts[1]).unionAll(parts[2])
    packed = stored(spans.groupBy("k").agg(F.collect_set(F.shiftleft("s", 16).bitwiseOR(F.col("n"))).alias("__ws")))
    dropped(*parts)
    return base.withColumn("__k", _key(text)).join(packed.withColumnRenamed("k", "__k"), "__k", "left").drop("__k", "__id")


def _cut_rows(batch: pa.RecordBatch, text: str) -> Iterator[tuple[bytes, bytes, list[tuple[int, int]]]]:
    for t, ws in zip(texts(batch, text), batch.column("__ws"), strict=True):
        data = t.as_buffer().to_pybytes() if t.as_buffer() is not None else b""
        w = ws.values.to_numpy() if ws.is_valid else np.zeros(0, np.int64)
        yield (data, *cut(data, w >> 16, w & 0xFFFF))


def dedup_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, spans)."""
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    fields = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()), ("spans", span)]
    rows = _with_spans(docs.select(key, text), key, text)
    schema = T.StructType([docs.schema[key], *(T.StructField(n, t) for n, t in fields)])

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n: [] for n, _ in fields}
        for data, left, spans in _cut_rows(batch, text):
            for n, v in zip(out, (len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest(), [{"start": a, "stop": b} for a, b in spans]), strict=True):
                out[n].append(v)
        return out

    return map_text(rows, text, run, schema)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated strings cut out of the text; all rows and columns stay, also rows left empty.

    A cut inside a character drops the character's other bytes too.
    """
    rows = _with_spans(docs, key, text)

    def run(batch: pa.RecordBatch) -> dict:
        return {text: pa.array([left.decode("utf-8", "ignore") for _, left, _ in _cut_rows(batch, text)], pa.string())}

    return map_text(rows, text, run, docs.schema)
