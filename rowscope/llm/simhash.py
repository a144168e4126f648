"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits share a word at distance r or less from both.  Every distinct
fingerprint emits all variants within half the radius; equal variants meet after a shuffle.  All members of one
variant's bucket lie within the full radius of each other, so a bucket of any size is linked by a chain of its members
instead of all their pairs, no link between different fingerprints is lost, and each emitted edge is verified by its
bit count.  A radius-2 ball has 2,081 variants, so a first round removes fingerprints that have no partner: two
fingerprints within 4 bits agree within 2 in one 32-bit half, hence share a variant within 1 of that half (66 rows a
fingerprint).  In a bucket of a half all members are compared whole with each other, up to a size beyond which all go on
to the full balls, so what accidental agreement of halves brings together at scale goes no further.  Components come
from alternating large-star and small-star steps over tables in the shared folder.

Equal texts share a fingerprint and collapse before anything is emitted, so groups of copies cost one row.  Null texts
are empty; a text without words has fingerprint zero and is linked like any other.  A null doc_id takes part but is
never the name of a component with other ids.  Repeated rows keep their row each.  Whole texts are read.

``keep_one`` deduplicates by Jaccard similarity of five-word shingle sets (0.8 or more).  Ball hashing over fingerprints
of the sets proposes links; each is verified on the sets, and ``similar`` finds the links that fingerprints miss.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowscope.llm import similar
from rowscope.llm.common import dropped, lower_az, map_text, raw, stored, texts, words_of
from rowscope.llm.components import components
from rowscope.llm.stats import mix

SEED = 42
RADIUS = 4


def _signature(hashes: np.ndarray) -> int:
    n = len(hashes)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    on = 2 * bits.sum(0, dtype=np.int64) > n
    return int(np.packbits(on, bitorder="little").view("<u8")[0])


def fingerprints(arr: pa.Array, width: int = 4) -> np.ndarray:
    """Unsigned 64-bit fingerprints of the texts' word shingles, repeats included."""
    buf, off = raw(arr)
    low = lower_az(buf)
    s, e, doc = words_of(low, off)
    n = len(off) - 1
    out = np.zeros(n, np.uint64)
    if not len(s):
        return out
    # the words joined by single spaces, text after text
    size = e - s
    start = np.cumsum(size + 1) - (size + 1)
    joined = np.full(int(start[-1] + size[-1] + 1), 32, np.uint8)
    src = np.repeat(s - start, size) + (fill := np.arange(size.sum()) + np.repeat(np.arange(len(s)), size))
    joined[fill] = low[src]
    data = memoryview(joined.tobytes())
    first = np.searchsorted(doc, np.arange(n + 1))
    digest = xxhash.xxh64_intdigest
    a, b = start.tolist(), (start + size).tolist()
    for i in range(n):
        lo, hi = int(first[i]), int(first[i + 1])
        if hi == lo:
            continue
        k = max(1, hi - lo - width + 1)
        last = min(width, hi - lo) - 1
        out[i] = _signature(np.fromiter((digest(data[x:y], SEED) for x, y in zip(a[lo : lo + k], b[lo + last : lo + last + k], strict=True)), np.uint64, k))
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", width: int = 4, keep_text: bool = False) -> DataFrame:
    """The columns of ``docs`` (the text only if asked) and the fingerprint as a signed long."""
    keep = [f for f in docs.schema.fields if f.name != out and (keep_text or f.name != text)]
    schema = T.StructType([*keep, T.StructField(out, T.LongType())])
    return map_text(docs.drop(out), text, lambda b: {out: fingerprints(texts(b, text), width).view(np.int64)}, schema)


def ball(bits: int, radius: int) -> list[int]:
    """All words of ``bits`` bits with at most ``radius`` bits set, as signed longs."""
    masks, layer = [0], [0]
    for _ in range(radius):
        layer = [m | 1 << i for m in layer for i in range(m.bit_length(), bits)]
        masks += layer
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _masks(values: list[int]):
    return F.array(*[F.lit(v).cast("long") for v in values])


def _runs(emitted: DataFrame) -> DataFrame:
    """(v, f) with equal v next to each other: one shuffle and a sort that spills."""
    n = int(emitted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return emitted.repartition(n, "v").sortWithinPartitions("v", "f")


#: Members of a run of equal variants that are compared each with each; of longer runs all are candidates.
CROWD = 64


def _close(batches, radius: int):
    """Fingerprints with another of their run within ``radius`` bits, and all of a run of over CROWD, batch by batch."""
    v0, f0 = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        v, f = np.r_[v0, b.column("v").to_numpy()], np.r_[f0, b.column("f").to_numpy()]
        bits, hit = f.view(np.uint64), np.zeros(len(v), bool)
        at = np.arange(len(v))
        for s in range(1, CROWD + 1):
            at = at[: np.searchsorted(at, len(v) - s)]
            at = at[v[at] == v[at + s]]
            if not len(at):
                break
            d = np.bitwise_count(bits[at] ^ bits[at + s])
            near = at[(d > 0) & (d <= radius)]
            hit[near] = hit[near + s] = True
        if len(at):
            change = np.zeros(len(v) + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + CROWD + 1, -1)
            hit |= np.cumsum(change[:-1]) > 0
        yield np.unique(f[hit])
        v0, f0 = v[-CROWD:], f[-CROWD:]


def _neighbours(batches):
    """Pairs of different fingerprints that are next to each other in a run, batch by batch."""
    last = None
    for b in batches:
        v, f = (b.column(c).to_numpy() for c in ("v", "f"))
        if not len(v):
            continue
        pv, pf = np.r_[v[:1], v[:-1]], np.r_[f[:1], f[:-1]]
        if last is not None:
            pv[0], pf[0] = last
        last = v[-1], f[-1]
        same = (v == pv) & (pf != f)
        yield np.unique(np.stack([pf[same], f[same]], 1), axis=0)


def candidates(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Of distinct fingerprints ``f``, all that have another within ``radius`` bits, and few that have none.

    Those that have one agree with it in a half within ``radius`` // 2 bits, so they meet in a variant of that half.
    """
    masks = _masks(ball(32, (radius // 2 + 1) // 2))
    low = F.col("f").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("f", 32).bitwiseOR(F.lit(1 << 32))  # a bit of its own tells the halves apart
    halves = fps.select("f", F.explode(F.array(low, high)).alias("h")).select("f", "h", F.explode(masks).alias("m"))

    def members(batches):
        for own in _close(batches, radius):
            yield pa.RecordBatch.from_arrays([pa.array(own)], names=["f"])

    return _runs(halves.select(F.col("h").bitwiseXOR(F.col("m")).alias("v"), "f")).mapInArrow(members, "f long").distinct()


def edges(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct verified links (a < b) that connect whatever fingerprints within ``radius`` of each other connect."""
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = fps.repartition(n)  # each row becomes thousands
    emitted = dealt.select("f", F.explode(_masks(ball(64, radius // 2))).alias("m")).select(F.col("f").bitwiseXOR(F.col("m")).alias("v"), "f")

    def chain(batches):
        for pair in _neighbours(batches):
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    linked = _runs(emitted).mapInArrow(chain, "a long, b long").distinct()
    return linked.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def proposals(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The links of distinct fingerprints ``f``, stored."""
    near = stored(candidates(fps, radius))
    out = stored(edges(near, radius))
    dropped(near)
    return out


def _text_hash(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, width: int = 4) -> DataFrame:
    """(key, f, component_id) of each row; links are within ``radius`` bits."""
    rows = stored(with_fingerprint(docs.select(key, F.col(text).alias("__t")), "__t", "f", width))
    fps = stored(rows.groupBy("f").agg(F.min(key).alias("least")))
    links = proposals(fps.select("f"), radius)
    parts = stored(components(links))
    dropped(links)
    named = stored(fps.join(parts.withColumnRenamed("node", "f"), "f", "left").withColumn("root", F.coalesce("root", "f")))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = stored(named.join(names, "root").select("f", "component_id"))
    dropped(fps, parts, named)
    return rows.join(ids, "f")


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, width: int = 4) -> DataFrame:
    """(key, fingerprint, component_id): component_id is the smallest key reachable over links."""
    return classes(docs, key, text, radius, width).select(key, F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")


def _similar_rows(docs: DataFrame, key: str, text: str, width: int, similarity: float, radius: int = RADIUS) -> DataFrame:
    """(__key, __text, f, c) of each row, __text being a hash of its text, f its set of shingles and c its class.

    Links join sets whose similarity is ``similarity`` or more.  Ball hashing over the sets' fingerprints proposes links,
    ``similar.similar_links`` verifies them and adds those that fingerprints miss.
    """
    lean = docs.select(F.col(key).alias("__key"), _text_hash(text).alias("__text"), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    schema = T.StructType([*lean.schema.fields[:2], T.StructField("f", T.LongType()), T.StructField("s", T.LongType())])

    def run(batch: pa.RecordBatch) -> dict:
        sets = similar.shingle_sets(texts(batch, "__t"), width)
        marks = np.array([_signature(mix(h)) if len(h) else 0 for h in sets], np.uint64)
        return {"f": np.array([similar.set_name(h) for h in sets], np.int64), "s": marks.view(np.int64)}

    rows = stored(map_text(lean, "__t", run, schema))
    least = rows.groupBy("f").agg(F.min(F.struct("__key", "__text")).alias("x"), F.min("s").alias("s"))
    one = stored(least.select("f", "s", F.col("x.__key").alias("__key"), F.col("x.__text").alias("__text")))
    # one set stands for each fingerprint; sets of one fingerprint are proposed as links with it
    heads = stored(one.groupBy("s").agg(F.min("f").alias("h")))
    near = proposals(heads.select(F.col("s").alias("f")), radius)
    same = one.join(heads, "s").where("f <> h").select(F.col("f").alias("a"), F.col("h").alias("b"))
    ends = near.join(heads.select(F.col("s").alias("a"), F.col("h").alias("ha")), "a").join(heads.select(F.col("s").alias("b"), F.col("h").alias("hb")), "b")
    known = similar.similar_links(lean, one.select("f", "__key", "__text"), same.unionAll(ends.select("ha", "hb")), similarity, width)
    out = stored(rows.drop("s").join(known, "f", "left").withColumn("c", F.coalesce("c", "f")))
    dropped(rows, one, heads, near, known)
    return out


def similar_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(key, component_id) of each row: the smallest key reachable over links of ``similarity`` or more."""
    named = _similar_rows(docs, key, text, width, similarity)
    least = named.groupBy("c").agg(F.min("__key").alias("component_id"))
    return named.join(least, "c").select(F.col("__key").alias(key), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each class of similar texts, the one with the smallest (key, text hash); columns as they were."""
    named = _similar_rows(docs, key, text, width, similarity)
    best = named.groupBy("c").agg(F.min(F.struct("__key", "__text")).alias("x"))
    kept = stored(best.select("x.__key", "x.__text"))
    again = named.join(kept, named["__key"].eqNullSafe(kept["__key"]) & (named["__text"] == kept["__text"]), "left_semi").count() > kept.count()
    dropped(named)
    out = docs.withColumn("__hash", _text_hash(text)).join(kept, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__hash") == F.col("__text")), "left_semi")
    return (out.dropDuplicates([key, "__hash"]) if again else out).drop("__hash")  # of repeated rows one stays
