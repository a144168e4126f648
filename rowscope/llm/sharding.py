"""Sharding by a hierarchical weighted hash tree (native: DataFrame functions only).

The tree has regions, racks and shards.  Each leaf has a weighted exponential draw ``-ln(u) / weight`` with ``u`` the
first 52 bits of the MD5 of (seed, leaf, key), which any SQL engine can compute; a node's draw is the smallest of the draws below it, so the descent takes, at each
level, the child with the smallest draw.  A minimum of exponentials is exponential with the sum of the weights, so
every level draws in proportion to its subtree's weight, and a leaf that is added or reweighted changes only draws of
its own ancestors: rows move into a subtree whose weight grew, out of one whose weight shrank, and nowhere else.

Nulls: a null key is hashed as a value of its own, a null text has no bytes.  Repeated rows get the same shard and
slots of their own.  Empty tables give empty results.  Columns of the input may have any names; only the named ones
are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowscope.llm.common import stored


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(n_shards: int, per_rack: int = 2, racks_per_region: int = 2, weights: dict[int, float] | None = None) -> list[Leaf]:
    """A tree that fills racks and regions in shard order."""
    w = weights or {}
    return [Leaf(i // (per_rack * racks_per_region), i // per_rack, i, w.get(i, 1.0)) for i in range(n_shards)]


def _bits(text: Column, digits: int) -> Column:
    """The first hexadecimal digits of a text's MD5 as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("bigint")


def _draw(key: Column, leaf: Leaf, seed: int) -> Column:
    text = F.concat(F.lit(f"{seed}|{leaf.shard}|"), F.when(key.isNull(), "n").otherwise(F.concat(F.lit("v"), key.cast("string"))))
    return -F.log((_bits(text, 13).cast("double") + F.lit(0.5)) / F.lit(float(2**52))) / F.lit(leaf.weight)


def _least(cols: list[Column]) -> Column:
    return F.least(*cols) if len(cols) > 1 else cols[0]


def _descend(draws: list[tuple[Leaf, Column]], level: tuple[str, ...]) -> Column:
    """The shard below the child with the smallest draw; ties go to the child that comes first."""
    if not level:
        return F.lit(draws[0][0].shard)
    kids: dict[int, list[tuple[Leaf, Column]]] = {}
    for leaf, d in draws:
        kids.setdefault(getattr(leaf, level[0]), []).append((leaf, d))
    below = [(_least([d for _, d in k]), _descend(k, level[1:])) for k in kids.values()]
    if len(below) == 1:
        return below[0][1]
    best = _least([d for d, _ in below])
    out = below[-1][1]
    for d, x in reversed(below[:-1]):
        out = F.when(d == best, x).otherwise(out)
    return out


def place(df: DataFrame, key: str, leaves: list[Leaf], out: str = "shard", seed: int = 7) -> DataFrame:
    """Add the shard of each row.  Leaves of weight 0 or less take no rows."""
    live = [x for x in leaves if x.weight > 0]
    if not live:
        raise ValueError("no leaf has weight")
    names = [f"_draw{i}" for i in range(len(live))]
    drawn = df.withColumns({n: _draw(F.col(key), x, seed) for n, x in zip(names, live, strict=True)})
    pick = _descend([(x, F.col(n)) for n, x in zip(names, live, strict=True)], ("region", "rack", "shard"))
    return drawn.withColumn(out, pick.cast("int")).drop(*names)


def slots(df: DataFrame, shard: str, order: list[str], rows_per_bin: int = 20_000) -> DataFrame:
    """Number the rows of each shard from 0 without gaps and without one task per shard.

    Rows are dealt to bins by a hash of the ordering columns; a bin's rows are numbered in its own task and shifted by a
    running sum over the bins before it.  The bin table has one row a shard and bin and grows with rows / rows_per_bin.
    Rows that agree in all ordering columns differ in nothing that is kept, so a big group of repeated rows is counted
    once and its copies are numbered by explode, never sorted in one task.
    """
    n = df.count()
    bins = max(4, -(-n // rows_per_bin))
    kinds = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    kinds = kinds.withColumn("_bin", F.pmod(_bits(F.concat_ws("|", *[F.col(c).cast("string") for c in order]), 13), F.lit(bins)))
    sizes = kinds.groupBy(shard, "_bin").agg(F.sum("_copies").alias("_n"))
    earlier = W.partitionBy(shard).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(shard, "_bin", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    w = W.partitionBy(shard, "_bin").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inner = kinds.withColumn("_before", F.coalesce(F.sum("_copies").over(w), F.lit(0)))
    joined = inner.join(shifts, [shard, "_bin"])
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)).alias("_copy")
    return joined.select("*", copy).withColumn("slot", F.col("_shift") + F.col("_before") + F.col("_copy")).select(*df.columns, "slot")


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", n_shards: int = 16, law: str = "key") -> DataFrame:
    """``key`` law: the key and the shard count decide, and one more shard takes rows only into itself."""
    if law != "key":
        raise ValueError("the hash tree keeps the law 'key'")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    base = docs.select(
        F.col(key), size.alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), F.lit(law).alias("law")
    )
    placed = place(place(base, key, tree(n_shards)), key, tree(n_shards + 1), "grown_shard")
    numbered = slots(stored(placed), "shard", [key, "text_crc32", "size"])  # one pass over the texts
    return numbered.select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
