"""Profiles: one row of statistics for each path.

All statistics come from one aggregation: the counts of the typed values of each path, combined on the map side and
kept while scalar statistics, distinct counts, frequent values, bars and exact quantiles are computed from it.  Only the
values that can be among a path's most frequent are written as text.  Flat typed sources are stacked into observations
by one generated expression; nested and VARIANT sources are flattened level by level, to any depth.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column as Column_
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowscope.functions.access import ORD, RECORD
from rowscope.functions.kinds import KINDS, as_text, kind_of, number_text, number_text_py, variant_kind
from rowscope.functions.literals import loads
from rowscope.sources.readers import Source

TOP, BARS = 10, 20
# Different values above which a path is described by sketches if asked, and counters of frequent values.
EXACT_DISTINCT, HEAVY = 16_384, 512


@dataclass
class Field:
    path: str
    presence: int
    observations: int
    kinds: dict[str, int]
    distinct: int = 0
    exact: bool = True
    top: list[tuple[str, int]] = field(default_factory=list)
    min: float | None = None
    max: float | None = None
    mean: float | None = None
    median: float | None = None
    p95: float | None = None
    min_len: int | None = None
    max_len: int | None = None
    bars: list[tuple[float, float, int]] = field(default_factory=list)
    records: int = 0

    @property
    def presence_rate(self) -> float:
        return self.presence / self.records if self.records else 0.0

    @property
    def null_rate(self) -> float:
        return self.kinds.get("null", 0) / self.observations if self.observations else 0.0

    @property
    def shares(self) -> dict[str, float]:
        return {k: n / self.observations for k, n in self.kinds.items() if n} if self.observations else {}

    @property
    def drift(self) -> bool:
        return len({"number" if k in ("int", "float") else k for k, n in self.kinds.items() if n and k != "null"}) > 1


@dataclass
class Profile:
    records: int
    skipped: int
    source: str
    fields: list[Field]

    def get(self, path: str) -> Field | None:
        return next((f for f in self.fields if f.path == path), None)


def _flat(t: T.DataType) -> bool:
    return kind_of(t) not in ("array", "object", "variant")


def observations(df: DataFrame) -> DataFrame:
    """(_ord, path, kind, whole, num, str): one row for each value of each path, typed, no number written as text.

    Ints are in ``whole`` and ``num``, floats in ``num``, strings and ints beyond 64 bits in ``str``.
    """
    fields = [f for f in df.schema.fields if f.name not in (ORD, "_raw")]
    if RECORD not in df.columns and all(_flat(f.dataType) for f in fields):
        items = []
        for f in fields:
            c, k = F.col(f"`{f.name.replace('`', '``')}`"), kind_of(f.dataType)
            long = k == "int" and isinstance(f.dataType, T.DecimalType)
            items.append(F.struct(
                F.lit(f.name).alias("path"), F.when(c.isNull(), "null").otherwise(k).alias("kind"),
                (c.try_cast("bigint") if k == "int" else F.lit(None).cast("bigint")).alias("whole"),
                (c.cast("double") if k in ("int", "float") else F.lit(None).cast("double")).alias("num"),
                (as_text(c, f.dataType) if k == "string" or long else F.lit(None).cast("string")).alias("str"),
            ))
        return df.select(ORD, F.inline(F.array(*items)))
    return _flatten(df, fields)


#: Levels of records without a schema that are exploded one by one; deeper ones are walked in one pass over the text.
LEVELS = 5


def _flatten(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """Level by level, each from the containers of the level above, which are kept, until a level has none."""
    spark = df.sparkSession
    walked = "_raw" in df.columns
    if RECORD in df.columns:
        level = df.select(ORD, F.lit("").alias("path"), F.col(RECORD).alias("v"))
    else:
        cols = [(as_text(F.col(f"`{f.name}`"), f.dataType) if kind_of(f.dataType) == "string" else F.col(f"`{f.name}`")).alias(f.name) for f in fields]
        level = df.select(ORD, F.lit("").alias("path"), F.to_variant_object(F.struct(*cols)).alias("v"))
    out, depth = None, 0
    while True:
        level = level.withColumn("kind", variant_kind(F.col("v"))).persist()
        num = F.when(F.col("kind").isin("int", "float"), F.try_variant_get("v", "$", "double"))
        whole = F.when(F.col("kind") == "int", F.try_variant_get("v", "$", "bigint"))
        text = F.when((F.col("kind") == "string") | (F.col("kind") == "int") & whole.isNull(), F.try_variant_get("v", "$", "string"))
        shown = level.where("path <> '' or kind <> 'object'").select(ORD, F.when(F.col("path") == "", "$").otherwise(F.col("path")).alias("path"), "kind", whole.alias("whole"), num.alias("num"), text.alias("str"))
        out, depth = shown if out is None else out.unionAll(shown), depth + 1
        inner = level.where("kind in ('array', 'object')")
        if inner.isEmpty():
            return out
        if walked and depth == LEVELS:
            deep = df.join(inner.select(ORD).distinct(), ORD, "left_semi").select(ORD, "_raw")
            return out.unionAll(deep.mapInArrow(lambda batches: _walk(batches, LEVELS), out.schema))
        level = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(
            ORD,
            F.when(F.col("kind") == "array", F.concat("path", F.lit("[]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat("path", F.lit("."), "key")).alias("path"),
            F.col("value").alias("v"),
        )


def _observed(x: Any) -> tuple[str, int | None, float | None, str | None]:
    """(kind, whole, num, str) of a value read by ``literals.loads``."""
    if x is None or isinstance(x, (bool, dict, list, str)):
        kind = {type(None): "null", bool: "bool", dict: "object", list: "array", str: "string"}[type(x)]
        return kind, None, None, x if kind == "string" else None
    if any(c in x.text for c in ".eE"):
        return "float", None, float(x), None
    n = int(x.text)
    return ("int", n, float(x), None) if -(1 << 63) <= n < 1 << 63 else ("int", None, float(x), x.text)


def _walk(batches, least: int):
    """Observations of the values that lie ``least`` levels deep or deeper."""
    for b in batches:
        rows: list[tuple] = []
        for o, text in zip(b.column(ORD).to_pylist(), b.column("_raw").to_pylist(), strict=True):
            stack = [("", loads(text), 0)]
            while stack:
                path, x, depth = stack.pop()
                if depth >= least:
                    rows.append((o, path, *_observed(x)))
                if isinstance(x, list):
                    stack += [(path + "[]", v, depth + 1) for v in x]
                elif isinstance(x, dict):
                    stack += [(f"{path}.{k}" if path else k, v, depth + 1) for k, v in x.items()]
        cols = list(zip(*rows, strict=True)) or [()] * 6
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[ORD, "path", "kind", "whole", "num", "str"])


def value_counts(obs: DataFrame) -> DataFrame:
    """(path, kind, whole, num, str, n): each value of each path once; everything else is computed from this."""
    return obs.groupBy("path", "kind", "whole", "num", "str").agg(F.count(F.lit(1)).alias("n"))


def flat_counts(df: DataFrame) -> DataFrame:
    """``value_counts`` of a source of flat typed columns: grouped by the column's number and its typed value alone."""
    fields = [f for f in df.schema.fields if f.name not in (ORD, "_raw")]
    items = []
    for i, f in enumerate(fields):
        c, k = F.col(f"`{f.name.replace('`', '``')}`"), kind_of(f.dataType)
        whole = c.try_cast("bigint") if k == "int" else c.cast("bigint") if k == "bool" else F.lit(None).cast("bigint")
        num = c.cast("double") if k == "float" else F.lit(None).cast("double")
        text = as_text(c, f.dataType) if k == "string" else F.when(whole.isNull(), c.cast("string")) if isinstance(f.dataType, T.DecimalType) and k == "int" else F.lit(None).cast("string")
        items.append(F.struct(F.lit(i).alias("p"), whole.alias("whole"), num.alias("num"), text.alias("str")))
    got = df.select(F.inline(F.array(*items))).groupBy("p", "whole", "num", "str").agg(F.count(F.lit(1)).alias("n"))
    names, kinds = (F.get(F.array(*[F.lit(x) for x in xs]), F.col("p")) for xs in ([f.name for f in fields], [kind_of(f.dataType) for f in fields]))
    empty = F.col("whole").isNull() & F.col("num").isNull() & F.col("str").isNull()
    kind = F.when(empty, "null").otherwise(kinds)
    whole = F.when(kind == "int", F.col("whole"))
    num = F.when(kind.isin("int", "float"), F.coalesce("num", F.col("whole").cast("double"), F.col("str").try_cast("double")))
    return got.select(names.alias("path"), kind.alias("kind"), whole.alias("whole"), num.alias("num"), "str", "n")


def key_text() -> Column_:
    """The text of a value: numbers shortest, strings as they are, none for other kinds."""
    number = F.when(F.col("kind") == "int", F.coalesce(F.col("whole").cast("string"), F.col("str"))).when(F.col("kind") == "float", number_text(F.col("num"), T.DoubleType()))
    return F.coalesce(number, F.when(F.col("kind") == "string", F.col("str")))


def _finite() -> Column_:
    return F.when(~F.isnan("num") & (F.abs("num") < float("inf")), F.col("num"))


def statistics(counts: DataFrame) -> DataFrame:
    """Scalar statistics by path; numbers that are not finite count as observations only."""
    x, n = _finite(), F.col("n")
    size = F.when(F.col("kind") == "string", F.octet_length("str"))
    keyed = F.col("kind").isin("int", "float", "string")
    return counts.groupBy("path").agg(
        F.sum(n).alias("observations"), *[F.coalesce(F.sum(F.when(F.col("kind") == k, n)), F.lit(0)).alias(f"n_{k}") for k in KINDS],
        F.min(x).alias("min"), F.max(x).alias("max"), (F.sum(x * n) / F.sum(F.when(x.isNotNull(), n))).alias("mean"), F.sum(F.when(x.isNotNull(), n)).alias("finite"),
        F.min(size).alias("min_len"), F.max(size).alias("max_len"), F.count_if(keyed).alias("distinct"),
    )


def presence(obs: DataFrame) -> DataFrame:
    """(path, presence): records that have the path; only below arrays can a record have it twice."""
    each = obs.where(F.col("path").contains("[]")).select("path", ORD).distinct()
    return each.groupBy("path").agg(F.count(F.lit(1)).alias("presence"))


def mixed_distinct(counts: DataFrame, paths: list[str]) -> DataFrame:
    """(path, distinct) of paths with values of several kinds: numbers and strings share their texts."""
    return counts.where(F.col("path").isin(paths)).select("path", key_text().alias("key")).where("key is not null").distinct().groupBy("path").agg(F.count(F.lit(1)).alias("distinct"))


def top_values(counts: DataFrame, k: int = TOP) -> DataFrame:
    """(path, rank, key, n): the most frequent keys, ties by key.  Only values as frequent as the k-th of their path are written as text."""
    own = counts.where("kind in ('int', 'float', 'string')")
    sizes = own.groupBy("path", "n").agg(F.count(F.lit(1)).alias("m"))
    above = F.sum("m").over(W.partitionBy("path").orderBy(F.desc("n")))
    least = sizes.withColumn("above", above).groupBy("path").agg(F.coalesce(F.max(F.when(F.col("above") >= k, F.col("n"))), F.lit(0)).alias("least"))
    near = own.join(least, "path").where("n >= least").withColumn("key", key_text()).groupBy("path", "key").agg(F.sum("n").alias("n"))
    return near.withColumn("rank", F.row_number().over(W.partitionBy("path").orderBy(F.desc("n"), "key"))).where(F.col("rank") <= k)


def _bar(lo: Column_, hi: Column_, bars: int) -> Column_:
    return F.when(lo == hi, 0).otherwise(F.least(F.lit(bars - 1), F.floor((F.col("num") - lo) / ((hi - lo) / bars)).cast("int")))


def histogram(counts: DataFrame, stats: DataFrame, bars: int = BARS) -> DataFrame:
    """(path, bar, n): equal widths between a path's least and greatest number; one bar if these are equal."""
    ends = stats.where("min is not null").select("path", "min", "max")
    x = counts.withColumn("num", _finite()).where("num is not null").select("path", "num", "n").join(ends, "path")
    return x.groupBy("path", _bar(F.col("min"), F.col("max"), bars).alias("bar")).agg(F.sum("n").alias("n"))


def order_statistics(counts: DataFrame, wanted: list[tuple[str, int, float, float]], bars: int = 256) -> dict[tuple[str, int], float]:
    """The number at each (path, place from 0, least, greatest), exactly: the bar that holds the place is divided until it holds one number.

    A round reads the counts once and brings ``bars`` rows a place to the driver, whatever the number of values.
    """
    spark = counts.sparkSession
    open_ = {(p, r): (lo, hi, 0) for p, r, lo, hi in wanted}
    done: dict[tuple[str, int], float] = {}
    numbers = counts.withColumn("num", _finite()).where("num is not null").select("path", "num", "n")
    while open_:
        done |= {k: lo for k, (lo, hi, _) in open_.items() if lo == hi}
        open_ = {k: v for k, v in open_.items() if v[0] != v[1]}
        if not open_:
            break
        names = list(open_)
        rows = [(i, k[0], *map(float, open_[k][:2])) for i, k in enumerate(names)]
        parts = spark.createDataFrame(rows, "id int, path string, lo double, hi double")
        x = numbers.join(F.broadcast(parts), "path").where("num between lo and hi")  # two quantiles a path bound the rows
        got = x.groupBy("id", _bar(F.col("lo"), F.col("hi"), bars).alias("bar")).agg(F.sum("n").alias("n"), F.min("num").alias("lo"), F.max("num").alias("hi"))
        found: dict[int, list] = {}
        for r in got.collect():
            found.setdefault(r["id"], []).append((r["bar"], r["n"], r["lo"], r["hi"]))
        for i, k in enumerate(names):
            before = open_[k][2]
            for _, n, lo, hi in sorted(found[i]):
                if before + n > k[1]:
                    open_[k] = (lo, hi, before)
                    break
                before += n
    return done


def quantiles(counts: DataFrame, stats: list[Any], at: tuple[float, ...] = (0.5, 0.95)) -> dict[str, list[float]]:
    """Exact quantiles of each path with numbers, interpolated between neighbours."""
    places = {(r["path"], q): q * (r["finite"] - 1) for r in stats if r["finite"] for q in at}
    ends = {r["path"]: (r["min"], r["max"]) for r in stats}
    wanted = sorted({(p, int(x) + d, *ends[p]) for (p, _), x in places.items() for d in (0, int(x != int(x)))})
    value = order_statistics(counts, wanted)
    out: dict[str, list[float]] = {}
    for (p, _), x in places.items():
        a = value[p, int(x)]
        out.setdefault(p, []).append(a if x == int(x) else a + (value[p, int(x) + 1] - a) * (x - int(x)))
    return out


def promoted(obs: DataFrame, most: int = EXACT_DISTINCT) -> dict[str, int]:
    """Paths with more different values than are counted one by one, and the estimated number."""
    got = obs.where("kind in ('int', 'float', 'string')").groupBy("path").agg(F.approx_count_distinct(F.xxhash64(F.coalesce("whole", F.lit(0)), F.coalesce("num", F.lit(0.0)), F.coalesce("str", F.lit(""))), 0.016).alias("n"))
    return {r["path"]: r["n"] for r in got.where(F.col("n") > most).collect()}


def sketched(obs: DataFrame, paths: list[str]) -> dict[str, Any]:
    """Statistics of promoted paths in one pass of bounded memory: rows as of ``statistics``, with ``q`` and ``top``."""
    x = _finite()
    size = F.when(F.col("kind") == "string", F.octet_length("str"))
    got = obs.where(F.col("path").isin(paths)).groupBy("path").agg(
        F.count(F.lit(1)).alias("observations"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS],
        F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.count(x).alias("finite"), F.min(size).alias("min_len"), F.max(size).alias("max_len"),
        F.percentile_approx(x, [0.5, 0.95], 10_000).alias("q"), F.expr(f"approx_top_k(str, {TOP}, {HEAVY})").alias("strs"), F.expr(f"approx_top_k(num, {TOP}, {HEAVY})").alias("nums"),
    )
    return {r["path"]: r for r in got.collect()}


def profile(source: Source, approximate: bool = False, skipped: int | None = None) -> Profile:
    """The whole profile, as driver objects: one per path.

    The values of each path are counted once and kept while the rest is computed from them.  ``approximate`` leaves out
    the values of paths with over ``EXACT_DISTINCT`` different ones and describes these by sketches.
    """
    df = source.df
    obs = observations(df)
    records = df.count()
    many = promoted(obs) if approximate else {}
    flat = RECORD not in df.columns and all(_flat(f.dataType) for f in df.schema.fields if f.name not in (ORD, "_raw"))
    counts = (flat_counts(df) if flat and not many else value_counts(obs.where(~F.col("path").isin([*many])) if many else obs)).persist()
    try:
        stats = statistics(counts)
        found = stats.collect()
        # the number of paths bounds what is collected: statistics, ten values and twenty bars a path
        each = {r["path"]: r["presence"] for r in presence(obs).collect()} if any("[]" in r["path"] for r in found) else {}
        several = [r["path"] for r in found if sum(r[f"n_{k}"] > 0 for k in ("int", "float", "string")) > 1]
        distinct = {r["path"]: r["distinct"] for r in found} | ({r["path"]: r["distinct"] for r in mixed_distinct(counts, several).collect()} if several else {})
        top: dict[str, list[tuple[str, int]]] = {}
        for r in top_values(counts).orderBy("path", "rank").collect():
            top.setdefault(r["path"], []).append((r["key"], r["n"]))
        bars: dict[str, dict[int, int]] = {}
        for r in histogram(counts, stats).collect():
            bars.setdefault(r["path"], {})[r["bar"]] = r["n"]
        q = quantiles(counts, found)
    finally:
        counts.unpersist()
    rows = {r["path"]: r for r in found}
    if many:
        rough = sketched(obs, [*many])
        rows |= rough
        distinct |= many
        for p, r in rough.items():
            q[p] = r["q"]
            heavy = [(x["item"] if isinstance(x["item"], str) else number_text_py(x["item"]), x["count"]) for x in [*(r["strs"] or []), *(r["nums"] or [])] if x["item"] is not None and x["count"] > 1]
            top[p] = sorted(heavy, key=lambda x: (-x[1], x[0]))[:TOP]
    fields = []
    for p in sorted(rows, key=lambda s: s.encode()):
        r = rows[p]
        median, p95 = q.get(p) or [None, None]
        f = Field(p, each.get(p, r["observations"]), r["observations"], {k: r[f"n_{k}"] for k in KINDS if r[f"n_{k}"]}, distinct.get(p, 0), p not in many, top.get(p, []), r["min"], r["max"], r["mean"], median, p95, r["min_len"], r["max_len"], records=records)
        if p in bars:
            n = 1 if r["min"] == r["max"] else BARS
            w = (r["max"] - r["min"]) / n
            f.bars = [(r["min"] + i * w, r["max"] if i == n - 1 else r["min"] + (i + 1) * w, bars[p].get(i, 0)) for i in range(n)]
        fields.append(f)
    return Profile(records, source.skipped if skipped is None else skipped, source.path, fields)


@dataclass
class Column:
    path: str
    type: str
    nullable: bool
    container: bool


def column_model(p: Profile, order: list[str] | None = None, cap: int = 512) -> list[Column]:
    """Base columns: paths without array steps; the dominant kind is the type; objects give way to what is in them."""
    out: list[tuple[Column, float]] = []
    for f in p.fields:
        if "[]" in f.path:
            continue
        own = {k: n for k, n in f.kinds.items() if k != "null"}
        deeper = any(g.path.startswith((f.path + ".", f.path + "[]")) and g.path != f.path for g in p.fields)
        if set(own) == {"object"} and deeper:
            continue
        order_of = ("bool", "int", "float", "string", "array", "object")
        best = max(order_of, key=lambda k: (own.get(k, 0), -order_of.index(k))) if own else "null"
        if best == "int" and own.get("float"):
            best = "float"
        out.append((Column(f.path, "mixed" if f.drift else best, f.null_rate > 0, bool(own.get("object") or own.get("array"))), f.presence_rate))
    place = {q: i for i, q in enumerate(order or [])}
    out.sort(key=lambda x: (place.get(x[0].path.split(".")[0], len(place)), x[0].path.encode()))
    if len(out) > cap:
        kept = {id(c) for c, _ in sorted(out, key=lambda x: -x[1])[:cap]}
        out = [x for x in out if id(x[0]) in kept]
    return [c for c, _ in out]


def as_dict(p: Profile) -> dict[str, Any]:
    return {
        "records": p.records, "skipped": p.skipped, "source": p.source,
        "fields": [
            {"path": f.path, "presence": f.presence_rate, "types": dict(sorted(f.shares.items())), "null_rate": f.null_rate, "distinct": f.distinct, "distinct_exact": f.exact, "drift": f.drift, "top": [{"value": v, "count": n} for v, n in f.top]}
            | {k: v for k, v in (("min", f.min), ("max", f.max), ("min_len", f.min_len), ("max_len", f.max_len)) if v is not None}
            for f in p.fields
        ],
    }
