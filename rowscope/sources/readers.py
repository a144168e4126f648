"""Opening a file as a Source."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowscope.functions.access import ORD, RECORD
from rowscope.functions.literals import elements
from rowscope.sources.detect import detect, json_mode, separator


@dataclass
class Source:
    """``df`` has ``_ord`` and either typed columns or one VARIANT record ``_rec`` with its ``_raw`` text."""

    df: DataFrame
    format: str
    path: str
    bad: DataFrame | None = None
    in_order: bool = False  # whether the partitions of ``df`` follow each other in the order of the rows

    @property
    def skipped(self) -> int:
        return self.bad.count() if self.bad is not None else 0

    def records(self) -> DataFrame:
        """Rows in the order of the file."""
        return self.df.orderBy(ORD)


def _head(spark: SparkSession, path: str) -> bytes:
    row = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 512)).first() if not os.path.isfile(path) else None
    if row is not None:
        return bytes(row[0])
    with open(path, "rb") as f:
        return f.read(512)


def open_source(spark: SparkSession, path: str, format: str | None = None, raw: bool = False, table: str | None = None) -> Source:
    """Open a file.  ``raw`` reads CSV cells as text; ``table`` names a table of a database."""
    ext = os.path.splitext(path)[1].lower()
    head = b"" if format or ext in (".parquet", ".ndjson", ".jsonl", ".csv", ".tsv", ".tab", ".json") else _head(spark, path)
    kind = detect(path, head, format)
    if kind == "parquet":
        df = parquet(spark, path)
        return Source(df, kind, path, in_order=len(df.inputFiles()) == 1)
    if kind == "sqlite":
        from rowscope.sources.sqlite import read_sqlite

        return Source(read_sqlite(spark, path, table), kind, path)
    if kind == "csv":
        df = csv(spark, path, "\t" if format == "tsv" else separator(path), raw)
        return Source(df, kind, path, in_order=len(df.inputFiles()) == 1)
    return json_source(spark, path, json_mode(path, head, format))


def numbered(df: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``_ord``: the row's place in the scan's order, without gaps.  Rows of earlier partitions are counted, not gathered.

    Rows are read twice.  Those of a scan are in the same partitions again; a sort draws its ranges anew in each run, and
    AQE merges them by the bytes of the columns read, so its rows and their places go through ``keep``, which stores them.
    """
    part = df.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    if keep:
        part = keep(part)
    sizes = sorted((r["_p"], r["n"]) for r in part.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect())
    starts = list(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0)))  # noqa: B905
    # one row a partition: the driver's own list of tasks is as long
    table = df.sparkSession.createDataFrame(starts, "_p int, _start long")
    return part.join(F.broadcast(table), "_p").withColumn(ORD, F.col("_start") + F.col("_i")).drop("_p", "_i", "_start")


def parquet(spark: SparkSession, path: str) -> DataFrame:
    """The scan's own row index; rows of several files are numbered file after file, by name.

    The rows of each file come from the footers.  Filters on the columns pass below the ordinals to the scan.
    """
    df = spark.read.parquet(path)
    if len(df.inputFiles()) == 1:
        return df.select("*", F.col("_metadata.row_index").alias(ORD))
    files = df.select(F.col("_metadata.file_path").alias("_file")).groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    # one row a file: the driver's own listing is as long, so this may be broadcast
    starts = files.select("_file", F.coalesce(F.sum("_n").over(W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")).join(F.broadcast(starts), "_file")
    return placed.select(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns], (F.col("_start") + F.col("_row")).alias(ORD))


def json_source(spark: SparkSession, path: str, mode: str) -> Source:
    if mode == "document":
        text = spark.read.text(path, wholetext=True).where(F.trim("value") != "")

        def records(batches):
            for b in batches:
                for doc in b.column("value").to_pylist():
                    items = elements(doc)
                    own = [doc.strip()] if items is None else items
                    for at in range(0, len(own), 10_000):
                        part = own[at : at + 10_000]
                        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(range(at, at + len(part)), pa.int64())], names=["_raw", ORD])

        cut = text.mapInArrow(records, f"_raw string, {ORD} long")
        df = cut.select("_raw", F.try_parse_json("_raw").alias(RECORD), ORD)
        if not df.where(F.col(RECORD).isNull()).isEmpty():
            raise ValueError(f"{path}: not valid JSON")
        return Source(df, "json", path)
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("_raw"))
    parsed = lines.withColumn(RECORD, F.try_parse_json("_raw"))
    return Source(numbered(parsed.where(F.col(RECORD).isNotNull())), "json", path, parsed.where(F.col(RECORD).isNull()), len(lines.inputFiles()) == 1)


def csv_json(c: Column) -> Column:
    """A cell as JSON text: null, bool, int (up to 15 digits), float (with a point or exponent, finite) or string."""
    plain = c.rlike(r"^(true|false|-?(0|[1-9]\d{0,14}))$")
    number = c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") & c.rlike(r"[.eE]")
    # a bare point and a leading plus or zero are no JSON; such floats go through double
    strict = c.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$")
    finite = F.abs(c.try_cast("double")) < float("inf")
    text = F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6)
    return F.when(F.coalesce(c, F.lit("")) == "", "null").when(plain, c).when(number & finite, F.when(strict, c).otherwise(c.try_cast("double").cast("string"))).otherwise(text)


def csv(spark: SparkSession, path: str, sep: str, raw: bool) -> DataFrame:
    """Raw: text columns.  Else one VARIANT record a row, as each cell has a kind of its own."""
    df = spark.read.csv(path, header=True, sep=sep, multiLine=True, quote='"', escape='"', inferSchema=False, mode="PERMISSIVE", enforceSchema=True, nullValue="\x00", emptyValue="")
    names = df.columns
    if raw:
        return numbered(df).select(*[F.when(F.col(f"`{n}`") != "", F.col(f"`{n}`")).alias(n) for n in names], ORD)
    parts = []
    for i, n in enumerate(names):
        parts += [F.lit(("," if i else "{") + json.dumps(n, ensure_ascii=False) + ":"), csv_json(F.col(f"`{n}`"))]
    text = numbered(df).select(F.concat(*parts, F.lit("}")).alias("_raw"), ORD)
    return text.select("_raw", F.try_parse_json("_raw").alias(RECORD), ORD)
