"""Exports to one file, in the order of the source, put in place whole or not at all.

Rows stream from the executors a partition at a time, so the writing machine holds one partition and not the result.
``write_dataset`` writes a folder in parallel for results that one machine should not write.
"""

from __future__ import annotations

import csv as _csv
import io
import json
import os
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowscope.functions.access import ORD, Accessor, Value
from rowscope.functions.kinds import kind_of, number_text
from rowscope.functions.literals import with_exact
from rowscope.paths import leaf
from rowscope.plans.projection import ColumnSpec, check_names

FORMATS = ("json", "ndjson", "csv", "tsv", "parquet")


@dataclass
class Exported:
    path: str
    rows: int
    warnings: list[str] = field(default_factory=list)


def check_target(target: str, source: str | None) -> None:
    if not target:
        raise ValueError("no target path")
    if source and os.path.exists(target) and os.path.exists(source) and os.path.samefile(target, source):
        raise ValueError("the target is the source file")


class replacing:
    """Write to a temporary file beside the target; on success it takes the target's place."""

    def __init__(self, target: str):
        self.target = target

    def __enter__(self):
        fd, self.temp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(self.target)), prefix=".rowscope-")
        self.file = os.fdopen(fd, "wb")
        return self.file

    def __exit__(self, kind, *_):
        if kind is None:
            self.file.flush()
            os.fsync(self.file.fileno())
            self.file.close()
            os.chmod(self.temp, 0o644)
            os.replace(self.temp, self.target)
        else:
            self.file.close()
            os.unlink(self.temp)


def json_value(v: Value, source: Column | None = None) -> Column:
    """JSON text of a value; numbers as they are written, what is not finite as null.  ``source``: its text, where it is kept."""
    if v.dynamic:
        return F.coalesce(source, F.to_json(v.col)) if source is not None else F.to_json(v.col)
    k = kind_of(v.type)
    if k in ("int", "float"):
        text = number_text(v.col, v.type)
        return F.when(v.col.isNull() | text.isin("NaN", "+Inf", "-Inf"), "null").otherwise(text)
    return F.when(v.col.isNull(), "null").otherwise(v.json() if k != "string" else F.to_json(F.array(v.string())).substr(F.lit(2), F.length(F.to_json(F.array(v.string()))) - 2))


def json_line(specs: list[ColumnSpec], at: Accessor, sources: list[Column | None] | None = None) -> Column:
    parts = []
    for s, source in zip(specs, sources or [None] * len(specs), strict=True):
        got = at.at(s.path)
        if got is None:
            continue
        got = got.first()
        quoted = F.lit(_json_string(s.path) + ":")
        parts.append(F.when(got.present, F.concat(quoted, json_value(Value(got.col, got.type), source))))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts) if parts else F.lit(""), F.lit("}"))


def _json_string(x: str) -> str:
    return json.dumps(x, ensure_ascii=False)


def text_value(v: Value, source: Column | None = None) -> Column:
    """A CSV cell: exact numbers, compact JSON for containers, empty for null and missing."""
    if v.dynamic:
        k = v.kind()
        return F.when(k == "string", v.string()).when(v.null(), F.lit("")).otherwise(json_value(v, source))
    k = kind_of(v.type)
    text = number_text(v.col, v.type) if k in ("int", "float") else v.string() if k in ("string", "bool") else v.json()
    return F.coalesce(text, F.lit(""))


def export(df: DataFrame, specs: list[ColumnSpec], target: str, format: str, source: str | None = None, progress: Callable[[int], None] | None = None, kinds: dict[str, str] | None = None) -> Exported:
    """Write the rows of ``df``, which has ``_ord``, to one file.  ``kinds``: column types of paths whose values have no schema."""
    if format not in FORMATS:
        raise ValueError(f"unknown format {format!r}")
    check_target(target, source)
    check_names([s.path for s in specs] if format != "parquet" else [s.alias or leaf(s.path) for s in specs])
    df, sources = with_exact(df, [s.path for s in specs])
    at = Accessor(df)
    done = 0

    def count(rows: Iterator) -> Iterator:
        nonlocal done
        for r in rows:
            done += 1
            if progress and done % 4096 == 0:
                progress(done)
            yield r

    if format == "parquet":
        return _parquet(df, specs, at, target, progress, kinds or {}, sources)
    with replacing(target) as out:
        if format in ("json", "ndjson"):
            rows = df.select(ORD, json_line(specs, at, sources).alias("j")).orderBy(ORD).toLocalIterator()
            first = True
            out.write(b"[" if format == "json" else b"")
            for r in count(rows):
                out.write((("\n" if first else ",\n") if format == "json" else "").encode() + r["j"].encode() + (b"" if format == "json" else b"\n"))
                first = False
            out.write((b"]\n" if first else b"\n]\n") if format == "json" else b"")
        else:
            found = [got and got.first() for got in (at.at(s.path) for s in specs)]
            cells = [(text_value(Value(g.col, g.type), x) if g else F.lit("")).alias(f"c{i}") for i, (g, x) in enumerate(zip(found, sources, strict=True))]
            text = io.TextIOWrapper(out, encoding="utf-8", newline="", write_through=True)
            w = _csv.writer(text, delimiter="\t" if format == "tsv" else ",", lineterminator="\n")
            w.writerow([s.path for s in specs])
            for r in count(df.select(ORD, *cells).orderBy(ORD).toLocalIterator()):
                w.writerow(r[1:])
            text.flush()
            text.detach()
    return Exported(target, done)


# The types of exported columns by kind; others are text.
_TYPES = {"int": "bigint", "float": "double", "bool": "boolean"}


def _parquet_columns(specs: list[ColumnSpec], at: Accessor, kinds: dict[str, str], sources: list[Column | None]) -> tuple[list[Column], list[Column]]:
    """Columns cast to bigint, double, boolean or text, and whether each lost its value."""
    cols, lost = [], []
    for i, (s, source) in enumerate(zip(specs, sources, strict=True)):
        got = at.at(s.path)
        if got is None:
            cols.append(F.lit(None).cast("string").alias(f"c{i}"))
            continue
        got = got.first()
        v = Value(got.col, got.type)
        k = kinds.get(s.path, "string") if v.dynamic else kind_of(v.type)
        if k not in _TYPES:
            c = F.when(~v.null() if v.dynamic else v.col.isNotNull(), text_value(v, source))
        elif v.dynamic:  # a value of another kind does not fit, an int fits a column of floats
            c = F.when(v.of(*(("int", "float") if k == "float" else (k,))), F.try_variant_get(v.col, "$", _TYPES[k]))
            lost.append(F.when(~v.null() & c.isNull(), i))
        else:
            c = v.col.try_cast(_TYPES[k])
            lost.append(F.when(v.col.isNotNull() & c.isNull(), i))
        cols.append(c.alias(f"c{i}"))
    return cols, lost


def _parquet(df: DataFrame, specs: list[ColumnSpec], at: Accessor, target: str, progress, kinds: dict[str, str], sources: list[Column | None]) -> Exported:
    cols, lost = _parquet_columns(specs, at, kinds, sources)
    names = [s.alias or leaf(s.path) for s in specs]
    typed = df.select(ORD, *cols, (F.array_compact(F.array(*lost)) if lost else F.array().cast("array<int>")).alias("_lost")).orderBy(ORD)
    arrow = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    schema = pa.schema([pa.field(n, arrow.get(typed.schema[f"c{i}"].dataType.simpleString(), pa.string())) for i, n in enumerate(names)])
    bad: dict[int, int] = {}
    done = 0
    with replacing(target) as out, pq.ParquetWriter(out, schema) as w:
        block: list[tuple] = []

        def flush() -> None:
            if block:
                w.write_table(pa.table([pa.array(c, t.type) for c, t in zip(zip(*block, strict=True), schema, strict=True)], schema=schema))
                block.clear()

        for r in typed.toLocalIterator():
            block.append(tuple(r[1:-1]))
            done += 1
            for i in r["_lost"] or []:
                bad[i] = bad.get(i, 0) + 1
            if len(block) == 1024:
                flush()
                if progress and done % 4096 == 0:
                    progress(done)
        flush()
    return Exported(target, done, [f"{names[i]}: {n} values do not fit the column and were left null" for i, n in sorted(bad.items())])


def write_dataset(df: DataFrame, specs: list[ColumnSpec], folder: str, kinds: dict[str, str] | None = None) -> None:
    """The same columns as a Parquet folder, written in parallel."""
    df, sources = with_exact(df, [s.path for s in specs])
    cols, _ = _parquet_columns(specs, Accessor(df), kinds or {}, sources)
    df.select(*[c.alias(s.alias or leaf(s.path)) for c, s in zip(cols, specs, strict=True)]).write.mode("errorifexists").parquet(folder)
