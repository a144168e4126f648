"""The session interface: open a source, page through queries on it, count, look at cells, export, save views."""

from __future__ import annotations

import json
import os
import threading
from dataclasses import asdict, dataclass, field
from itertools import count
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowscope.functions.access import ORD, RECORD, Accessor, Value
from rowscope.functions.literals import with_exact
from rowscope.operators import codegen, sinks
from rowscope.operators.edits import Edit, save_edits
from rowscope.operators.profile import Column, Field, Profile, column_model, profile
from rowscope.paths import leaf
from rowscope.plans.filters import Condition, Filter, compile_filter
from rowscope.plans.ordering import sort_keys
from rowscope.plans.projection import ColumnSpec, Transform, cell, check_names, project
from rowscope.plans.search import search as search_condition
from rowscope.sources.readers import Source, open_source


@dataclass(frozen=True)
class Query:
    filter: Filter = field(default_factory=Filter)
    search: str = ""
    sort: tuple[str, bool] | None = None  # path, descending
    transform: Transform = field(default_factory=Transform)
    offset: int = 0
    limit: int = 100


@dataclass
class Page:
    columns: list[str]
    rows: list[dict[str, Any]]
    total: int  # -1: not asked for
    exact: bool
    truncated: bool  # fewer rows than asked for: the end is reached


def matching(df: DataFrame, f: Filter, text: str = "") -> DataFrame:
    """The rows that the filter and the search both select."""
    at = Accessor(df)
    for c in (compile_filter(f, at), search_condition(text, at)):
        if c is not None:
            df = df.where(c)
    return df


def window(df: DataFrame, sort: tuple[str, bool] | None, offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` and following of the sorted (else source) order."""
    keys = sort_keys(sort[0], sort[1], Accessor(df)) if sort else [F.col(ORD)]
    return df.orderBy(*keys).offset(max(0, offset)).limit(max(0, limit))


def projected(df: DataFrame, specs: list[ColumnSpec]) -> DataFrame:
    at = Accessor(df)
    names = [s.alias or leaf(s.path) for s in specs]
    check_names(names)
    return df.select(ORD, *[project(s, at).alias(n) for s, n in zip(specs, names, strict=True)])


#: Estimated bytes of parsed rows for each byte of text.
PARSED = 4


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder, wherever Spark reads it from."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def rows_per_page(columns: int) -> int:
    return max(40, min(200, 30_000 // max(1, columns)))


class Superseded(RuntimeError):
    """A query whose request was used by a later query, or cancelled, before it ended."""


class Explorer:
    """Open sources by handle."""

    def __init__(self, spark: SparkSession, views_dir: str | None = None):
        self.spark = spark
        self.views_dir = views_dir or os.path.expanduser("~/.config/rowscope")
        self._ids = count(1)
        self._open: dict[str, tuple[Source, Profile, list[Column]]] = {}
        self._turns: dict[str, int] = {}  # the latest query of each request
        self._lock = threading.Lock()

    def open(self, path: str, cache: bool | None = None, budget_mb: int = 512, **how: Any) -> str:
        """``cache`` None: text sources whose parsed rows are estimated to fit the budget are kept, others are read again each time."""
        source = open_source(self.spark, path, **how)
        if cache is None:
            cache = source.format in ("json", "csv") and PARSED * size_of(self.spark, path) <= budget_mb << 20
        if cache:
            source.df = source.df.persist()
        p = profile(source)
        order = None if RECORD in source.df.columns else [c for c in source.df.columns if c != ORD]
        handle = f"h{next(self._ids)}"
        self._open[handle] = (source, p, column_model(p, order))
        return handle

    def close(self, handle: str) -> None:
        self._open.pop(handle)[0].df.unpersist()

    def source(self, handle: str) -> Source:
        if handle not in self._open:
            raise KeyError(f"no open source {handle!r}")
        return self._open[handle][0]

    def columns(self, handle: str) -> list[Column]:
        return self._open[handle][2]

    def profile(self, handle: str) -> Profile:
        return self._open[handle][1]

    def column_stats(self, handle: str, path: str) -> Field | None:
        return self.profile(handle).get(path)

    def _specs(self, handle: str, q: Query) -> list[ColumnSpec]:
        return q.transform.columns([c.path for c in self.columns(handle)])

    def frame(self, handle: str, q: Query) -> DataFrame:
        """The whole query as a DataFrame, for further work."""
        got = window(matching(self.source(handle).df, q.filter, q.search), q.sort, q.offset, q.limit)
        return projected(got, self._specs(handle, q))

    def query(self, handle: str, q: Query, want_total: bool = False, request: str | None = None) -> Page:
        """One page of cells.  A later query with the same ``request`` cancels this one, which then raises ``Superseded``."""
        turn = self.cancel(request) if request else 0
        if request:
            self.spark.addTag(self._tag(request, turn))
        try:
            specs = self._specs(handle, q)
            found = matching(self.source(handle).df, q.filter, q.search)
            if q.sort is None and self.source(handle).in_order:
                # rows come in the order of the source, so the scan ends with the page
                got = found.offset(max(0, q.offset)).limit(max(0, q.limit))
            else:
                got = window(found, q.sort, q.offset, q.limit)
            got, sources = with_exact(got, [s.path for s in specs])
            at = Accessor(got)
            names = [s.alias or leaf(s.path) for s in specs]
            rows = got.select(ORD, *[cell(s, at, source=x).alias(f"c{i}") for i, (s, x) in enumerate(zip(specs, sources, strict=True))]).collect()
            total = found.count() if want_total else -1
        except Exception:
            if request and self._turns[request] != turn:
                raise Superseded(request) from None
            raise
        finally:
            if request:
                self.spark.removeTag(self._tag(request, turn))
        if request and self._turns[request] != turn:
            raise Superseded(request)
        out = [{"index": r[ORD]} | {n: r[f"c{i}"].asDict() for i, n in enumerate(names)} for r in rows]
        return Page(names, out, total, True, len(rows) < q.limit)

    @staticmethod
    def _tag(request: str, turn: int) -> str:
        return f"rowscope-{request}-{turn}"

    def cancel(self, request: str) -> int:
        """End the request's query, if one runs; gives the number of the request's next query."""
        with self._lock:
            turn = self._turns.get(request, 0) + 1
            self._turns[request] = turn
        self.spark.interruptTag(self._tag(request, turn - 1))  # no later query has this tag
        return turn

    def count(self, handle: str, f: Filter | None = None, text: str = "") -> int:
        return matching(self.source(handle).df, f or Filter(), text).count()

    def get_cell(self, handle: str, ordinal: int, path: str = "$") -> tuple[str | None, bool]:
        """(JSON text, found): a missing value is not found, null is."""
        df = self.source(handle).df
        got = Accessor(df).at(path)
        row = df.where(F.col(ORD) == ordinal)
        if got is None:
            if not row.limit(1).count():
                raise IndexError(ordinal)
            return None, False
        got = got.first()
        row, (text,) = with_exact(row, [path])
        r = row.select(sinks.json_value(Value(got.col, got.type), text).alias("j"), got.present.alias("p")).first()
        if r is None:
            raise IndexError(ordinal)
        return (r["j"], True) if r["p"] else (None, False)

    def export(self, handle: str, q: Query, target: str, format: str, progress=None) -> sinks.Exported:
        """All matching rows in the order of the source; the sort and the window do not apply."""
        source, specs = self.source(handle), self._specs(handle, q)
        return sinks.export(matching(source.df, q.filter, q.search), specs, target, format, source.path, progress, self._kinds(handle, specs))

    def _kinds(self, handle: str, specs: list[ColumnSpec]) -> dict[str, str]:
        """Column types of the paths: what their values are, ``mixed`` where they drift."""
        known = {c.path: c.type for c in self.columns(handle)}
        for s in specs:
            f = self.column_stats(handle, s.path)
            if s.path not in known and f is not None:
                own = {k for k, n in f.kinds.items() if n and k != "null"}
                known[s.path] = own.pop() if len(own) == 1 else "float" if own == {"int", "float"} else "mixed"
        return known

    def save_edits(self, handle: str, edits: list[Edit], target: str) -> tuple[int, int]:
        return save_edits(self.source(handle), edits, target, not target.endswith(".json"))

    def code(self, handle: str, q: Query, language: str = "sql", dialect: str = "sqlite") -> codegen.Code:
        base = [c.path for c in self.columns(handle)]
        if language == "jq":
            return codegen.jq(q.filter, q.search, q.sort, q.transform, base)
        return codegen.sql(q.filter, q.search, q.sort, q.transform, base, dialect=dialect)

    # saved views -------------------------------------------------------------------------------------------------

    def _views(self) -> str:
        return os.path.join(self.views_dir, "views.json")

    def views(self) -> dict[str, Query]:
        if not os.path.exists(self._views()):
            return {}
        with open(self._views(), encoding="utf-8") as f:
            return {n: query_from(v) for n, v in json.load(f).items()}

    def save_view(self, name: str, q: Query | None) -> None:
        """Add or replace a view; None removes it."""
        have = {n: asdict(v) for n, v in self.views().items() if n != name}
        if q is not None:
            have[name] = asdict(q)
        os.makedirs(self.views_dir, exist_ok=True)
        with sinks.replacing(self._views()) as f:
            f.write(json.dumps(have, indent=2, ensure_ascii=False).encode())


def filter_from(d: dict[str, Any]) -> Filter:
    return Filter(tuple(Condition(**c) for c in d.get("conditions", ())), tuple(filter_from(g) for g in d.get("groups", ())), d.get("combinator", "and"), d.get("negate", False))


def query_from(d: dict[str, Any]) -> Query:
    t = d.get("transform") or {}
    return Query(filter_from(d.get("filter") or {}), d.get("search", ""), tuple(d["sort"]) if d.get("sort") else None, Transform(tuple(ColumnSpec(**c) for c in t.get("select", ())), tuple(t.get("drop", ())), t.get("flatten_objects", False)), d.get("offset", 0), d.get("limit", 100))
