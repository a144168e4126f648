"""Projection: select, rename, reorder and drop columns; a path into an array gives its first value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowscope.functions.access import Accessor, Value
from rowscope.functions.kinds import kind_of
from rowscope.paths import leaf, nested, parse


@dataclass(frozen=True)
class ColumnSpec:
    path: str
    alias: str = ""


@dataclass(frozen=True)
class Transform:
    select: tuple[ColumnSpec, ...] = ()
    drop: tuple[str, ...] = ()
    flatten_objects: bool = False  # accepted, changes nothing

    def columns(self, base: list[str]) -> list[ColumnSpec]:
        if self.select:
            for s in self.select:
                parse(s.path)
            return list(self.select)
        return [ColumnSpec(p, p) for p in base if not any(nested(p, d) for d in self.drop)]

    def names(self, base: list[str]) -> list[str]:
        return [s.alias or leaf(s.path) for s in self.columns(base)]


def check_names(names: list[str]) -> None:
    if not names:
        raise ValueError("no columns")
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"columns named twice: {', '.join(twice)}")


def project(spec: ColumnSpec, at: Accessor) -> Column:
    got = at.at(spec.path)
    if got is None:
        return F.lit(None).cast("string")
    return got.first().col


def cell(spec: ColumnSpec, at: Accessor, preview: int = 200, source: Column | None = None) -> Column:
    """struct(kind, text, count, more): kind ``missing`` where the path reaches nothing, text cut to ``preview`` characters.

    ``source``: the value's own text, where it is kept.
    """
    got = at.at(spec.path)
    if got is None:
        return F.struct(F.lit("missing").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("count"), F.lit(False).alias("more"))
    got = got.first()
    v = Value(got.col, got.type)
    if v.dynamic:
        kind = F.coalesce(v.kind(), F.lit("missing"))
        whole = F.coalesce(source, F.to_json(v.col)) if source is not None else F.to_json(v.col)
        text = F.when(kind == "string", v.string()).when(~kind.isin("missing", "null"), whole)
        count = F.when(kind == "array", F.size(F.try_variant_get(v.col, "$", "array<variant>"))).when(kind == "object", F.size(F.try_variant_get(v.col, "$", "map<string,variant>")))
    else:
        kind = F.when(~got.present, "missing").otherwise(v.kind())
        k = kind_of(v.type)
        text = F.when(v.col.isNotNull(), v.string() if k == "string" else v.json())
        count = F.when(v.col.isNotNull(), F.size(v.col)) if k == "array" else F.lit(None).cast("int")
    more = F.coalesce(F.length(text) > preview, F.lit(False))
    return F.struct(kind.alias("kind"), F.substring(text, 1, preview).alias("text"), count.alias("count"), more.alias("more"))


def move(specs: list[ColumnSpec], at: int, to: int) -> list[ColumnSpec]:
    out = list(specs)
    out.insert(to, out.pop(at))
    return out


def rename(specs: list[ColumnSpec], at: int, name: str) -> list[ColumnSpec]:
    """The same columns with one renamed; a name may be taken once only."""
    out = [ColumnSpec(s.path, name) if i == at else s for i, s in enumerate(specs)]
    check_names([s.alias or leaf(s.path) for s in out])
    return out


def hide(specs: list[ColumnSpec], at: int) -> list[ColumnSpec]:
    """The columns without one; the last column stays."""
    return [s for i, s in enumerate(specs) if i != at] or list(specs)
