"""Values at a path, over typed columns and over VARIANT records.

Where a column's type is known, kinds are decided while planning, so comparisons stay plain ``column op literal`` and
reach the file scan.  Where values are VARIANT, kinds are checked row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowscope.functions.kinds import as_text, kind_of, variant_kind
from rowscope.paths import Seg, parse

ORD = "_ord"
RECORD = "_rec"


@dataclass
class Values:
    """What a path reaches: one scalar, or with ``many`` an array of values (never null itself)."""

    col: Column
    type: T.DataType
    many: bool
    present: Column  # for a scalar: whether the path exists in the row

    def each(self, f) -> Column:
        """Whether ``f`` holds for some value."""
        if self.many:
            return F.coalesce(F.exists(self.col, lambda x: F.coalesce(f(Value(x, self.type)), F.lit(False))), F.lit(False))
        return f(Value(self.col, self.type))

    def first(self) -> Values:
        if not self.many:
            return self
        return Values(F.get(self.col, F.lit(0)), self.type, False, F.size(self.col) > 0)

    def is_null(self) -> Column:
        if self.many:
            return (F.size(self.col) == 0) | F.exists(self.col, lambda x: Value(x, self.type).null())
        return Value(self.col, self.type).null()


@dataclass
class Value:
    """One value of known type or VARIANT."""

    col: Column
    type: T.DataType

    @property
    def dynamic(self) -> bool:
        return isinstance(self.type, T.VariantType)

    def kind(self) -> Column:
        if self.dynamic:
            return variant_kind(self.col)
        return F.when(self.col.isNull(), "null").otherwise(kind_of(self.type))

    def null(self) -> Column:
        return (self.col.isNull() | F.is_variant_null(self.col)) if self.dynamic else self.col.isNull()

    def of(self, *kinds: str) -> Column | None:
        """A guard that the value has one of the kinds; None if planning already knows that it has not."""
        if self.dynamic:
            return F.coalesce(variant_kind(self.col).isin(*kinds), F.lit(False))
        return F.lit(True) if kind_of(self.type) in kinds else None

    def number(self) -> Column:
        return F.try_variant_get(self.col, "$", "double") if self.dynamic else self.col

    def string(self) -> Column:
        return F.try_variant_get(self.col, "$", "string") if self.dynamic else as_text(self.col, self.type)

    def boolean(self) -> Column:
        return F.try_variant_get(self.col, "$", "boolean") if self.dynamic else self.col

    def json(self) -> Column:
        if self.dynamic:
            return F.to_json(self.col)
        return F.to_json(self.col) if kind_of(self.type) in ("array", "object") else F.to_json(F.array(self.col)).substr(F.lit(2), F.length(F.to_json(F.array(self.col))) - 2)


def _variant_path(segs: tuple[Seg, ...]) -> str:
    out = "$"
    for s in segs:
        key = (s.key or "").replace("\\", "\\\\").replace("'", "\\'").replace('"', '\\"')
        out += f'["{key}"]'
    return out


def _variant(v: Column, segs: tuple[Seg, ...]) -> Values:
    cut = next((i for i, s in enumerate(segs) if s.each), None)
    if cut is None:
        got = F.try_variant_get(v, _variant_path(segs), "variant") if segs else v
        return Values(got, T.VariantType(), False, got.isNotNull())
    head = F.try_variant_get(v, _variant_path(segs[:cut]), "variant") if cut else v
    empty = F.array().cast("array<variant>")
    items = F.coalesce(F.when(F.schema_of_variant(head).startswith("ARRAY"), F.try_variant_get(head, "$", "array<variant>")), empty)
    rest = segs[cut + 1 :]
    if not rest:
        return Values(items, T.VariantType(), True, F.size(items) > 0)
    inner = _variant(F.col("x"), rest)
    if inner.many:
        got = F.flatten(F.transform(items, lambda x: _variant(x, rest).col))
    else:
        got = F.filter(F.transform(items, lambda x: _variant(x, rest).col), lambda x: x.isNotNull())
    return Values(got, T.VariantType(), True, F.size(got) > 0)


def _typed(c: Column, t: T.DataType, segs: tuple[Seg, ...], present: Column) -> Values | None:
    """None: the schema has no such path."""
    if not segs:
        return Values(c, t, False, present)
    s, rest = segs[0], segs[1:]
    if isinstance(t, T.VariantType):
        got = _variant(c, segs)
        return got
    if s.each:
        if not isinstance(t, T.ArrayType):
            return None
        items = F.coalesce(c, F.array().cast(t))
        if not rest:
            return Values(items, t.elementType, True, F.size(items) > 0)
        probe = _typed(F.col("x"), t.elementType, rest, F.lit(True))
        if probe is None:
            return None
        if probe.many:
            return Values(F.flatten(F.transform(items, lambda x: _typed(x, t.elementType, rest, F.lit(True)).col)), probe.type, True, F.lit(True))
        return Values(F.transform(F.filter(items, lambda x: x.isNotNull()), lambda x: _typed(x, t.elementType, rest, F.lit(True)).col), probe.type, True, F.lit(True))
    if isinstance(t, T.StructType) and s.key in t.names:
        return _typed(c.getField(s.key), t[s.key].dataType, rest, present & c.isNotNull())
    if isinstance(t, T.MapType):
        return _typed(c.getItem(s.key), t.valueType, rest, F.coalesce(F.map_contains_key(c, F.lit(s.key)), F.lit(False)))
    return None


class Accessor:
    """Resolves paths over a source's rows."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.dynamic = RECORD in df.columns
        self.fields = {f.name: f for f in df.schema.fields if f.name not in (ORD, "_raw")}

    def at(self, path: str) -> Values | None:
        segs = parse(path)
        if self.dynamic:
            return _variant(F.col(RECORD), segs)
        if not segs:
            cols = [F.col(f"`{n}`") for n in self.fields]
            return Values(F.struct(*cols), T.StructType(list(self.fields.values())), False, F.lit(True))
        if segs[0].each or segs[0].key not in self.fields:
            return None
        name = segs[0].key.replace("`", "``")
        return _typed(F.col(f"`{name}`"), self.fields[segs[0].key].dataType, segs[1:], F.lit(True))
