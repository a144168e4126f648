"""Search over every scalar leaf: case-insensitive substring; keys and nulls never match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowscope.functions.access import ORD, Accessor
from rowscope.functions.kinds import as_text, kind_of, number_text


def _has(c: Column, t: T.DataType, q: str) -> Column:
    k = kind_of(t)
    if isinstance(t, T.StructType):
        return _any([_has(c.getField(f.name), f.dataType, q) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return F.coalesce(F.exists(c, lambda x: F.coalesce(_has(x, t.elementType, q), F.lit(False))), F.lit(False))
    if isinstance(t, T.MapType):
        return F.coalesce(F.exists(F.map_values(c), lambda x: F.coalesce(_has(x, t.valueType, q), F.lit(False))), F.lit(False))
    if isinstance(t, T.VariantType):
        return _json_leaf(F.to_json(c), q)
    if k in ("int", "float"):
        return F.lower(number_text(c, t)).contains(q)
    return F.lower(as_text(c, t)).contains(q)


def _json_leaf(text: Column, q: str) -> Column:
    """Substring of some scalar in JSON text: scalars are matched one by one, keys, which end in a colon, left out."""
    tokens = F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]|\\.)*"\s*:?|-?\d[\d.eE+-]*|true|false'), F.lit(0))
    scalars = F.filter(tokens, lambda s: ~s.endswith(":"))
    plain = F.transform(scalars, lambda s: F.when(s.startswith('"'), F.try_variant_get(F.try_parse_json(s), "$", "string")).otherwise(s))
    quick = F.lower(text).contains(q) if q.isalnum() and q.isascii() else F.lit(True)
    return quick & F.coalesce(F.exists(plain, lambda s: F.coalesce(F.lower(s).contains(q), F.lit(False))), F.lit(False))


def _any(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.coalesce(p, F.lit(False))
    return out


def search(text: str, at: Accessor) -> Column | None:
    """A condition, or None for an empty search.  Number literals are searched as the source wrote them where it is kept."""
    if not text:
        return None
    q = text.lower()
    if at.dynamic:
        return _json_leaf(F.col("_raw") if "_raw" in at.df.columns else F.to_json(F.col("_rec")), q)
    return _any([_has(F.col(f"`{n}`"), f.dataType, q) for n, f in at.fields.items() if n != ORD])
