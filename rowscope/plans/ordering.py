"""Sort by one path in a total order: missing, null, bools, numbers, strings, containers; ties by ordinal, ascending."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowscope.functions.access import ORD, Accessor, Value
from rowscope.functions.kinds import kind_of


def sort_keys(path: str, desc: bool, at: Accessor) -> list[Column]:
    got = at.at(path)
    tie = [F.col(ORD).asc()]
    if got is None:
        return tie
    got = got.first()
    v = Value(got.col, got.type)

    def way(c: Column) -> Column:
        return c.desc_nulls_last() if desc else c.asc_nulls_first()

    if not v.dynamic:
        k = kind_of(v.type)
        rank = F.when(~got.present, 0).when(v.col.isNull(), 1).otherwise(2)
        if k in ("array", "object"):
            return [way(rank), *tie]
        if k == "float":  # what is not finite comes after all numbers, in no order
            odd = F.isnan(v.col) | (F.abs(v.col) == float("inf"))
            return [way(rank), way(F.when(odd, 1).otherwise(0)), way(F.when(~odd, v.col)), *tie]
        plain = [way(v.string() if k == "string" else v.col), *tie]
        # a top-level column is never missing, and null sorts first as it does here
        return plain if "." not in path and "[" not in path else [way(rank), *plain]
    kind = v.kind()
    rank = F.coalesce(F.when(kind == "null", 1).when(kind == "bool", 2).when(kind.isin("int", "float"), 3).when(kind == "string", 4).when(kind.isNotNull(), 5), F.lit(0))
    number = F.when(kind.isin("int", "float"), v.number())
    exact = F.when(kind == "int", F.try_variant_get(v.col, "$", "decimal(38,0)"))
    return [way(rank), way(F.when(kind == "bool", v.boolean())), way(number), way(exact), way(F.when(kind == "string", v.string())), *tie]
