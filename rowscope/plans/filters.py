"""Filter trees.  Comparisons have two values: a missing, null or differently kinded value makes them false."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowscope.functions.access import Accessor, Value
from rowscope.paths import parse

# Operator names.
OPS = ("eq", "ne", "lt", "lte", "gt", "gte", "contains", "regex", "in", "isnull", "notnull", "bool")
# Operators offered for each column type.
MENU = {
    "int": ("eq", "ne", "lt", "lte", "gt", "gte", "in", "isnull", "notnull"),
    "float": ("eq", "ne", "lt", "lte", "gt", "gte", "in", "isnull", "notnull"),
    "string": ("eq", "ne", "contains", "regex", "in", "isnull", "notnull"),
    "bool": ("bool", "isnull", "notnull"),
}


class FilterError(ValueError):
    """A filter that does not compile."""


@dataclass(frozen=True)
class Condition:
    path: str
    op: str
    value: Any = None  # string, number, bool, None; for "in" a list of these
    ci: bool = False


@dataclass(frozen=True)
class Filter:
    conditions: tuple[Condition, ...] = ()
    groups: tuple[Filter, ...] = ()
    combinator: str = "and"
    negate: bool = False

    def match_all(self) -> bool:
        return not self.conditions and not self.groups and not self.negate and self.combinator != "or"

    def key(self, search: str = "") -> str:
        """A stable name of what the filter and a search select."""
        return hashlib.sha256(json.dumps([asdict(self), search], sort_keys=True, default=str).encode()).hexdigest()


def operators_for(kind: str) -> tuple[str, ...]:
    return MENU.get(kind, ("isnull", "notnull"))


def draft(conditions: list[dict], kinds: dict[str, str]) -> Filter:
    """A filter from user input: incomplete or unfit conditions are left out, operands follow the column's type."""
    out = []
    for c in conditions:
        kind, op, value = kinds.get(c.get("path", ""), "mixed"), c.get("op"), c.get("value")
        if not c.get("path") or op not in operators_for(kind) and op in OPS and kind != "mixed" or op not in OPS:
            continue
        try:
            if op in ("isnull", "notnull"):
                value = None
            elif op == "in":
                parts = value if isinstance(value, list) else [x.strip() for x in str(value or "").split(",") if x.strip()]
                value = [_number(x) if kind in ("int", "float") else x for x in parts]
                if not value:
                    continue
            elif op == "bool":
                value = value if isinstance(value, bool) else {"true": True, "false": False}[str(value).lower()]
            elif value is None or value == "":
                continue
            elif kind in ("int", "float"):
                value = _number(value)
            if op == "regex":
                check_regex(str(value))
        except (KeyError, ValueError):
            continue
        out.append(Condition(c["path"], op, value, bool(c.get("ci"))))
    return Filter(tuple(out))


def _number(x: Any) -> int | float:
    if isinstance(x, bool):
        raise ValueError(x)
    if isinstance(x, (int, float)):
        return x
    return int(x) if re.fullmatch(r"-?\d+", str(x).strip()) else float(x)


def check_regex(pattern: str) -> None:
    """Only what a linear-time engine can run: no look-around, back-references, atomic or possessive parts."""
    if re.search(r"\(\?(?:[=!>]|<[=!])|(?<!\\)(?:\\\\)*\\[1-9]|\(\?P=|[*+?}]\+", pattern):
        raise FilterError(f"unsupported in a regular expression: {pattern!r}")
    try:
        re.compile(pattern)
    except re.error as e:
        raise FilterError(f"bad regular expression {pattern!r}: {e}") from e


def compile_filter(f: Filter, at: Accessor) -> Column | None:
    """The filter as a condition; None if it matches all rows."""
    return None if f.match_all() else _group(f, at)


def _group(f: Filter, at: Accessor) -> Column:
    parts = [condition(c, at) for c in f.conditions] + [_group(g, at) for g in f.groups]
    any_of = f.combinator == "or"
    if not parts:
        out = F.lit(not any_of)
    else:
        out = parts[0]
        for p in parts[1:]:
            out = out | p if any_of else out & p
    return ~F.coalesce(out, F.lit(False)) if f.negate else out


def condition(c: Condition, at: Accessor) -> Column:
    parse(c.path)
    if c.op not in OPS:
        raise FilterError(f"unknown operator {c.op!r}")
    if c.op == "regex":
        check_regex(str(c.value))
    values = at.at(c.path)
    if values is None:  # the path exists nowhere
        return F.lit(c.op == "isnull")
    if c.op == "isnull":
        return values.is_null()
    if c.op == "notnull":
        return ~values.is_null()
    return values.each(lambda v: leaf(c, v))


def leaf(c: Condition, v: Value) -> Column:
    """One condition on one value; NULL counts as false."""
    if c.op == "in":
        items = [x for x in c.value or [] if x is not None]
        if not items:
            return F.lit(False)
        out = None
        for group in ([x for x in items if isinstance(x, bool)], [x for x in items if isinstance(x, str)], [x for x in items if isinstance(x, (int, float)) and not isinstance(x, bool)]):
            if group:
                p = _guard(v, group[0], lambda col, g=group: col.isin(*[_literal(x, v) for x in g]))
                out = p if out is None else out | p
        return out
    if c.op in ("contains", "regex"):
        if not isinstance(c.value, str):
            return F.lit(False)
        if c.op == "regex":
            return _guard(v, "", lambda s: s.rlike(("(?i)" if c.ci else "") + c.value))
        return _guard(v, "", lambda s: F.lower(s).contains(c.value.lower()) if c.ci else s.contains(c.value))
    if c.op == "bool":
        return _guard(v, True, lambda b: b == F.lit(c.value)) if isinstance(c.value, bool) else F.lit(False)
    if c.value is None or c.op not in ("eq", "ne") and isinstance(c.value, bool):
        return F.lit(False)
    want = _literal(c.value, v)

    def compare(x: Column) -> Column:
        if c.ci and isinstance(c.value, str) and c.op in ("eq", "ne"):
            return (F.lower(x) == c.value.lower()) if c.op == "eq" else (F.lower(x) != c.value.lower())
        out = {"eq": x == want, "ne": x != want, "lt": x < want, "lte": x <= want, "gt": x > want, "gte": x >= want}[c.op]
        fractional = v.dynamic or v.type.typeName() in ("float", "double")
        number = not isinstance(c.value, (str, bool))
        # NaN is above all numbers here, and below and above none for a comparison
        return out & ~F.isnan(x) if number and fractional and c.op in ("gt", "gte") else out

    return _guard(v, c.value, compare)


def _guard(v: Value, operand: Any, test) -> Column:
    if isinstance(operand, bool):
        ok, x = v.of("bool"), v.boolean
    elif isinstance(operand, str):
        ok, x = v.of("string"), v.string
    else:
        ok, x = v.of("int", "float"), v.number
    if ok is None:
        return F.lit(False)
    return ok & test(x()) if v.dynamic else test(x())


def _literal(x: Any, v: Value) -> Column:
    """Numbers are doubles, but whole ones stay whole beside whole columns, so that the scan can use them."""
    if isinstance(x, (bool, str)):
        return F.lit(x)
    whole = not v.dynamic and v.type.typeName() in ("byte", "short", "integer", "long")
    return F.lit(int(x)) if whole and float(x).is_integer() and abs(x) < 2**53 else F.lit(float(x))
