"""The SQL and the jq program that say what a query says; texts only, no data is touched."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from rowscope.paths import Seg, leaf, parse
from rowscope.plans.filters import Condition, Filter, FilterError
from rowscope.plans.projection import ColumnSpec, Transform


@dataclass
class Code:
    text: str
    notes: list[str] = field(default_factory=list)

    def note(self, x: str) -> None:
        if x not in self.notes:
            self.notes.append(x)


def literal(x: Any) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return json.dumps(x)


class _Sql:
    def __init__(self, dialect: str, code: Code):
        self.spark, self.code = dialect == "spark", code

    def name(self, key: str) -> str:
        return "`" + key.replace("`", "``") + "`" if self.spark else '"' + key.replace('"', '""') + '"'

    def path(self, segs: tuple[Seg, ...]) -> str:
        if not segs or segs[0].each:
            return "*"
        first, rest = self.name(segs[0].key), segs[1:]
        if not rest:
            return first
        if self.spark:
            return first + "".join("[0]" if s.each else "." + self.name(s.key) for s in rest)
        return f"json_extract({first}, {literal('$' + ''.join('[0]' if s.each else '.' + json.dumps(s.key) for s in rest))})"

    def filter(self, f: Filter) -> str:
        parts = [self.condition(c) for c in f.conditions] + [f"({self.filter(g)})" for g in f.groups]
        word = " OR " if f.combinator == "or" else " AND "
        out = word.join(parts) if parts else ("FALSE" if self.spark else "0") if f.combinator == "or" else ("TRUE" if self.spark else "1")
        return f"NOT coalesce({out}, {'FALSE' if self.spark else '0'})" if f.negate else out

    def condition(self, c: Condition) -> str:
        segs = parse(c.path)
        each = next((i for i, s in enumerate(segs) if s.each), None)
        if each is None:
            return self.leaf(c, self.path(segs))
        head, rest = self.path(segs[:each]), segs[each + 1 :]
        if self.spark:
            x = "x" + "".join("." + self.name(s.key) for s in rest if not s.each)
            if c.op in ("isnull", "notnull"):
                empty = f"coalesce(size({head}), 0) <= 0 OR exists({head}, x -> {x} IS NULL)"
                return f"({empty})" if c.op == "isnull" else f"NOT ({empty})"
            return f"exists({head}, x -> coalesce({self.leaf(c, x)}, FALSE))"
        x = "value" if not rest else f"json_extract(value, {literal('$' + ''.join('.' + json.dumps(s.key) for s in rest if not s.each))})"
        self.code.note("array elements are read with json_each; the column must hold JSON text")
        if c.op in ("isnull", "notnull"):
            empty = f"NOT EXISTS (SELECT 1 FROM json_each({head})) OR EXISTS (SELECT 1 FROM json_each({head}) WHERE {x} IS NULL)"
            return f"({empty})" if c.op == "isnull" else f"NOT ({empty})"
        return f"EXISTS (SELECT 1 FROM json_each({head}) WHERE {self.leaf(c, x)})"

    def leaf(self, c: Condition, x: str) -> str:
        v = c.value
        if c.op in ("isnull", "notnull"):
            return f"{x} IS {'NOT ' * (c.op == 'notnull')}NULL"
        if c.op == "in":
            items = [i for i in v or [] if i is not None]
            return f"{x} IN ({', '.join(map(literal, items))})" if items else ("FALSE" if self.spark else "0")
        if c.op == "contains":
            a, b = (f"lower({x})", literal(str(v).lower())) if c.ci else (x, literal(v))
            return f"instr({a}, {b}) > 0"
        if c.op == "regex":
            if self.spark:
                return f"{x} RLIKE {literal(('(?i)' if c.ci else '') + v)}".replace("\\", "\\\\")
            return f"{x} REGEXP {literal(('(?i)' if c.ci else '') + v)}"
        op = {"eq": "=", "ne": "<>", "lt": "<", "lte": "<=", "gt": ">", "gte": ">=", "bool": "="}.get(c.op)
        if op is None:
            raise FilterError(f"unknown operator {c.op!r}")
        if v is None:
            return "FALSE" if self.spark else "0"
        if not self.spark:
            self.code.note("SQLite compares across types; the query compares values of one kind only")
        if c.ci and isinstance(v, str):
            return f"lower({x}) {op} {literal(v.lower())}"
        return f"{x} {op} {literal(v) if self.spark or not isinstance(v, bool) else int(v)}"


def _conditions(f: Filter | None):
    if f is not None:
        yield from f.conditions
        for g in f.groups:
            yield from _conditions(g)


def _caveats(code: Code, f: Filter | None, target: str) -> None:
    """What the conditions mean here and the target does otherwise."""
    own = list(_conditions(f))
    if any(c.ci for c in own) and target != "spark":
        code.note("without regard to case: the target lowers ASCII letters only, here all letters are lowered")
    if any(c.op == "in" and not [x for x in c.value or [] if x is not None] for c in own):
        code.note("an empty list matches nothing")
    if any(c.op == "regex" for c in own):
        code.note({"jq": "regular expressions are Oniguruma's in jq, RE2's here", "sqlite": "REGEXP needs an extension in SQLite", "spark": "regular expressions are Java's; look-around and back references are refused here"}[target])


def sql(f: Filter | None = None, search: str = "", sort: tuple[str, bool] | None = None, transform: Transform | None = None, columns: list[str] | None = None, table: str = "data", dialect: str = "sqlite", limit: int | None = None, offset: int = 0) -> Code:
    """``dialect`` is ``sqlite``, or ``spark`` for text that runs here."""
    code = Code("")
    _caveats(code, f, dialect)
    if table == "data":
        code.note("the text is for a flat table named data; a file is no database")
    s = _Sql(dialect, code)
    t = transform or Transform()
    specs = t.columns(columns or []) if t.select or columns else []
    cols = ", ".join(f"{s.path(parse(c.path))} AS {s.name(c.alias or leaf(c.path))}" if s.path(parse(c.path)) != s.name(c.alias or leaf(c.path)) else s.path(parse(c.path)) for c in specs) or "*"
    text = f"SELECT {cols}\nFROM {s.name(table)}"
    where = [] if f is None or f.match_all() else [s.filter(f)]
    if search:
        code.note("global search covers every value of every column; the text names the given columns only" if columns else "global search is left out of the text: there is no column to search")
        hay = [f"instr(lower(cast({s.name(c)} AS {'string' if s.spark else 'text'})), {literal(search.lower())}) > 0" for c in columns or []]
        where.append("(" + (" OR ".join(hay) or ("TRUE" if s.spark else "1")) + ")")
    if where:
        text += "\nWHERE " + " AND ".join(f"({w})" if len(where) > 1 else w for w in where)
    if sort:
        code.note("mixed kinds sort differently in SQL; ties follow the order of the file")
        text += f"\nORDER BY {s.path(parse(sort[0]))} {'DESC' if sort[1] else 'ASC'}" + (" NULLS LAST" if sort[1] else " NULLS FIRST")
    if limit is not None:
        text += f"\nLIMIT {limit}" + (f" OFFSET {offset}" if offset else "")
    code.text = text
    return code


def _jq_path(segs: tuple[Seg, ...], base: str = ".") -> str:
    out = base if base != "." else ""
    for s in segs:
        out += "[]?" if s.each else f"[{json.dumps(s.key)}]?"
    return ("." if not out.startswith((".", "$")) else "") + out if out else "."


def _jq_leaf(c: Condition) -> str:
    v = json.dumps(c.value, ensure_ascii=False)
    kind = "boolean" if isinstance(c.value, bool) else "string" if isinstance(c.value, str) else "number"
    if c.op == "in":
        return "(. as $v | " + json.dumps([x for x in c.value or [] if x is not None], ensure_ascii=False) + " | any(.[]; . == $v))"
    if c.op == "contains":
        return f'(type == "string" and (ascii_downcase | contains({v} | ascii_downcase)))' if c.ci else f'(type == "string" and contains({v}))'
    if c.op == "regex":
        return f'(type == "string" and test({v}{"; " + json.dumps("i") if c.ci else ""}))'
    op = {"eq": "==", "ne": "!=", "lt": "<", "lte": "<=", "gt": ">", "gte": ">=", "bool": "=="}.get(c.op)
    if op is None:
        raise FilterError(f"unknown operator {c.op!r}")
    if c.ci and isinstance(c.value, str):
        return f'(type == "string" and (ascii_downcase {op} ({v} | ascii_downcase)))'
    return f"(type == {json.dumps(kind)} and . {op} {v})"


def _jq_filter(f: Filter) -> str:
    parts = []
    for c in f.conditions:
        values = f"[{_jq_path(parse(c.path))}]"
        if c.op == "isnull":
            parts.append(f"({values} | length == 0 or any(.[]; . == null))")
        elif c.op == "notnull":
            parts.append(f"({values} | length > 0 and all(.[]; . != null))")
        else:
            parts.append(f"({values} | any(.[]; . != null and {_jq_leaf(c)}))")
    parts += [f"({_jq_filter(g)})" for g in f.groups]
    out = (" or " if f.combinator == "or" else " and ").join(parts) or ("false" if f.combinator == "or" else "true")
    return f"(({out}) | not)" if f.negate else out


def jq(f: Filter | None = None, search: str = "", sort: tuple[str, bool] | None = None, transform: Transform | None = None, columns: list[str] | None = None, lines: bool = True) -> Code:
    code = Code("")
    _caveats(code, f, "jq")
    steps = [] if f is None or f.match_all() else [f"select({_jq_filter(f)})"]
    if search:
        steps.append(f"select([.. | scalars | select(. != null) | tostring | ascii_downcase] | any(.[]; contains({json.dumps(search.lower(), ensure_ascii=False)})))")
        code.note("jq lowers ASCII letters only")
        code.note("jq writes numbers in its own way before it searches them; here they are searched as the file has them")
    t = transform or Transform()
    specs: list[ColumnSpec] = t.columns(columns or []) if t.select or columns else []
    last = "{" + ", ".join(f"{json.dumps(c.alias or leaf(c.path))}: ([{_jq_path(parse(c.path))}] | .[0])" for c in specs) + "}" if specs else ""
    if sort:
        code.note("sort_by orders kinds as jq does, a missing key as null, and reverse turns ties around")
        inner = " | ".join(["inputs" if lines else ".[]", *steps])
        text = f"[{inner}] | sort_by({_jq_path(parse(sort[0]))})" + (" | reverse" if sort[1] else "") + " | .[]" + (f" | {last}" if last else "")
    else:
        text = " | ".join([*([] if lines else [".[]"]), *steps, *([last] if last else [])]) or "."
    code.text = text
    return code
