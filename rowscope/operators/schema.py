"""JSON Schema (Draft 2020-12) from a profile."""

from __future__ import annotations

import json
from dataclasses import dataclass
from dataclasses import field as having
from typing import Any

from rowscope.operators.profile import Field, Profile

# The dialect, and types in their canonical order.
DIALECT = "https://json-schema.org/draft/2020-12/schema"
TYPES = ("object", "array", "string", "number", "integer", "boolean", "null")
_NAME = {"bool": "boolean", "int": "integer", "float": "number"}


@dataclass
class Node:
    field: Field | None = None
    children: dict[str, Node] = having(default_factory=dict)
    items: Node | None = None


def tree(p: Profile) -> Node:
    root = Node()
    for f in p.fields:
        at = root
        for part in [] if f.path == "$" else f.path.split("."):
            key, arrays = part, 0
            while key.endswith("[]"):
                key, arrays = key[:-2], arrays + 1
            if key:
                at = at.children.setdefault(key, Node())
            for _ in range(arrays):
                at.items = at.items or Node()
                at = at.items
        at.field = f
    return root


def types_of(n: Node) -> list[str]:
    have = {_NAME.get(k, k) for k, c in (n.field.kinds if n.field else {}).items() if c}
    have |= {"object"} if n.children else set()
    have |= {"array"} if n.items else set()
    if "number" in have:
        have.discard("integer")
    return [t for t in TYPES if t in have]


def enum_of(n: Node) -> list[str] | None:
    f = n.field
    if f is None or [t for t in types_of(n) if t != "null"] != ["string"] or not f.exact or not 2 <= f.distinct <= 10 or len(f.top) != f.distinct:
        return None
    return sorted(v for v, _ in f.top)


def build(n: Node, records: int, in_array: bool = False) -> dict[str, Any]:
    types = types_of(n)
    parts: dict[str, dict[str, Any]] = {t: {"type": t} for t in types}
    if "object" in parts and n.children:
        parts["object"]["properties"] = {k: build(c, (n.field.presence if n.field else records), in_array) for k, c in sorted(n.children.items())}
        base = n.field.presence if n.field else records
        needed = [] if in_array else sorted(k for k, c in n.children.items() if c.field and c.field.presence >= base)
        if needed:
            parts["object"]["required"] = needed
    if "array" in parts and n.items:
        parts["array"]["items"] = build(n.items, records, True)
    enum = enum_of(n)
    if enum is not None:
        parts["string"]["enum"] = enum
    if len(parts) == 1:
        return next(iter(parts.values()))
    if set(parts) == {"string", "null"} and enum is not None:
        return {"type": ["string", "null"], "enum": [*enum, None]}
    if all(len(x) == 1 for x in parts.values()):
        return {"type": list(parts)} if parts else {}
    rich = [x for x in parts.values() if len(x) > 1]
    if len(rich) == 1 and len(parts) == 2 and "null" in parts and "enum" not in rich[0]:
        return rich[0] | {"type": [rich[0]["type"], "null"]}
    return {"anyOf": list(parts.values())}


def json_schema(p: Profile) -> dict[str, Any]:
    return {"$schema": DIALECT} | build(tree(p), p.records)


def text(p: Profile) -> str:
    return json.dumps(json_schema(p), indent=2, ensure_ascii=False) + "\n"
