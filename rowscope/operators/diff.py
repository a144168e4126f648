"""What changed between two profiles, matched by path, and whether it breaks readers of the old data."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from rowscope.operators.profile import Field, Profile


@dataclass
class Change:
    path: str
    kind: str  # added, removed, changed
    breaking: bool
    details: list[str] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)


@dataclass
class Diff:
    compared: int
    added: int
    removed: int
    changed: int
    breaking: int
    changes: list[Change]
    caveats: list[str]


def _types(f: Field) -> set[str]:
    return {"number" if k in ("int", "float") else k for k, n in f.kinds.items() if n}


def _always(f: Field) -> bool:
    return f.presence_rate >= 1 - 1e-9


def _enum(f: Field) -> set[str] | None:
    if {k for k in f.kinds if k != "null" and f.kinds[k]} != {"string"} or not f.exact or not 2 <= f.distinct <= 10 or len(f.top) != f.distinct:
        return None
    return {v for v, _ in f.top}


def _both(path: str, a: Field, b: Field) -> Change | None:
    out = Change(path, "changed", False)
    old, new = _types(a), _types(b)
    if old != new:
        out.parts.append("type")
        out.details.append(f"types {'|'.join(sorted(old))} -> {'|'.join(sorted(new))}")
        out.breaking |= bool(new - old)
    if _always(a) != _always(b):
        out.parts.append("presence")
        out.details.append("always present -> optional" if _always(a) else "optional -> always present")
        out.breaking |= _always(a)
    x, y = _enum(a), _enum(b)
    if x is not None and y is not None and x != y:
        out.parts.append("enum")
        out.details.append("; ".join(f"{w} {', '.join(sorted(v))}" for w, v in (("new values", y - x), ("gone values", x - y)) if v))
        out.breaking |= bool(y - x)
    return out if out.parts else None


def diff(old: Profile, new: Profile) -> Diff:
    a, b = {f.path: f for f in old.fields}, {f.path: f for f in new.fields}
    changes = []
    for p in sorted(a.keys() | b.keys(), key=lambda s: s.encode()):
        if p not in a:
            changes.append(Change(p, "added", False, ["new field"], ["added"]))
        elif p not in b:
            changes.append(Change(p, "removed", _always(a[p]), ["was always present" if _always(a[p]) else "was optional"], ["removed"]))
        elif (c := _both(p, a[p], b[p])) is not None:
            changes.append(c)
    caveats = [f"{side}: {p.skipped} lines were skipped" for side, p in (("old", old), ("new", new)) if p.skipped]
    caveats += [f"{side}: no records" for side, p in (("old", old), ("new", new)) if not p.records]
    if old.records and new.records and max(old.records, new.records) >= 100 * min(old.records, new.records):
        caveats.append("the sizes differ by a factor of 100 or more")
    count = {k: sum(c.kind == k for c in changes) for k in ("added", "removed", "changed")}
    return Diff(len(a.keys() & b.keys()), count["added"], count["removed"], count["changed"], sum(c.breaking for c in changes), changes, caveats)


def rows(spark: SparkSession, d: Diff) -> DataFrame:
    return spark.createDataFrame([(c.path, c.kind, c.breaking, "; ".join(c.details)) for c in d.changes], "path string, kind string, breaking boolean, details string")


def render(d: Diff, as_json: bool = False) -> str:
    if as_json:
        return json.dumps(asdict(d), indent=2, ensure_ascii=False) + "\n"
    lines = [f"{d.compared} compared, {d.added} added, {d.removed} removed, {d.changed} changed, {d.breaking} breaking"]
    lines += [f"{'BREAKING' if c.breaking else 'ok':8} {c.kind:8} {c.path}: {'; '.join(c.details)}" for c in sorted(d.changes, key=lambda c: (not c.breaking, c.path.encode()))]
    return "\n".join(lines + [f"note: {x}" for x in d.caveats]) + "\n"


def gate(d: Diff, fail_on: str = "breaking") -> int:
    """The exit code: 1 if a change of the named severity exists."""
    return int({"breaking": d.breaking > 0, "any": bool(d.changes), "none": False}[fail_on])
