"""The dashboard model: a card for each path, badges, a health score, key figures; and the view of a diff."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from rowscope.operators.diff import Diff
from rowscope.operators.profile import Field, Profile

# Limits of chart forms, null bands, badge penalties and grades.
MOST_DISCRETE, MOST_CATEGORIES, TOP_BARS = 12, 25, 10
BANDS = ((1.0, "critical"), (0.5, "serious"), (0.2, "warning"))
PENALTY = {"good": 0.0, "warning": 0.15, "serious": 0.5, "critical": 1.0}
GRADES = ((90, "A"), (75, "B"), (50, "C"), (25, "D"))
SHOWN = ("bool", "int", "float", "string", "array", "object")


@dataclass
class Card:
    path: str
    form: str
    null_band: str
    badges: list[tuple[str, str]]
    bars: list[dict[str, Any]] = field(default_factory=list)
    stats: list[tuple[str, str]] = field(default_factory=list)
    mix: list[tuple[str, float]] = field(default_factory=list)
    spark: list[float] = field(default_factory=list)
    samples: list[str] = field(default_factory=list)


@dataclass
class Model:
    kpis: list[tuple[str, str]]
    badges: list[tuple[str, str]]
    score: int
    grade: str
    cards: list[Card]


def non_null(f: Field) -> int:
    return f.observations - f.kinds.get("null", 0)


def form(f: Field) -> str:
    own = {k for k, n in f.kinds.items() if n and k != "null"}
    if not own:
        return "empty"
    if f.drift:
        return "mixed"
    if own <= {"int", "float"}:
        return "categorical" if 0 < f.distinct <= MOST_DISCRETE else "histogram" if f.bars else "meter"
    if own == {"string"}:
        return "categorical" if f.distinct <= MOST_CATEGORIES else "high_cardinality"
    return "array" if own == {"array"} else "meter"


def null_band(rate: float) -> str:
    return next((name for low, name in BANDS if rate >= low), "good")


def badges(f: Field) -> list[tuple[str, str]]:
    """(name, severity), worst first."""
    out = []
    if f.observations and not non_null(f):
        out.append(("all_null", "critical"))
    elif f.null_rate >= 0.5:
        out.append(("null_high", "serious"))
    elif f.null_rate >= 0.2:
        out.append(("null_elevated", "warning"))
    if f.drift:
        out.append(("type_drift", "serious"))
    if set(f.kinds) - {"null"} == {"string"} and f.distinct > MOST_CATEGORIES and f.distinct >= 0.9 * non_null(f):
        out.append(("high_cardinality", "good"))
    if f.distinct == 1 and non_null(f) > 1:
        out.append(("constant", "warning"))
    return sorted(out, key=lambda b: -PENALTY[b[1]]) or [("clean", "good")]


def score(p: Profile) -> int:
    worst = [max(PENALTY[s] for _, s in badges(f)) for f in p.fields]
    health = 100 * (1 - sum(worst) / len(worst)) if worst else 100
    lines = p.records + p.skipped
    return round(min(100, max(0, health - round(20 * p.skipped / lines if lines else 0))))


def grade(s: int) -> str:
    return next((g for low, g in GRADES if s >= low), "F")


def human(x: float | None) -> str:
    if x is None:
        return "-"
    if abs(x) >= 1e4:
        for unit, size in (("T", 1e12), ("B", 1e9), ("M", 1e6), ("K", 1e3)):
            if abs(x) >= size:
                return f"{x / size:.1f}".rstrip("0").rstrip(".") + unit
    return f"{x:,.0f}" if float(x).is_integer() else f"{x:,.2f}".rstrip("0").rstrip(".")


def card(f: Field, p: Profile) -> Card:
    kind, total = form(f), max(1, non_null(f))
    c = Card(f.path, kind, null_band(f.null_rate), badges(f))
    c.mix = [(k, f.kinds[k] / total) for k in SHOWN if f.kinds.get(k)]
    if kind == "categorical":
        c.bars = [{"label": v, "count": n, "share": n / total} for v, n in f.top[:TOP_BARS]]
        rest = total - sum(n for _, n in f.top[:TOP_BARS])
        if rest > 0 and f.distinct > len(c.bars):
            c.bars.append({"label": "other", "count": rest, "share": rest / total})
    elif kind == "histogram":
        c.bars = [{"low": a, "high": b, "count": n} for a, b, n in f.bars]
        most = max((n for *_, n in f.bars), default=0) or 1
        c.spark = [n / most for *_, n in f.bars]
    elif kind == "high_cardinality":
        c.samples = [v for v, _ in f.top[:5]]
    elif kind == "array" and (inner := p.get(f.path + "[]")) is not None:
        c.bars = [{"label": k, "count": n, "share": n / inner.observations} for k, n in inner.kinds.items()]
    if f.min is not None:
        c.stats = [("min", human(f.min)), ("mean", human(f.mean)), ("median", human(f.median)), ("p95", human(f.p95)), ("max", human(f.max)), ("distinct", human(f.distinct))]
    elif f.min_len is not None:
        c.stats = [("distinct", human(f.distinct)), ("unique", f"{100 * f.distinct / total:.0f}%"), ("bytes", f"{f.min_len}-{f.max_len}")]
    return c


def model(p: Profile, format: str = "") -> Model:
    cards = [card(f, p) for f in p.fields]
    s = score(p)
    warn = sum(any(v != "good" for _, v in c.badges) for c in cards)
    own = [("no_records", "critical")] * (not p.records) + [("skipped_records", "warning")] * bool(p.skipped)
    return Model([("records", human(p.records)), ("fields", human(len(cards))), ("format", format), ("warnings", human(warn)), ("health", f"{s} {grade(s)}")], own, s, grade(s), cards)


def diff_model(d: Diff) -> dict[str, Any]:
    def named(c) -> list[str]:
        out = {"added": ["field_added"], "removed": ["field_removed"]}.get(c.kind, [f"{x}_changed" for x in c.parts])
        return out + ["breaking"] * c.breaking

    groups = {k: [{"path": c.path, "severity": "critical" if c.breaking else "good" if k == "added" else "warning", "badges": named(c), "details": c.details} for c in d.changes if c.kind == k] for k in ("added", "removed", "changed")}
    verdict = "breaking" if d.breaking else "compatible" if d.changes else "identical"
    return {"verdict": verdict, "kpis": {"compared": d.compared, "added": d.added, "removed": d.removed, "changed": d.changed, "breaking": d.breaking}, "groups": groups, "caveats": d.caveats}
