"""Paths: ``a.b`` steps into objects, ``a[]`` into any element, ``["a.b"]`` quotes a key, ``$`` is the record."""

from __future__ import annotations

import re
from dataclasses import dataclass

_STEP = re.compile(r'\["((?:[^"\\]|\\.)*)"\]|\[\]|([^.\[\]]+)')


class PathError(ValueError):
    """A path that does not parse."""


@dataclass(frozen=True)
class Seg:
    """One step: a key, or any element of an array."""

    key: str | None = None

    @property
    def each(self) -> bool:
        return self.key is None


def parse(path: str) -> tuple[Seg, ...]:
    if path in ("", "$"):
        return ()
    out: list[Seg] = []
    at = 0
    while at < len(path):
        if path[at] == ".":
            if not out or at + 1 == len(path) or path[at + 1] in ".[":
                raise PathError(f"stray dot in {path!r}")
            at += 1
        elif out and path[at] != "[":
            raise PathError(f"missing dot in {path!r}")
        m = _STEP.match(path, at)
        if not m:
            raise PathError(f"malformed brackets in {path!r}")
        out.append(Seg() if m[0] == "[]" else Seg(re.sub(r"\\(.)", r"\1", m[1]) if m[1] is not None else m[2]))
        at = m.end()
    return tuple(out)


def render(segs: tuple[Seg, ...]) -> str:
    out = ""
    for s in segs:
        if s.each:
            out += "[]"
        elif re.search(r'[.\[\]"\\]', s.key or "") or not s.key:
            out += '["' + re.sub(r'(["\\])', r"\\\1", s.key or "") + '"]'
        else:
            out += ("." if out else "") + s.key
    return out or "$"


def leaf(path: str) -> str:
    """The last key of a path, as its display name."""
    keys = [s.key for s in parse(path) if not s.each]
    return keys[-1] if keys else path


def nested(path: str, under: str) -> bool:
    return path == under or path.startswith((under + ".", under + "[]", under + "["))
