"""Vectorised document statistics over a buffer of concatenated UTF-8 texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from rowscope.llm.common import _SPACE, per_doc, raw, sums, words_of

_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)
# a second family of hashes, for ranges whose equality must hold beyond 64 bits
_VALUE2 = _rng.integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE2 = 0xC2B2AE3D27D4EB4F | 1
_INV2 = pow(_BASE2, -1, 2**64)
_tables: dict[str, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    t = _tables.get(str(base))
    if t is None or len(t) < n:
        a = np.full(max(n, 1 << 16), base, np.uint64)
        a[0] = 1
        t = _tables[str(base)] = np.cumprod(a, dtype=np.uint64)
    return t[:n]


class Hasher:
    """64-bit hashes of any byte ranges of a buffer, from one running sum of value * base^position."""

    def __init__(self, buf: np.ndarray, second: bool = False):
        n = len(buf)
        value, base, inv = (_VALUE2, _BASE2, _INV2) if second else (_VALUE, _BASE, _INV)
        self.inv = _powers(inv, n + 1)
        self.c = np.zeros(n + 1, np.uint64)
        np.cumsum(value[buf] * _powers(base, n), dtype=np.uint64, out=self.c[1:])

    def range(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return (self.c[e] - self.c[s]) * self.inv[s]

    def grams(self, k: int) -> np.ndarray:
        """The hash of each ``k`` bytes, by start."""
        return (self.c[k:] - self.c[:-k]) * self.inv[: len(self.c) - k]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found twice or more, not the first of its kind) of each key, in order of position."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.r_[False, k[1:] == k[:-1]] if len(k) else np.zeros(0, bool)
    twice = same | np.r_[same[1:], False] if len(k) else same
    a, b = np.zeros(len(k), bool), np.zeros(len(k), bool)
    a[order], b[order] = twice, same
    return a, b


# The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
_flag = {
    "symbols": np.isin(np.arange(256), list(SYMBOLS)),
    "upper": np.isin(np.arange(256), list(range(65, 91))),
    "digit": np.isin(np.arange(256), list(range(48, 58))),
    "bang": np.isin(np.arange(256), list(b"!?")),
    "stop": np.isin(np.arange(256), list(b".,;:")),
    "slash": np.isin(np.arange(256), list(b"/\\@_=+~^{}[]()")),
}
FEATURES = ["log_words", "word_len", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "bang_rate", "stop_rate", "slash_share", "line_words", "unique_share", "short_share"]


def measure(arr: pa.Array) -> dict[str, np.ndarray]:
    """Counts of each text: ``n_words word_chars n_symbols n_dup_lines n_repeat_words`` and a few more."""
    buf, off = raw(arr)
    n = len(off) - 1
    s, e, doc = words_of(buf, off)
    h = Hasher(buf)
    lead = (buf & 0xC0) != 0x80  # the first byte of each character
    words = np.bincount(doc, minlength=n).astype(np.int64)
    out = {"n_words": words, "word_chars": sums(lead & ~_SPACE[buf], off)}
    out["n_symbols"] = sums(_flag["symbols"][buf], off)
    salt = mix(doc.astype(np.uint64) + np.uint64(1))
    w = mix(h.range(s, e) + (e - s).astype(np.uint64))
    if len(w) > 2:
        tri = mix(w[:-2] * np.uint64(3) + mix(w[1:-1] * np.uint64(5) + mix(w[2:]))) ^ salt[:-2]
        own = np.flatnonzero(doc[:-2] == doc[2:])
        twice, _ = _repeats(tri[own])
        at = own[twice]
        cover = np.zeros(len(w), bool)
        for d in range(3):
            cover[at + d] = True
        out["n_repeat_words"] = per_doc(cover, doc, n).astype(np.int64)
    else:
        out["n_repeat_words"] = np.zeros(n, np.int64)
    _, later = _repeats(w ^ salt)
    out["n_unique"] = words - per_doc(later, doc, n).astype(np.int64)
    breaks = np.flatnonzero(buf == 10)
    ls = np.unique(np.r_[off[:-1], breaks + 1])
    ls = ls[ls < len(buf)]
    ls = ls[buf[ls] != 10]  # empty lines have no word
    cut = np.unique(np.r_[breaks, off[1:]])
    le = cut[np.searchsorted(cut, ls, side="right")]
    ld = np.searchsorted(off, ls, side="right") - 1
    first = np.searchsorted(s, ls)
    has = np.zeros(len(ls), bool)
    ok = first < len(s)
    has[ok] = s[first[ok]] < le[ok]
    ls, le, ld = ls[has], le[has], ld[has]
    _, dup = _repeats(mix(h.range(ls, le) + (le - ls).astype(np.uint64)) ^ mix(ld.astype(np.uint64) + np.uint64(1)))
    out["n_dup_lines"] = per_doc(dup, ld, n).astype(np.int64)
    out["n_lines"] = np.bincount(ld, minlength=n).astype(np.int64)
    for k in ("upper", "digit", "bang", "stop", "slash"):
        out[k] = sums(_flag[k][buf], off)
    out["n_short"] = per_doc((e - s) <= 3, doc, n)
    return out


def features(m: dict[str, np.ndarray]) -> np.ndarray:
    words, chars, lines = (np.maximum(1, m[k]).astype(float) for k in ("n_words", "word_chars", "n_lines"))
    cols = [
        np.log1p(m["n_words"]), m["word_chars"] / words, m["n_symbols"] / chars, m["n_dup_lines"] / lines, m["n_repeat_words"] / words, m["upper"] / chars,
        m["digit"] / chars, m["bang"] / words, m["stop"] / words, m["slash"] / chars, np.log1p(words / lines), m["n_unique"] / words, m["n_short"] / words,
    ]
    return np.stack([np.asarray(c, float) for c in cols], 1)
