"""JSON values as their source wrote them: number texts and the order of keys, which parsed VARIANT values lose."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowscope.paths import Seg, parse


class _Raw(float):
    def __new__(cls, text: str):
        self = super().__new__(cls, text)
        self.text = text
        return self

    def __repr__(self) -> str:
        return self.text


_DECODER = json.JSONDecoder(parse_float=_Raw, parse_int=_Raw, parse_constant=_Raw)


def loads(text: str) -> Any:
    """JSON with numbers that remember their text; what follows the first value is not read."""
    return _DECODER.raw_decode(text.lstrip())[0]


def dumps(x: Any) -> str:
    if isinstance(x, _Raw):
        return x.text
    if isinstance(x, dict):
        return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + dumps(v) for k, v in x.items()) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(dumps, x)) + "]"
    return json.dumps(x, ensure_ascii=False)


def elements(text: str) -> list[str] | None:
    """The source texts of the elements of a JSON array; None for another value."""
    skip = lambda i: next((j for j in range(i, len(text)) if text[j] not in " \t\r\n"), len(text))
    at = skip(0)
    if text[at : at + 1] != "[":
        return None
    out, at = [], skip(at + 1)
    while text[at] != "]":
        _, end = _DECODER.raw_decode(text, at)
        out.append(text[at:end])
        at = skip(end)
        if text[at] == ",":
            at = skip(at + 1)
        elif text[at] != "]":
            raise ValueError(f"not valid JSON at character {at}")
    if skip(at + 1) < len(text):
        raise ValueError("text after the array")
    return out


_MISSING = ...  # a singleton also after pickling


def first(value: Any, segs: tuple[Seg, ...]) -> Any:
    """The first value that a path reaches."""
    for i, s in enumerate(segs):
        if s.each:
            items = value if isinstance(value, list) else []
            return next((x for x in (first(v, segs[i + 1 :]) for v in items) if x is not _MISSING), _MISSING)
        if not isinstance(value, dict) or s.key not in value:
            return _MISSING
        value = value[s.key]
    return value


def exact(paths: list[str]):
    """A function of the source text: the JSON text at each path, null where there is none."""
    steps = [parse(p) for p in paths]

    def one(text: str | None) -> list[str | None]:
        if text is None:
            return [None] * len(steps)
        record = loads(text)
        found = [first(record, s) for s in steps]
        return [None if x is _MISSING else dumps(x) for x in found]

    @F.pandas_udf("array<string>")
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(one)

    return run


def with_exact(df: DataFrame, paths: list[str]) -> tuple[DataFrame, list[Column | None]]:
    """``df`` with the exact texts of ``paths`` in one column, and the column of each; None where no source text is kept."""
    if "_raw" not in df.columns or not paths:
        return df, [None] * len(paths)
    return df.withColumn("_exact", exact(paths)(F.col("_raw"))), [F.get(F.col("_exact"), F.lit(i)) for i in range(len(paths))]
