"""Copies of JSON sources with edited values: edits join by ordinal, and only records with edits are rewritten."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscope.functions.access import ORD, RECORD
from rowscope.functions.literals import dumps, loads
from rowscope.operators.sinks import check_target, replacing
from rowscope.paths import Seg, parse
from rowscope.sources.readers import Source


@dataclass(frozen=True)
class Edit:
    ordinal: int
    path: str
    value: Any


def put(record: Any, segs: tuple[Seg, ...], value: Any) -> bool:
    """Set a value, making parents that are absent; False for array elements and below scalars."""
    if not segs or any(s.each for s in segs) or not isinstance(record, dict):
        return False
    at = record
    for s in segs[:-1]:
        if at.get(s.key) is None:
            at[s.key] = {}
        at = at[s.key]
        if not isinstance(at, dict):
            return False
    at[segs[-1].key] = value
    return True


def edited(source: Source, edits: list[Edit]) -> DataFrame:
    """(_ord, text, unapplied): each record's text with its edits; records without edits keep theirs and meet no Python."""
    spark = source.df.sparkSession
    base = source.df.select(ORD, (F.col("_raw") if "_raw" in source.df.columns else F.to_json(RECORD)).alias("text"))
    table = spark.createDataFrame([(e.ordinal, e.path, json.dumps(e.value)) for e in edits], f"{ORD} long, path string, value string")
    # edits are typed by hand and passed as a list, which bounds what is broadcast
    lists = table.groupBy(ORD).agg(F.collect_list(F.struct("path", "value")).alias("edits"))

    def apply(batches):
        for b in batches:
            texts, bad = [], []
            for text, own in zip(b.column("text").to_pylist(), b.column("edits").to_pylist(), strict=True):
                record = loads(text)
                bad.append(sum(not put(record, parse(e["path"]), json.loads(e["value"])) for e in own))
                texts.append(dumps(record))
            yield pa.RecordBatch.from_arrays([b.column(ORD), pa.array(texts, pa.string()), pa.array(bad, pa.int32())], names=[ORD, "text", "unapplied"])

    done = base.join(F.broadcast(lists), ORD).mapInArrow(apply, f"{ORD} long, text string, unapplied int")
    rest = base.join(F.broadcast(lists.select(ORD)), ORD, "left_anti")
    return rest.select(ORD, "text", F.lit(0).alias("unapplied")).unionAll(done)


def save_edits(source: Source, edits: list[Edit], target: str, lines: bool = True) -> tuple[int, int]:
    """Write all records with edits applied; returns (records, edits not applied)."""
    if source.format != "json":
        raise ValueError("only JSON sources can be saved with edits")
    check_target(target, source.path)
    n = bad = 0
    with replacing(target) as out:
        out.write(b"" if lines else b"[")
        for r in edited(source, edits).orderBy(ORD).toLocalIterator():
            out.write((r["text"] + "\n").encode() if lines else ((",\n" if n else "\n") + r["text"]).encode())
            n, bad = n + 1, bad + r["unapplied"]
        out.write(b"" if lines else b"\n]\n" if n else b"]\n")
    known = {e.ordinal for e in edits if 0 <= e.ordinal < n}
    return n, bad + sum(e.ordinal not in known for e in edits)
