"""Which format a file has: by flag, then extension, then first bytes."""

from __future__ import annotations

import os
import tempfile

# Formats by extension, and magic bytes.
EXTENSIONS = {".json": "json", ".ndjson": "json", ".jsonl": "json", ".csv": "csv", ".tsv": "csv", ".tab": "csv", ".parquet": "parquet", ".sqlite": "sqlite", ".sqlite3": "sqlite", ".db": "sqlite"}
MAGIC = ((b"PAR1", "parquet"), (b"SQLite format 3\x00", "sqlite"))


def detect(path: str, head: bytes = b"", flag: str | None = None) -> str:
    if flag:
        if flag not in set(EXTENSIONS.values()) | {"ndjson", "tsv"}:
            raise ValueError(f"unknown format {flag!r}")
        return {"ndjson": "json", "tsv": "csv"}.get(flag, flag)
    kind = EXTENSIONS.get(os.path.splitext(path)[1].lower())
    return kind or next((f for m, f in MAGIC if head.startswith(m)), "json")


def json_mode(path: str, head: bytes = b"", flag: str | None = None) -> str:
    """``lines`` or ``document``."""
    if flag == "ndjson":
        return "lines"
    ext = os.path.splitext(path)[1].lower()
    if ext in (".ndjson", ".jsonl"):
        return "lines"
    if ext == ".json":
        return "document"
    return "document" if head.lstrip(b"\xef\xbb\xbf \t\r\n")[:1] == b"[" else "lines"


def separator(path: str) -> str:
    return "\t" if os.path.splitext(path)[1].lower() in (".tsv", ".tab") else ","


def spool(stream) -> str:
    """Standard input as a temporary file of this machine, for the driver's own command line."""
    with tempfile.NamedTemporaryFile(prefix="rowscope-", delete=False) as f:
        for block in iter(lambda: stream.read(1 << 20), b""):
            f.write(block)
    return f.name
