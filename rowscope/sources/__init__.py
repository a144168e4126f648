"""Readers: JSON, NDJSON, CSV, TSV, Parquet and SQLite as DataFrames with a stable ordinal."""

from rowscope.sources.readers import Source, open_source

__all__ = ["Source", "open_source"]
