"""Shared pieces: table reading, shared-folder tables, Arrow text batches and tokenisation.

Python stages run over Arrow batches cut into slices of bounded bytes, so a worker's memory follows the
largest single document and not the batch.  Intermediate tables live in the folder the cluster names in
``spark.checkpoint.dir``; reading them back cuts the lineage, so a lost executor costs a re-read and no more.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 19
#: Bytes of an Arrow batch on its way to Python; Spark's own limit is eight times this.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Hold batches of rows with long texts small, unless the session has a limit of its own."""
    if spark.conf.get(_BATCH, None) in (None, str(64 << 20), f"{64 << 20}b"):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only where none is set (tests, one machine) a folder of the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return base.rstrip("/")


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; the shuffle files of the write go when it is done."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/rowscope-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Delete stored tables that no later plan reads."""
    for t in tables:
        path = getattr(t, "_stored_at", None)
        if path:
            spark = t.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice holds about ``limit`` bytes of ``column`` (one text at least)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(size):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(size):
        yield batch.slice(start)


def map_text(df: DataFrame, column: str, fn: Callable[[pa.RecordBatch], dict], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` over byte-bounded slices.  ``fn`` returns the new columns, the others of ``schema`` are carried over."""
    want = [f.name for f in schema.fields]
    arrow = _arrow_schema(schema)

    def run(batches):
        for whole in batches:
            for part in slices(whole, column):
                new = fn(part)
                cols = [new[n] if n in new else part.column(n) for n in want]
                cols = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=arrow.field(n).type) for n, c in zip(want, cols, strict=True)]
                yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], names=want)

    return df.mapInArrow(run, schema)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def texts(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The column as strings, null as empty."""
    return pc.fill_null(batch.column(column).cast(pa.large_string()), "")


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_string array; offsets start at 0."""
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def lower_az(buf: np.ndarray) -> np.ndarray:
    """A copy of the bytes with A-Z lowered."""
    low = buf.copy()
    low[(buf >= 65) & (buf <= 90)] += 32
    return low


def strings(buf: np.ndarray, off: np.ndarray) -> list[str]:
    data = buf.tobytes()
    return [data[a:b].decode("utf-8") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words_of(buf: np.ndarray, off: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends (byte positions) and their document, in a buffer of concatenated texts.

    ``gap[b]`` says which bytes separate words; a text's end always does.
    """
    n = len(buf)
    inside = ~gap[buf] if n else np.zeros(0, bool)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start = inside & (np.r_[True, ~inside[:-1]] | edge[:n]) if n else inside
    end = inside & (np.r_[~inside[1:], True] | edge[1:]) if n else inside
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(off, s, side="right") - 1


def per_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n) if len(doc) else np.zeros(n)


def sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of a per-byte array over each text."""
    c = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return c[off[1:]] - c[off[:-1]]


def fits_broadcast(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has at most ``most`` rows; looks at no more than ``most`` + 1 of them."""
    return df.limit(most + 1).count() <= most


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", most: int = 100_000) -> DataFrame:
    """Broadcast ``small`` only where its row count is checked to be small; else a shuffle join that AQE may split."""
    return big.join(F.broadcast(small) if fits_broadcast(small, most) else small, on, how)
