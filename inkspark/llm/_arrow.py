"""Arrow helpers shared by the operators: whole text columns seen as one byte array."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that a vectorised step looks at together; bounds a worker's scratch memory.
CHUNK_BYTES = 1 << 20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, memoryview]:
    """UTF-8 bytes, row offsets (n + 1) and the same bytes as a memoryview; a null reads as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), memoryview(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    view = memoryview(data if data is not None else b"")[off[0] : off[-1]]
    return np.frombuffer(view, np.uint8), off - off[0], view


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", least: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``least`` bytes of text; a longer row comes alone, whole. Ends with ``trim``."""
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(batch.schema.get_field_index(text))
            size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at, done = 0, 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(size, done + least, "right")))
                yield batch.slice(at, end - at)
                at, done = end, int(size[end - 1])
    finally:
        trim()


def code_points(data: np.ndarray) -> np.ndarray:
    """Running count of code points before each byte (n + 1 entries)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


#: Rows, and bytes of rows, that travel to a Python worker together; texts are long, so both are below the session's defaults.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df, after lowering its session's rows and bytes per Arrow batch: this bounds what a worker and its JVM hold."""
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(str(conf.get(key)).rstrip("bB"))
        if now <= 0 or now > most:
            conf.set(key, most)
    return df


def trim() -> None:
    """Give freed memory back to the system; called when a task ends, since Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)
