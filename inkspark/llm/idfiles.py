"""Token-id files: whole texts as ids in ascending doc_id order, range coded, and read back.

A file row is one record of consecutive documents: ``part`` and ``record`` give its place, ``before`` the ids of its part
that come earlier, ``docs`` the documents' ids and lengths, ``data`` the coded ids (see idcoder, whose coder codes whole
records in Spark's JVM, see _jvm). Documents never span records, so records are read back independently; Spark's
committed Parquet files carry the rows, on any store.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _jvm
from ._arrow import bounded, chunks
from ._tokens import ENCODE_BYTES, ID_BYTES, encoder, release

END_ID = 1
#: A record is closed at so many ids; a longer document is a record by itself.
RECORD_IDS = 5_000_000
FILE = "part long, record long, before long, n_ids long, docs binary, data binary"
_RAW = FILE.replace("data", "ids")


def _docs(names: list[int | None], lengths: list[int]) -> bytes:
    known = np.array([x is not None for x in names], np.uint8)
    values = np.array([x or 0 for x in names], "<i8")
    return zlib.compress(known.tobytes() + np.diff(values, prepend=0).astype("<i8").tobytes() + np.array(lengths, "<i8").tobytes(), 6)


def _docs_back(data: bytes) -> tuple[list[int | None], np.ndarray]:
    raw = zlib.decompress(data)
    n = len(raw) // 17
    known, values = np.frombuffer(raw, np.uint8, n), np.cumsum(np.frombuffer(raw, "<i8", n, n))
    return [x if k else None for x, k in zip(values.tolist(), known.tolist(), strict=True)], np.frombuffer(raw, "<i8", n, 9 * n)


def write_ids(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Write the ids of each text and ``end_id`` to ``path``, in ascending doc_id order over parts and records.

    A null text is empty and gives the end id alone; rows that repeat a doc_id are written one after another, by text;
    null doc_ids come first. An empty table writes no record. Rows are dealt to parts by ranges of doc_id and a hash, so
    that even one repeated doc_id is spread.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    rows = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, parts, lengths, state = [], [], [], [0, 0]

        def record() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            row = (TaskContext.get().partitionId(), state[0], state[1], len(ids), _docs(names, lengths), ids.tobytes())
            state[:] = state[0] + 1, state[1] + len(ids)
            for x in (names, parts, lengths):
                x.clear()
            kinds = [pa.int64()] * 4 + [pa.binary()] * 2
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in _RAW.split(", ")])

        held = 0
        try:
            for part in chunks(batches, least=ENCODE_BYTES):
                for name, ids in zip(part.column(0).to_pylist(), encoder(tokenizer).encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    n = len(ids) // ID_BYTES + 1
                    if held and held + n > RECORD_IDS:
                        yield record()
                        held = 0
                    names.append(name)
                    parts.append(ids + end)
                    lengths.append(n)
                    held += n
            if held:
                yield record()
        finally:
            release()

    _jvm.register(docs.sparkSession)
    coded = rows.transform(bounded).mapInArrow(run, _RAW).withColumn("ids", F.call_function("inkspark_encode_ids", "ids"))
    coded.withColumnRenamed("ids", "data").write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, ids, n_tokens)`` of the files: ids as little-endian unsigned 32 bits, start counts all ids before.

    A damaged block is an error that names it. The parts' sizes are few rows, whatever the input.
    """
    files = spark.read.schema(FILE).parquet(path)
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n_part"))
    earlier = F.sum("n_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", F.coalesce(earlier, F.lit(0)).alias("part_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, docs, ids in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                names, lengths = _docs_back(docs)
                ends = np.cumsum(lengths)
                begins = ends - lengths
                cut = [ids[a * ID_BYTES : b * ID_BYTES] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(names), pa.int64()), pa.array(names, pa.int64()), pa.array(before + begins, pa.int64()), pa.array(cut, pa.binary()), pa.array(lengths, pa.int64())],
                    names=["part", "doc_id", "at", "ids", "n_tokens"],
                )

    _jvm.register(spark)
    ids = F.call_function("inkspark_decode_ids", "data").alias("ids")
    decoded = files.select("part", "before", "docs", ids).transform(bounded).mapInArrow(run, "part long, doc_id long, at long, ids binary, n_tokens long")
    placed = decoded.join(F.broadcast(starts), "part")  # one row a part: at most some thousands
    return placed.select("doc_id", (F.col("part_start") + F.col("at")).alias("start"), "ids", "n_tokens")
