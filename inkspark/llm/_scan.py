"""Finding spans in a block of whole texts seen as one byte string."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._arrow import bounded, chunks, text_bytes

SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
#: (kind, start, end) in bytes of the block.
Found = list[tuple[str, int, int]]


class Block:
    """Texts joined by line feeds, which no pattern of ours can cross."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.data = b"\n".join([*texts, b""])
        self.bytes = np.frombuffer(self.data, np.uint8)
        self.starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self._points: np.ndarray | None = None

    def rows(self, at: list[int]) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def points(self, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Code points between the start of the row and the byte."""
        if self._points is None:
            self._points = np.concatenate([[0], np.cumsum((self.bytes & 0xC0) != 0x80)])
        return self._points[at] - self._points[self.starts[rows]]

    def finds(self, literal: bytes, data: bytes | None = None) -> list[int]:
        data, out, at = self.data if data is None else data, [], 0
        while (at := data.find(literal, at)) >= 0:
            out.append(at)
            at += 1
        return out

    def runs(self, member: np.ndarray, least: int) -> list[tuple[int, int]]:
        """Maximal runs of at least ``least`` bytes of the class ``member`` (bool[256])."""
        if len(self.bytes) < least:
            return []
        inside = member[self.bytes]
        core, have = inside, 1
        while have < least:  # after this, core[i] tells that the ``have`` bytes from i on are members
            step = min(have, least - have)
            core = core[: len(core) - step] & core[step:]
            have += step
        hits = np.flatnonzero(core)
        if not len(hits):
            return []
        first = hits[np.concatenate([[True], np.diff(hits) > 1])]
        last = hits[np.concatenate([np.diff(hits) > 1, [True]])] + least
        return list(zip(first.tolist(), last.tolist(), strict=True))

    def matches(self, pattern: re.Pattern[bytes], at: list[int]) -> Iterator[re.Match[bytes]]:
        """Leftmost non-overlapping matches, given all places where one can start."""
        end = 0
        for k in sorted(set(at)):
            if k >= end and (m := pattern.match(self.data, k)):
                yield m
                end = m.end()


def byte_class(text: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(text.encode())] = True
    return out


def scan(docs: DataFrame, find: Callable[[Block], Found], keep: list[str], text_col: str = "text", out_col: str = "found", map_texts: Callable | None = None) -> DataFrame:
    """The ``keep`` columns of docs and ``out_col``, the spans of the text in code points, by start.

    A null text has no spans. A column of docs named like ``out_col`` is replaced.
    """
    keep = [c for c in keep if c != out_col]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(out_col, SPAN)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "__text"):
            _, off, view = text_bytes(part.column(len(keep)))
            at = off.tolist()
            block = Block([bytes(view[i:j]) for i, j in zip(at, at[1:], strict=False)])
            found = sorted(find(block), key=lambda x: x[1])
            first, last = (np.array([x[k] for x in found], np.int64) for k in (1, 2))
            rows = block.rows(first)
            a, b = (block.points(x, rows) if len(found) else x for x in (first, last))
            ends = np.searchsorted(rows, np.arange(part.num_rows), "right")
            spans = pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], fields=list(ARROW_SPAN.value_type))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), spans, type=ARROW_SPAN)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], lists], names=schema.names)

    return docs.select(*keep, docs[text_col].cast("string").alias("__text")).transform(bounded).mapInArrow(run, schema)


def ordered(column: str, kinds: list[str], by_kind: bool) -> str:
    """SQL of the span array ``column`` limited to ``kinds``, by kind as listed and start, or by start and kind."""
    place = f"array_position(array({', '.join(map(repr, kinds))}), {{0}}.kind)"
    keys = [place, "{0}.start"] if by_kind else ["{0}.start", place]
    pair = "struct({})".format
    left, right = (pair(", ".join(k.format(x) for k in [*keys, "{0}.end"])) for x in ("l", "r"))
    return f"array_sort(filter({column}, x -> {place.format('x')} > 0), (l, r) -> CASE WHEN {left} < {right} THEN -1 WHEN {left} > {right} THEN 1 ELSE 0 END)"


def rendered(array: str) -> str:
    return f"array_join(transform({array}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
