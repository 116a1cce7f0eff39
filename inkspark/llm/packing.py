"""Packing documents into sequences: first-fit decreasing with a tournament tree, in randomised groups.

Rows are dealt to groups by a hash of their contents and their place in the input, so that copies of a row are dealt apart
like any others; a group has about ``group_docs`` documents and ``group_bytes`` of text, and is packed alone. In a group, a
document of more than ``size`` ids gives full sequences from its start; the rests go, longest first, each to the first sequence with
room, found from the root of a tournament tree whose inner nodes hold the largest free capacity below. Cutting is free, so
the emptiest sequences are then cut to top up the fullest, and the one that stays short is cut into sequences of powers of
two, which need no padding either: a group of n ids leaves no padding at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import bounded, chunks
from ._tokens import ENCODE_BYTES, ID_BYTES, encoder, release

SIZE = 4096
END_ID = 2
GROUP_DOCS, GROUP_BYTES = 1024, 8 << 20
#: Bytes of ids that a worker hands back together; a group has some times as many.
OUT_BYTES = 2 << 20
#: (row, start, length): a stretch of a document's ids.
Piece = tuple[int, int, int]
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Capacities:
    """Tournament tree over the free capacities of ``bins`` bins, all ``size`` at first."""

    def __init__(self, bins: int, size: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [size] * (2 * self.leaves)

    def place(self, need: int) -> int:
        """Take ``need`` from the first bin that has it; there must be one."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < need:
                node += 1
        found = node - self.leaves
        free[node] -= need
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
        return found


def first_fit_decreasing(rests: list[Piece], size: int) -> list[list[Piece]]:
    bins: list[list[Piece]] = []
    tree = Capacities(len(rests), size)
    for piece in sorted(rests, key=lambda p: -p[2]):
        at = tree.place(piece[2])
        if at == len(bins):
            bins.append([])
        bins[at].append(piece)
    return bins


def topped_up(bins: list[list[Piece]], size: int) -> list[list[Piece]]:
    """The bins with the emptiest cut up to fill the others; at most one stays short, and comes last."""
    used = [sum(p[2] for p in b) for b in bins]
    full = [b for b, n in zip(bins, used, strict=True) if n == size]
    short = sorted(((n, k) for k, n in enumerate(used) if n < size), reverse=True)
    give = len(short) - 1
    stock = {k: list(bins[k]) for _, k in short}
    for at, (n, k) in enumerate(short):
        while n < size and give > at:
            donor = stock[short[give][1]]
            if not donor:
                give -= 1
                continue
            row, start, length = donor.pop()
            take = min(length, size - n)
            stock[k].append((row, start, take))
            if take < length:
                donor.append((row, start + take, length - take))
            n += take
    left = [stock[k] for _, k in short if stock[k]]
    return full + sorted(left, key=lambda b: -sum(p[2] for p in b))


def powers_of_two(pieces: list[Piece]) -> list[list[Piece]]:
    """Sequences of falling powers of two that hold the pieces in order."""
    total, rest, out = sum(p[2] for p in pieces), list(reversed(pieces)), []
    for bit in reversed(range(total.bit_length())):
        if total >> bit & 1:
            room, own = 1 << bit, []
            while room:
                row, start, length = rest.pop()
                take = min(room, length)
                own.append((row, start, take))
                if take < length:
                    rest.append((row, start + take, length - take))
                room -= take
            out.append(own)
    return out


def pack(lengths: list[int], size: int = SIZE) -> list[list[Piece]]:
    """Sequences of pieces that hold each of the lengths' ids exactly once; all full but powers of two at the end."""
    whole = [[(row, at, size)] for row, n in enumerate(lengths) for at in range(0, n - n % size, size)]
    rests = [(row, n - n % size, n % size) for row, n in enumerate(lengths) if n % size]
    bins = topped_up(first_fit_decreasing(rests, size), size)
    if bins and sum(p[2] for p in bins[-1]) < size:
        bins = bins[:-1] + powers_of_two(bins[-1])
    return whole + bins


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])


def _pieces(group: int, names: list[int | None], ids: list[bytes], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of a group's pieces, in batches of about OUT_BYTES."""
    lengths, out, held = [len(x) // ID_BYTES for x in ids], [], 0
    for nth, sequence in enumerate(pack(lengths, size)):
        at = 0
        for row, start, n in sequence:
            out.append((names[row], start, n, ids[row][start * ID_BYTES : (start + n) * ID_BYTES], lengths[row], (group << 32) + nth, at))
            at += n
        held += at * ID_BYTES
        if held >= OUT_BYTES:
            yield _batch(out)
            out, held = [], 0
    if out:
        yield _batch(out)


def packed(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    end_id: int = END_ID,
    group_docs: int = GROUP_DOCS,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32 bits), doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone; repeated rows, and rows of one doc_id, are documents of their own; other
    columns are not looked at. An empty table gives no rows. docs must read the same rows in the same partitions again if a
    task is repeated, as a table does. A task holds one group's ids at a time, and texts in Arrow batches.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    n, n_bytes = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    groups = max(1, -(-n // group_docs), -(-n_bytes // group_bytes))
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    rows = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "text", "place"), F.lit(groups)))
    dealt = rows.select("doc_id", "text", "group", "place").repartition("group").sortWithinPartitions("group", "place").select("doc_id", "text", "group")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, ids = None, [], []
        try:
            for part in chunks(batches, least=ENCODE_BYTES):
                texts = encoder(tokenizer).encode([t or "" for t in part.column(1).to_pylist()])
                for group, name, own in zip(part.column(2).to_pylist(), part.column(0).to_pylist(), texts, strict=True):
                    if group != now and ids:
                        yield from _pieces(now, names, ids, size)
                        names, ids = [], []
                    now = group
                    names.append(name)
                    ids.append(own + end)
            if ids:
                yield from _pieces(now, names, ids, size)
        finally:
            release()

    return dealt.transform(bounded).mapInArrow(run, SCHEMA)
