"""SimHash near-duplicate groups by anchor-point covering.

Contract of the texts: A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, shingles are ``shingle`` words joined by one
space, repeats included. A text of fewer words is one shingle; a text without words (null included) has fingerprint 0.
A fingerprint bit is 1 if it is set in over half of the shingles' XXH64 (seed 42).

Method. Two fingerprints at Hamming distance 2 or less are at distance 1 or less in one of their two 32-bit halves. On a
half, the anchors are the words of the perfect [31, 26] Hamming code times the free top bit: covering radius R = 1, so each
half has one *home* anchor within R, and the half of every partner lies within R + 1 = 2 of that anchor. Each half is
replicated to all its (at most 17) anchors within R + 1 and compared there with the halves at home. Equal fingerprints
are one row from the start, so a group of exact copies, however large, is a single fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ._arrow import bounded, chunks, text_bytes
from ._stash import stash
from .components import components

SEED = 42
SEGMENT = 65535  # shingles that a 16-bit lane can count
LANES = np.uint64(0x0001000100010001)


def fingerprints(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """The uint64 fingerprint of each text (UTF-8)."""
    hashes, sizes = [], np.zeros(len(texts), np.int64)
    for row, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        if len(words) < shingle:
            grams = iter((b" ".join(words),))
            n = 1
        else:
            n = len(words) - shingle + 1
            grams = map(b" ".join, zip(*(islice(words, k, None) for k in range(shingle)), strict=False))
        hashes.append(np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), np.uint64, n))
        sizes[row] = n
    out = np.zeros(len(texts), np.uint64)
    rows = np.flatnonzero(sizes)
    if not len(rows):
        return out
    every, n = np.concatenate(hashes), sizes[rows]
    # cut long documents into segments whose counts fit a lane; segment sums are added up per document
    parts = -(-n // SEGMENT)
    first = np.cumsum(parts) - parts
    nth = np.arange(parts.sum()) - np.repeat(first, parts)
    starts = np.repeat(np.cumsum(n) - n, parts) + nth * SEGMENT
    for k in range(16):
        sums = np.add.reduceat((every >> np.uint64(k)) & LANES, starts)
        for lane in range(4):
            count = np.add.reduceat(((sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64), first)
            out[rows] |= (2 * count > n).astype(np.uint64) << np.uint64(k + 16 * lane)
    return out


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, fp, mark)``: one row per row of docs; fp holds the 64 bits as a signed long, mark is the text's xxhash64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            _, off, view = text_bytes(part.column(1))
            at = off.tolist()
            bits = fingerprints([bytes(view[i:j]) for i, j in zip(at, at[1:], strict=False)], shingle)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bits.view(np.int64)), part.column(2)], names=["doc_id", "fp", "mark"])

    text = docs[text_col].cast("string").alias("text")
    kept = docs.select(docs[id_col].cast("long").alias("doc_id"), text, F.xxhash64(text).alias("mark"))
    return kept.transform(bounded).mapInArrow(run, "doc_id long, fp long, mark long")


def _parity_masks() -> list[int]:
    """Mask j holds the bits of a 31-bit word whose position (from 1) has bit j: the check matrix of the code."""
    return [sum(1 << (i - 1) for i in range(1, 32) if i >> j & 1) for j in range(5)]


def _anchored(half: str, which: int) -> tuple[str, str]:
    """SQL of a half's home anchor, and of all anchors within distance 2; ``which`` keeps the halves apart."""
    syndrome = " + ".join(f"shiftleft(bit_count({half} & {m}L) & 1, {j})" for j, m in enumerate(_parity_masks()))
    flip = "if({0} = 0, 0L, shiftleft(1L, {0} - 1))".format
    tag, top = which << 32, 1 << 31
    home = f"({half} ^ {flip('s')}) + {tag}L"
    # words at distance 2 whose two flips have positions i and i ^ s; i = 0 stands for no flip, so this holds the home too
    near = f"transform(filter(sequence(0, 31), i -> i < (i ^ s)), i -> ({half} ^ {flip('i')} ^ {flip('(i ^ s)')}) + {tag}L)"
    other = f"({half} ^ {flip('s')} ^ {top}L) + {tag}L"
    every = f"if(s = 0, array({home}, {other}), concat({near}, array({other})))"
    return (f"transform(array({syndrome}), s -> {home})[0]", f"transform(array({syndrome}), s -> {every})[0]")


def near_pairs(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Distinct ``(fp, node)`` rows to links ``(a, b)`` of nodes, a < b, whose fingerprints differ in 1 to distance bits.

    Exact for distances up to 3 (one half then differs in one bit at most). A fingerprint has 2 home rows and at most 34
    visiting rows, and at most 2,080 partners at distance 2, so no group's square is ever emitted.
    """
    if not 0 <= distance <= 3:
        raise ValueError("anchors of covering radius 1 on two halves serve distances 0 to 3")
    sides = [_anchored("shiftrightunsigned(fp, 32)", 0), _anchored("(fp & 4294967295L)", 1)]
    home = prints.selectExpr("fp", "node", f"explode(array({', '.join(h for h, _ in sides)})) AS anchor")
    visit = prints.selectExpr("fp", "node", f"explode(concat({', '.join(v for _, v in sides)})) AS anchor")
    home, visit = home.toDF("fp_a", "node_a", "anchor"), visit.toDF("fp_b", "node_b", "anchor")
    pairs = home.join(visit.hint("merge"), "anchor").where(f"node_a <> node_b AND bit_count(fp_a ^ fp_b) BETWEEN 1 AND {distance}")
    return pairs.selectExpr("least(node_a, node_b) AS a", "greatest(node_a, node_b) AS b").distinct()


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """``(doc_id, fp, mark, root)`` per row of docs: root is the smallest fingerprint reachable by links."""
    rows = stash(fingerprint_table(docs, id_col, text_col, shingle), "fingerprints")
    prints = stash(rows.select("fp").distinct().withColumn("node", F.col("fp")), "prints")
    roots = stash(components(near_pairs(prints, distance)).select(F.col("node").alias("fp"), "root"), "roots")
    return rows.join(roots.hint("merge"), "fp", "left").select("doc_id", "fp", "mark", F.coalesce("root", "fp").alias("root"))


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per row of docs; component_id is the smallest doc_id reachable by links.

    Null and empty texts share fingerprint 0 and link like any other; repeated rows are kept; rows of one doc_id with other
    texts are documents of their own, linked by their fingerprints alone; a null doc_id gets the id of its group, or null in
    a group without ids. Other columns of docs are not looked at. An empty table gives none.
    """
    rows = stash(simhash_classes(docs, id_col, text_col, shingle, distance), "classes")
    least = stash(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    return rows.join(least.hint("merge"), "root").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
