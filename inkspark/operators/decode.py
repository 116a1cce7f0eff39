"""Decoding of candidate lattices: Viterbi, beam search, and the grouping of pieces into words.

A lattice is an array of positions, each an array of (label, p), best first. Bigrams are pairs of characters of one
script, so their number is bounded by the square of its size; they travel to the tasks as a dictionary. A word or a line
is one row, decoded whole in one task.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Lattice = list[list[tuple[str, float]]]
Bigrams = dict[tuple[str, str], float]
Beam = tuple[float, str, str | None]
START: list[Beam] = [(0.0, "", None)]
FLOOR, CONTEXT = 1e-9, 0.3


def lattices(candidates: DataFrame, key: str) -> DataFrame:
    """(key, lattice) of rows (key, pos, label, conf, ord): labels of a position merged, normalised, best first."""
    merged = candidates.groupBy(key, "pos", "label").agg(F.sum("conf").alias("conf"), F.min("ord").alias("ord"))
    p = F.col("conf") / F.sum("conf").over(Window.partitionBy(key, "pos"))
    ranked = merged.withColumn("p", p).groupBy(key, "pos").agg(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("n"), "ord", "label", "p"))).alias("c"))
    return ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "c"))).alias("l")).select(key, F.transform("l", lambda x: x["c"]).alias("lattice"))


def bigram_dict(bigrams: DataFrame) -> Bigrams:
    return {(r["prev"], r["next"]): r["p"] for r in bigrams.select("prev", "next", "p").collect()}


def step(prev: str | None, label: str, p: float, bigrams: Bigrams, miss: float) -> float:
    own = math.log(max(p, FLOOR))
    return own if prev is None else own + CONTEXT * math.log(bigrams.get((prev, label), miss))


def viterbi(lattice: Lattice, bigrams: Bigrams, miss: float) -> tuple[str, float]:
    """Best path and its score; among equal predecessors the first. An empty lattice gives an empty path of score 0."""
    state: dict[str, tuple[float, str]] = {}
    for at, column in enumerate(lattice):
        now = {}
        for label, p in column:
            if not at:
                now[label] = (step(None, label, p, bigrams, miss), label)
            else:
                score, prev = max(((s + step(c, label, p, bigrams, miss), -k) for k, (c, (s, _)) in enumerate(state.items())))
                now[label] = (score, list(state.values())[-prev][1] + label)
        state = now
    best = max(((s, -k, path) for k, (s, path) in enumerate(state.values())), default=(0.0, 0, ""))
    return best[2], best[0]


def transitions(bigrams: Bigrams, miss: float) -> tuple[Bigrams, float]:
    """Weighted logarithms of the bigrams, and of a pair that is none; taken once for many steps."""
    return {pair: CONTEXT * math.log(p) for pair, p in bigrams.items()}, CONTEXT * math.log(miss)


def beams(lattice: Lattice, bigrams: Bigrams, miss: float, width: int) -> list[tuple[float, str]]:
    """The ``width`` best (score, path) after each position, equal scores in order of extension."""
    return [(s, path) for s, path, _ in extended(START, lattice, *transitions(bigrams, miss), width)]


def extended(out: list[Beam], lattice: Lattice, logs: Bigrams, low: float, width: int) -> list[Beam]:
    """Beams (score, path, last label) after further positions."""
    get = logs.get
    for column in lattice:
        own = [(label, math.log(max(p, FLOOR))) for label, p in column]
        grown = [(s + (o if last is None else o + get((last, label), low)), path + label, label) for s, path, last in out for label, o in own]
        out = sorted(grown, key=lambda x: -x[0])[:width]
    return out


def words_of_pieces(pieces: list[Lattice], bigrams: Bigrams, miss: float, width: int, span: int, penalty: float, bonus) -> str:
    """Text of a line: pieces joined into words of at most ``span`` pieces so that the words' scores add up to most.

    A span scores its best beam and ``bonus`` of its word; penalty is added for each word but the first. Undetected
    characters are dropped, empty words too; equal totals keep the longer last word.
    """
    best: list[tuple[float, list[str]]] = [(0.0, [])] + [(-math.inf, [])] * len(pieces)
    logs, low = transitions(bigrams, miss)
    for j in range(len(pieces)):
        state = START  # the beams of a span go on from those of the span without its last piece
        for i in range(j + 1, min(j + span, len(pieces)) + 1):
            state = extended(state, pieces[i - 1], logs, low, width)
            found = [(s + bonus(w := path.replace("_", "")), w) for s, path, _ in state]
            score, word = max(found, key=lambda x: x[0])
            total = best[j][0] + score + (penalty if j else 0.0)
            if total > best[i][0]:
                best[i] = (total, best[j][1] + [word] if word else best[j][1])
    return unicodedata.normalize("NFC", " ".join(best[-1][1]))


def decoded(rows: DataFrame, key: str, bigrams: Bigrams, miss: float, width: int | None) -> DataFrame:
    """(key, path, score) of (key, lattice): by Viterbi, or by a beam search of the given width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, columns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lattice = [[(c["label"], c["p"]) for c in column] for column in columns]
                path, score = viterbi(lattice, bigrams, miss) if width is None else beams(lattice, bigrams, miss, width)[0][::-1]
                out.append((name, path, score))
            yield pa.RecordBatch.from_pylist([dict(zip((key, "path", "score"), r, strict=True)) for r in out], pa.schema([batch.schema.field(key), ("path", pa.string()), ("score", pa.float64())]))

    return rows.select(key, "lattice").mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, path string, score double")


def decoded_lines(rows: DataFrame, key: str, bigrams: Bigrams, miss: float, width: int, span: int, penalty: float, words: dict[str, float]) -> DataFrame:
    """(key, text) of (key, pieces), pieces being lattices in reading order; ``words`` holds the bonus of known words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, pieces in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lattice = [[[(c["label"], c["p"]) for c in column] for column in piece] for piece in pieces]
                out.append((name, words_of_pieces(lattice, bigrams, miss, width, span, penalty, lambda w: words.get(w, 0.0))))
            yield pa.RecordBatch.from_pylist([dict(zip((key, "text"), r, strict=True)) for r in out], pa.schema([batch.schema.field(key), ("text", pa.string())]))

    return rows.select(key, "pieces").mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, text string")
