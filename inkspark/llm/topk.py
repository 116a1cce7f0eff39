"""Exact top-k search by inner product: a three-phase uniform threshold over coordinate slices.

A vector is cut into ``slices`` runs of coordinates. Each block of candidates holds a list of entries per slice, in the
order of their norm there, since a partial score is at most the product of two norms; a score is the sum of its partials.

1. Gather: the heads of all lists, HEAD entries each, are scored as a whole. The k-th best of them is a lower bound t of a
   query's k-th best score.
2. Cutoff: t is broadcast. A candidate whose partial scores all lie below t / slices scores less than t, whatever their
   signs, so an entry is sufficient only if some partial reaches t / slices; entries whose norms rule that out, or rule a
   sum of t out, are not scored at all. While a task reads on, its own k-th best score raises t further.
3. Resolve: the remaining partial scores of sufficient entries are added exactly, and what reaches t is ranked.

Components are integers and all sums are exact. Queries go out in chunks of bounded size, past which the candidates are
read as they lie: no candidate is copied or shuffled, and a task keeps k entries a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._stash import fresh_path, stash

#: Candidates a block; queries that are broadcast together and scored together; entries at the head of a list.
CANDIDATE_BLOCK, QUERY_CHUNK, QUERY_BLOCK, SLICES, HEAD = 4096, 16384, 512, 4, 32
NO_CUTOFF = -(1 << 62)


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``(vec_id, vec)`` with floor(scale * x) of each component x; rows with a null id, or a vector that is null or holds
    a null or non-finite component, are left out."""
    kept = rows.select(rows[id_col].cast("long").alias("vec_id"), rows[vector_col].cast("array<double>").alias("x"))
    finite = "vec_id IS NOT NULL AND x IS NOT NULL AND forall(x, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity'))"
    return kept.where(finite).select("vec_id", F.expr(f"transform(x, v -> CAST(floor(v * {scale}D) AS bigint))").alias("vec"))


def _matrix(vectors: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    size = pc.list_value_length(vectors).to_numpy().astype(np.int64)
    out = np.zeros((len(vectors), dims), np.int64)
    out[np.arange(dims) < size[:, None]] = pc.list_flatten(vectors).to_numpy()
    return out


def _packed(rows: DataFrame, per_block: int, dims: int) -> DataFrame:
    """One row per block of about ``per_block`` candidates: ids and matrix, by id."""
    blocks = max(1, -(-rows.count() // per_block))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        parts = (table["vec_id"].to_numpy().astype(np.int64), _matrix(table["vec"], dims))
        return pa.table({"ids": pa.array([parts[0].tobytes()], pa.binary()), "matrix": pa.array([parts[1].tobytes()], pa.binary())})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(run, "ids binary, matrix binary")


def _exact(matrix: np.ndarray, other: np.ndarray) -> np.dtype:
    """The fastest type in which inner products of the rows are exact."""
    top = float(np.abs(matrix).max(initial=0)) * float(np.abs(other).max(initial=0)) * max(1, matrix.shape[1])
    return np.dtype(np.float32 if top < 2.0**24 else np.float64 if top < 2.0**53 else np.int64)


def best_entries(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each row's k best distinct ids, each with its best score, ties to the smaller id."""
    order = np.lexsort((-score, ids, row))
    new = np.ones(len(order), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    kept = order[new]
    kept = kept[np.lexsort((ids[kept], -score[kept], row[kept]))]
    place = np.arange(len(kept)) - np.searchsorted(row[kept], row[kept])
    return kept[place < k]


class Scorer:
    """A task's k best entries of each query, over the blocks it has read."""

    def __init__(self, queries: np.ndarray, cutoff: np.ndarray, k: int, slices: int):
        self.queries, self.cutoff, self.k = queries, cutoff.copy(), k
        self.cuts = [c for c in np.array_split(np.arange(queries.shape[1]), slices) if len(c)]
        self.found = {at: (np.zeros(0, np.int64),) * 3 for at in range(0, len(queries), QUERY_BLOCK)}

    def norms(self, matrix: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt((matrix[:, c].astype(np.float64) ** 2).sum(1)) for c in self.cuts], axis=1)

    def heads(self, matrix: np.ndarray) -> np.ndarray:
        """Places of the entries of the greatest norm in some slice."""
        order = np.argsort(-self.norms(matrix), axis=0, kind="stable")
        return np.unique(order[:HEAD])

    def read(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        far, near = self.norms(matrix), self.norms(self.queries)
        kind = _exact(self.queries, matrix)
        candidates = matrix.astype(kind)
        for at in range(0, len(self.queries), QUERY_BLOCK):
            part = slice(at, at + QUERY_BLOCK)
            cutoff = self.cutoff[part]
            # the greatest score that the norms allow, with room for rounding
            reach = near[part] @ far.T * (1 + 1e-9) + 1 >= cutoff[:, None]
            columns = np.flatnonzero(reach.any(axis=0))
            if len(columns):
                queries = self.queries[part].astype(kind)
                row, column, score = sufficient([queries[:, c] @ candidates[columns][:, c].T for c in self.cuts], cutoff)
                self._keep(at, row, ids[columns[column]], score)

    def _keep(self, at: int, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Take entries of a block of queries in; k of them raise a query's cutoff."""
        row, ids, score = (np.concatenate(x) for x in zip(self.found[at], (row, ids, score), strict=True))
        kept = best_entries(row, ids, score, self.k)
        self.found[at] = row, ids, score = row[kept], ids[kept], score[kept]
        count = np.bincount(row)
        full = np.flatnonzero(count == self.k)
        self.cutoff[at + full] = np.maximum(self.cutoff[at + full], score[np.cumsum(count)[full] - 1])

    def entries(self) -> list[np.ndarray]:
        """Query, id and score."""
        return [np.concatenate([x[k] + (at if k == 0 else 0) for at, x in self.found.items()] or [np.zeros(0, np.int64)]) for k in range(3)]


def sufficient(partials: list[np.ndarray], cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) with a partial score of at least cutoff / slices in some list, and a score of cutoff or more."""
    least = -(-cutoff // len(partials))[:, None]
    seen = partials[0] >= least
    for p in partials[1:]:
        seen |= p >= least
    row, column = np.nonzero(seen)
    score = sum(p[row, column].astype(np.int64) for p in partials)
    enough = score >= cutoff[row]
    return row[enough], column[enough], score[enough]


def _scored(candidates: DataFrame, keys: np.ndarray, queries: np.ndarray, cutoff: np.ndarray, k: int, slices: int, heads: bool) -> DataFrame:
    """``(query, id, score)``: each task's k best entries of each query, of its lists' heads or of all."""
    held = candidates.sparkSession.sparkContext.broadcast((keys, queries, cutoff))
    dims = queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, queries, cutoff = held.value
        scorer = Scorer(queries, cutoff, k, slices)
        for batch in batches:
            for r in range(batch.num_rows):
                ids, matrix = (np.frombuffer(batch.column(c)[r].as_py(), np.int64) for c in range(2))
                matrix = matrix.reshape(len(ids), dims)
                if heads:
                    chosen = scorer.heads(matrix)
                    ids, matrix = ids[chosen], matrix[chosen]
                scorer.read(ids, matrix)
        row, ids, score = scorer.entries()
        yield pa.RecordBatch.from_arrays([pa.array(keys[row]), pa.array(ids), pa.array(score)], names=["query", "id", "score"])

    return candidates.select("ids", "matrix").mapInArrow(run, "query long, id long, score long")


def _ranked(entries: DataFrame, key: str, id_col: str, k: int) -> DataFrame:
    """The k best distinct ids of each key, with ``place``."""
    best = entries.groupBy(key, id_col).agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), id_col))
    return best.withColumn("place", place).where(F.col("place") <= k)


def top_k(vectors: DataFrame, is_query: str, k: int = 5, slices: int = SLICES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k best other rows by integer inner product, ties to smaller vec_id.

    ``vectors`` is (vec_id, vec) of integers, ``is_query`` an SQL condition on vec_id. Null ids and vectors are left out.
    Rows that share a vec_id are one item with several vectors: it scores as its best one, it is never its own answer, and
    repeated rows change nothing. Shorter vectors are read as padded with zeros. Fewer than k other items give them all; an
    empty table, or no query, gives no rows. Scores must fit a long.

    Of the ids that share a vector the k + 1 smallest suffice, so copies cost no more than that, however many there are.
    """
    want, spark = k + 1, vectors.sparkSession  # a query's own item may be among the best
    rows = stash(vectors.select("vec_id", "vec").where("vec_id IS NOT NULL AND vec IS NOT NULL").distinct(), "vectors")
    dims = rows.agg(F.max(F.size("vec"))).first()[0] or 1
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    few = rows.withColumn("nth", nth).where(F.col("nth") <= want).select("vec_id", "vec")  # so many rows a vector and partition are shuffled
    candidates = stash(_packed(few, CANDIDATE_BLOCK, dims), "candidates")
    asked = rows.where(is_query)
    questions = stash(asked.select("vec").distinct().withColumn("query", F.monotonically_increasing_id()), "questions")
    chunks = -(-questions.count() // QUERY_CHUNK)
    path = fresh_path(spark, "entries")
    for chunk in range(chunks):  # each is about QUERY_CHUNK vectors, all that the driver ever holds
        part = questions.where(F.pmod(F.xxhash64("query"), F.lit(chunks)) == chunk).select("query", "vec").toArrow()
        keys, queries = part["query"].to_numpy().astype(np.int64), _matrix(part["vec"], dims)
        none = np.full(len(keys), NO_CUTOFF)
        first = _ranked(_scored(candidates, keys, queries, none, want, slices, True), "query", "id", want)
        bounds = {r["query"]: r["least"] for r in first.groupBy("query").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == want).collect()}
        cutoff = np.array([bounds.get(q, NO_CUTOFF) for q in keys.tolist()], np.int64)
        _scored(candidates, keys, queries, cutoff, want, slices, False).write.mode("append").parquet(path)
    out = "query_id long, rank int, vec_id long, score long"
    if not chunks:
        return spark.createDataFrame([], out)
    entries = stash(_ranked(spark.read.schema("query long, id long, score long").parquet(path), "query", "id", want), "best")
    own = asked.join(questions, "vec").select(F.col("vec_id").alias("query_id"), "query")
    others = own.join(entries.select("query", F.col("id").alias("vec_id"), "score"), "query").where("query_id <> vec_id")
    return _ranked(others, "query_id", "vec_id", k).select("query_id", F.col("place").cast("int").alias("rank"), "vec_id", "score")


ORACLE_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, max(CAST(list_inner_product(q.vec, c.vec) AS BIGINT)) AS score
           FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
