"""Language identification by prediction by partial matching (PPM, method C with exclusion) under frozen statistics.

Per language, a byte context tree of order 0 to 2 counts what followed each context in labelled texts (A-Z read as a-z,
two blanks before each text). A byte that a context has not seen costs an escape and passes to the next shorter context,
whose symbols already ruled out are excluded; below order 0 the rest of the 256 bytes are equally likely. As the
statistics are frozen, the code length of a byte is a function of itself and its two predecessors: the tree is compiled
into one table of exact code lengths, and a text costs one look-up a byte for all languages together.

The language of the shortest total code is the prediction; its score is its posterior probability under equal priors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from ._arrow import bounded, chunks, text_bytes
from ._stash import stash

UNKNOWN = "und"
#: Distinct labelled texts a language, and bytes of them, that the statistics are gathered from, whole; about so many at most.
SAMPLE_TEXTS, SAMPLE_BYTES = 1500, 16 << 20
#: A text is foreign to all learned languages if its shortest code takes so many times the bits a byte of that language's own
#: labelled texts, and so many bits besides, which short texts may need.
FOREIGN, SLACK_BITS = 1.8, 512.0
#: Languages whose sizes may be broadcast (some 50 bytes each); more are shuffled, with the texts.
BROADCAST_LANGS = 10_000
START = b"  "
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
LETTER = np.array([97 <= (b | 32) <= 122 for b in range(256)])


def training_rows(docs: DataFrame, text_col: str, lang_col: str, bound: int, n_bytes: int) -> DataFrame:
    """``(lang, text)``: about ``bound`` distinct texts a language, of ``n_bytes`` bytes, picked by a hash of the text.

    A language with fewer gives all, and any language gives one text at least. Repeated rows count once; ids play no part.
    """
    rows = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("mark", F.xxhash64("text", F.lit(5)).bitwiseAND((1 << 30) - 1))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("mark").alias("n"), F.sum(F.octet_length("text")).alias("size"), F.min("mark").alias("least"))
    share = F.least(F.lit(1.1 * bound) / F.col("n"), F.lit(float(n_bytes)) / F.greatest("size", F.lit(1)))
    sizes = stash(sizes.select("lang", "least", share.alias("share")), "languages")
    picked = rows.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_LANGS else sizes, "lang")
    return picked.where(F.col("mark") / float(1 << 30) < F.col("share")).union(picked.where("mark = least")).select("lang", "text").distinct()


def gram_counts(rows: DataFrame) -> DataFrame:
    """``(lang, gram, n)``: gram is three bytes, the last with its two predecessors, as a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            langs, texts = part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()
            for lang in sorted(set(langs)):
                own = FOLD[np.frombuffer(b"".join(START + t for x, t in zip(langs, texts, strict=True) if x == lang), np.uint8)]
                starts = np.cumsum([0, *(len(t) + 2 for x, t in zip(langs, texts, strict=True) if x == lang)])[:-1]
                keep = np.ones(len(own), bool)
                keep[starts] = keep[starts + 1] = False
                own = own.astype(np.int64)
                grams = (own[:-2] << 16 | own[1:-1] << 8 | own[2:])[keep[2:]]
                gram, n = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return rows.transform(bounded).mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Frozen statistics of all languages; small, as only seen three-byte grams are kept."""

    def __init__(self, langs: list[str], grams: list[np.ndarray], counts: list[np.ndarray]):
        self.langs, self.grams, self.counts, self._rates = langs, grams, counts, None

    def compiled(self) -> tuple[np.ndarray, np.ndarray]:
        """Byte to symbol, and the bits of each (symbol, symbol, symbol) in each language; made once a process."""
        key = (tuple(self.langs), zlib.crc32(b"".join(x.tobytes() for x in (*self.grams, *self.counts))))
        if key not in _COMPILED:
            _COMPILED.clear()
            _COMPILED[key] = self._compile()
        return _COMPILED[key]

    def _compile(self) -> tuple[np.ndarray, np.ndarray]:
        seen = np.unique(np.concatenate([np.concatenate([g >> 16, g >> 8 & 255, g & 255]) for g in self.grams]))
        size = len(seen) + 1  # the last symbol stands for any byte never seen
        symbol = np.full(256, size - 1, np.int32)
        symbol[seen] = np.arange(size - 1)
        symbol = symbol[FOLD]
        table = np.empty((size, size, size, len(self.langs)), np.float32)
        for k, (gram, count) in enumerate(zip(self.grams, self.counts, strict=True)):
            order2 = np.zeros((size, size, size), np.float32)
            np.add.at(order2, (symbol[gram >> 16], symbol[gram >> 8 & 255], symbol[gram & 255]), count)
            order1 = order2.sum(0)
            order0 = order1.sum(0)
            for a in range(size):
                table[a, ..., k] = _code_lengths([order2[a], order1, np.broadcast_to(order0, order1.shape)], 256 - size + 1)
        return symbol, table.reshape(size**3, len(self.langs))

    def rates(self) -> np.ndarray:
        """Bits a byte that each language's own labelled texts take."""
        if self._rates is not None:
            return self._rates
        symbol, table = self.compiled()
        size = round(len(table) ** (1 / 3))
        out = np.zeros(len(self.langs))
        for k, (gram, count) in enumerate(zip(self.grams, self.counts, strict=True)):
            sym = symbol[np.stack([gram >> 16, gram >> 8 & 255, gram & 255])].astype(np.int64)
            out[k] = (table[(sym[0] * size + sym[1]) * size + sym[2], k] * count).sum(dtype=np.float64) / max(1, count.sum())
        self._rates = out
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language."""
        symbol, table = self.compiled()
        size = round(len(table) ** (1 / 3))
        sym = symbol[np.frombuffer(b"".join([START + t for t in texts]), np.uint8)]
        starts = np.cumsum([0, *(len(t) + 2 for t in texts)])[:-1]
        cost = np.zeros((len(sym), table.shape[1]), np.float32)
        np.take(table, (sym[:-2] * size + sym[1:-1]) * size + sym[2:], axis=0, out=cost[2:])
        cost[starts] = cost[starts + 1] = 0
        return np.add.reduceat(cost, starts, axis=0, dtype=np.float64)


_COMPILED: dict = {}


def _code_lengths(orders: list[np.ndarray], unseen: int) -> np.ndarray:
    """Bits of each symbol (last axis) in each context; ``orders`` holds the counts from the longest context down.

    The last symbol stands for ``unseen`` bytes, so below order 0 it shares in the rest as so many.
    """
    bits = np.zeros(orders[0].shape, np.float32)
    passed = np.zeros(orders[0].shape[:-1], np.float32)
    open_ = np.ones(orders[0].shape, bool)
    for counts in orders:
        counts = np.where(open_, counts, 0)
        kinds = (counts > 0).sum(-1)
        total = counts.sum(-1) + kinds
        here = counts > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            bits = np.where(here, passed[..., None] + np.log2(total[..., None] / counts), bits)
            passed = passed + np.where(kinds > 0, np.log2(total / np.maximum(kinds, 1)), 0).astype(np.float32)
        open_ &= ~here
    rest = open_[..., :-1].sum(-1) + unseen
    return np.where(open_, passed[..., None] + np.log2(rest)[..., None], bits).astype(np.float32)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", bound: int = SAMPLE_TEXTS, n_bytes: int = SAMPLE_BYTES) -> Model:
    """Statistics from labelled rows (null texts and labels are skipped); ``bound`` texts and ``n_bytes`` bytes a language, about.

    Only the counts of seen grams come to the driver: as many as the sample has bytes at most, some 20,000 a language in practice.
    """
    got = gram_counts(training_rows(docs, text_col, lang_col, bound, n_bytes)).toPandas()
    langs = sorted(got["lang"].unique())
    parts = [got[got["lang"] == x].sort_values("gram") for x in langs]
    return Model(langs, [p["gram"].to_numpy(np.int64) for p in parts], [p["n"].to_numpy(np.int64) for p in parts])


def predict(model: Model, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score, and whether the text's code is short enough for a text of that language."""
    whole = [t or b"" for t in texts]
    data = np.frombuffer(b" ".join([*whole, b""]), np.uint8)
    starts = np.cumsum([0, *(len(t) + 1 for t in whole)])[:-1]
    lettered = np.logical_or.reduceat(LETTER[data], starts)
    for row in np.flatnonzero(~lettered):
        lettered[row] = not whole[row].isascii() and any(map(str.isalpha, whole[row].decode("utf-8", "replace")))
    if not model.langs:
        return [UNKNOWN] * len(whole), np.zeros(len(whole)), np.zeros(len(whole), bool)
    bits = model.bits(whole)
    best = bits.argmin(1)
    least = bits.min(1, keepdims=True)
    score = 1 / np.exp2(np.maximum(least - bits, -1000)).sum(1)
    usual = model.rates()[best] * np.array([len(t) for t in whole])
    fits = lettered & (least[:, 0] <= FOREIGN * usual + SLACK_BITS)
    return [model.langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), lettered.tolist(), strict=True)], np.where(lettered, score, 0.0), fits


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "lang_fits")) -> DataFrame:
    """The ``keep`` columns of docs (default: all) with the language, its score and ``lang_fits``; only the text is looked at.

    Null and letter-less texts, and all texts under a model without languages, get ``und``, score 0 and do not fit; nor does
    a text that is foreign to all learned languages by its code length. ``names`` names the new columns; columns of docs
    named so are replaced. Whole texts are scored, however long; ties go to the first language by name.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*(docs.schema[c] for c in keep), *(StructField(n, t) for n, t in zip(names, (StringType(), DoubleType(), BooleanType()), strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "__text"):
            column = part.column(len(keep))
            _, off, view = text_bytes(column)
            at = off.tolist()
            langs, score, fits = predict(held.value, [bytes(view[i:j]) for i, j in zip(at, at[1:], strict=False)])
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(score), pa.array(fits)], names=schema.names)

    return docs.select(*keep, docs[text_col].cast("string").alias("__text")).transform(bounded).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The rows whose labels are kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
