"""Image to text: pages to characters in one pass each, characters to candidates, candidates to lines of words.

A page's pixels are read in one task and leave it as character crops with their features; all that follows is keyed by page,
line, piece and character.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.labels import label_dim
from ..kernels import page as K
from ..kernels import segment as S
from . import candidates as C
from . import decode as D
from .glyphs import zernike_basis
from .models import Classifier

KEYS = ["page", "line", "paw", "char"]
DOT = "struct<cx: double, cy: double, size: int, position: string>"
CROP = f"page string, line int, paw int, char int, x1 int, y1 int, x2 int, y2 int, position string, above int, below int, spread double, ah double, dots array<{DOT}>, height int, width int, channels int, data binary"
#: Sizes of the parts of a feature vector: grid, directions, contour, moments, dots.
PARTS = (64, 1764, 192, 45, 4)


def image_of(row) -> np.ndarray:
    return np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)


def characters(pages: DataFrame, side: int = 2000) -> DataFrame:
    """One row per character of each page: its keys, box, form, dots and image (ink 0). A page without ink gives none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                out = []
                for c in S.characters(K.preprocessed(image_of(row), side)[0] == 0):
                    count = {p: sum(d.size for d in c.dots if d.position == p) for p in ("above", "below")}
                    spread = float(np.std([d.cx for d in c.dots])) if len(c.dots) > 1 else 0.0
                    dots = [{"cx": d.cx, "cy": d.cy, "size": d.size, "position": d.position} for d in c.dots]
                    data = np.where(c.ink, 0, 255).astype(np.uint8).tobytes()
                    out.append((row.page, c.line, c.paw, c.char, c.x1, c.y1, c.x2, c.y2, c.position, count["above"], count["below"], spread, c.ah, dots, *c.ink.shape, 1, data))
                if out:
                    yield pd.DataFrame(out, columns=[x.split()[0] for x in CROP.replace(DOT, "x").split(", ")])

    return pages.select("page", "height", "width", "channels", "data").mapInPandas(run, CROP)


@cache
def moments(size: int = 32, degree: int = 8) -> np.ndarray:
    """Complex basis of the Zernike moments over the pixels of a normalised glyph, scaled by (n + 1) / pi."""
    orders = {(n, m): k for k, (n, m) in enumerate((n, m) for n in range(degree + 1) for m in range(-n, n + 1, 2))}
    out = np.zeros((len(orders), size * size), complex)
    for n, m, y, x, re, im in zernike_basis(size, degree):
        out[orders[n, m], y * size + x] = (n + 1) / np.pi * complex(re, im)
    return out


def vector(image: np.ndarray, above: int = 0, below: int = 0, spread: float = 0.0) -> np.ndarray:
    """The whole feature vector of a glyph and its dots; without dots the last four values are zeros."""
    glyph = K.normalized(K.gray(image))
    dots = np.array([above, below, float(above + below > 0), spread])
    return np.concatenate([K.grid(glyph), K.hog(glyph), K.contour(glyph), K.zernike(glyph, moments()), dots]).astype(np.float32)


def features(glyphs: DataFrame, keep: list[str]) -> DataFrame:
    """keep with ``features``: sum(PARTS) values of each glyph image; above, below and spread count where they are columns."""
    types = dict(glyphs.dtypes)
    schema = "".join(f"`{k}` {types[k]}, " for k in keep) + "features array<float>"
    seen = [c for c in ("above", "below", "spread") if c in glyphs.columns]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[keep].assign(features=[vector(image_of(r), **{c: getattr(r, c) for c in seen}) for r in frame.itertuples(index=False)])

    wanted = dict.fromkeys([*keep, "height", "width", "channels", "data", *seen])
    return glyphs.select(*wanted).mapInPandas(run, schema)


def with_default(crops: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates (keys, ord, label, conf) of all crops; a crop without any has the one candidate '' with conf 1."""
    rows = crops.join(found.select(*keys, (F.col("rank") - 1).alias("ord"), "label", F.col("p").alias("conf")), keys, "left")
    return rows.withColumns({"ord": F.coalesce("ord", F.lit(0)), "label": F.coalesce("label", F.lit("")), "conf": F.coalesce("conf", F.lit(1.0))})


def lines_of(glyphs: DataFrame) -> DataFrame:
    """(page, line, pieces) of merged candidates (KEYS, glyph, p, rank): lattices of the pieces in reading order."""
    column = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("glyph").alias("label"), "p"))), lambda c: F.struct(c["label"].alias("label"), c["p"].alias("p")))
    chars = glyphs.groupBy(*KEYS).agg(column.alias("c"))
    pieces = chars.groupBy("page", "line", "paw").agg(F.transform(F.array_sort(F.collect_list(F.struct("char", "c"))), lambda x: x["c"]).alias("lattice"))
    return pieces.groupBy("page", "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("paw", "lattice"))), lambda x: x["lattice"]).alias("pieces"))


def page_texts(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """(page, text) of all pages: their lines in order, empty ones dropped; '' for a page without any."""
    said = lines.where("text <> ''").groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return pages.select("page").join(said, "page", "left").select("page", F.coalesce("text", F.lit("")).alias("text"))


def candidates(crops: DataFrame, classifier: Classifier, config: Config, labels: DataFrame) -> DataFrame:
    """Candidates of each crop as glyphs (KEYS, glyph, p, rank): classified, reranked by their dots, merged."""
    found = classifier.top_k(features(crops, [*KEYS, "above", "below", "spread"]), KEYS, config.top_k)
    rows = with_default(crops.select(*KEYS, "above", "below", "spread"), found, KEYS)
    ranked = C.dot_reranked(rows, labels, KEYS, config.match_boost, config.mismatch_penalty)
    ranked = ranked.select(*KEYS, "label", F.col("p").alias("conf"), (F.col("rank") - 1).alias("ord"))
    return C.merged(C.with_glyphs(ranked, labels, config.script), KEYS)


def recognised(pages: DataFrame, classifier: Classifier, bigrams: D.Bigrams, words: dict[str, float], config: Config, labels: DataFrame | None = None) -> DataFrame:
    """(page, text) of page images (page, height, width, channels, data), in any number.

    ``bigrams`` and ``words`` are the language model: pairs of characters, and the bonus of known words, both bounded by
    their caps. An image that shows nothing has the text ''.
    """
    labels = label_dim(pages.sparkSession) if labels is None else labels
    lattice = lines_of(candidates(characters(pages, config.max_side), classifier, config, labels))
    lattice = lattice.withColumn("key", F.struct("page", "line"))
    told = D.decoded_lines(lattice, "key", bigrams, config.bigram_miss, config.beam_width, config.max_span, config.space_penalty, words)
    return page_texts(pages, told.select("key.page", "key.line", "text"))
