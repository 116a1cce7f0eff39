"""Looking into recognition: stage images, overlays, crops, unlikely pieces, candidates, and comparisons of two variants."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..kernels import page as K
from ..kernels import segment as S
from .recognise import image_of

IMAGE = "name string, height int, width int, channels int, data binary"
# Colours (BGR) of what overlays show.
COLOURS = {"lines": (255, 0, 0), "paws": (0, 128, 255), "chars": (0, 200, 0), "dots": (0, 0, 255)}


def _images(pages: DataFrame, make) -> DataFrame:
    """Rows of IMAGE: what ``make`` gives of each page's image, as (suffix, array)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                out = [(f"{row.stem}_{suffix}", *i.shape[:2], 1 if i.ndim == 2 else 3, np.ascontiguousarray(i, np.uint8).tobytes()) for suffix, i in make(image_of(row))]
                yield pd.DataFrame(out, columns=[c.split()[0] for c in IMAGE.split(", ")])

    stem = F.regexp_extract("page", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem")
    return pages.select(stem, "height", "width", "channels", "data").mapInPandas(run, IMAGE)


def _stages(image: np.ndarray, side: int = 2000) -> list[tuple[str, np.ndarray]]:
    gray = K.upscaled(K.bounded(K.gray(image), side))
    binary = K.binarized(gray)
    clean = K.without_noise(binary)
    straight, _ = K.straight(clean)
    return [("gray", gray), ("binary", binary), ("clean", clean), ("deskew", straight), ("padded", K.preprocessed(image, side)[0])]


def stage_images(pages: DataFrame) -> DataFrame:
    """The five stages of each page's preprocessing as images, for files.as_png; nothing writes them by itself."""
    return _images(pages, _stages)


def outlined(page: np.ndarray, boxes: list[tuple[int, int, int, int]], colour: tuple[int, int, int]) -> np.ndarray:
    """A gray page as BGR with the edges of boxes (x1, y1, x2, y2); thin on low pages."""
    out, thick = np.repeat(page[..., None], 3, axis=2), 1 if page.shape[0] < 300 else 2
    for x1, y1, x2, y2 in boxes:
        inner = (slice(y1 + thick, max(y1 + thick, y2 - thick)), slice(x1 + thick, max(x1 + thick, x2 - thick)))
        part = out[y1:y2, x1:x2].copy()
        part[:] = colour
        kept = out[inner].copy()
        out[y1:y2, x1:x2] = part
        out[inner] = kept
    return out


def union_box(chars: list[S.Char]) -> tuple[int, int, int, int]:
    return min(c.x1 for c in chars), min(c.y1 for c in chars), max(c.x2 for c in chars), max(c.y2 for c in chars)


def _overlays(image: np.ndarray) -> list[tuple[str, np.ndarray]]:
    page = K.preprocessed(image)[0]
    chars = S.characters(page == 0)
    pieces: dict[tuple[int, int], list[S.Char]] = {}
    for c in chars:
        pieces.setdefault((c.line, c.paw), []).append(c)
    corner = {k: min(c.x1 for c in own) for k, own in pieces.items()}
    dots = [(round(corner[c.line, c.paw] + d.cx), round(c.y1 + d.cy)) for c in chars for d in c.dots]
    boxes = {
        "lines": [(0, y1, page.shape[1], y2) for y1, y2 in S.lines(page == 0)],
        "paws": [union_box(own) for own in pieces.values()],
        "chars": [(c.x1, c.y1, c.x2, c.y2) for c in chars],
        "dots": [(max(0, x - 3), max(0, y - 3), x + 4, y + 4) for x, y in dots],
    }
    return [(kind, outlined(page, found, COLOURS[kind])) for kind, found in boxes.items()]


def overlays(pages: DataFrame) -> DataFrame:
    """Each page with the boxes of its lines, pieces, characters and dots: four images."""
    return _images(pages, _overlays)


def piece_report(crops: DataFrame) -> DataFrame:
    """(page, line, paw, n, mean_width, width, n_dots, flags) of each piece: unlikely splits and many dots are flagged."""
    dots = F.aggregate("dots", F.lit(0), lambda s, d: s + F.lit(1))
    per = crops.groupBy("page", "line", "paw").agg(
        F.count("*").alias("n"), F.avg(F.col("x2") - F.col("x1")).alias("mean_width"), (F.max("x2") - F.min("x1")).alias("width"), F.sum(dots).cast("long").alias("n_dots"), F.first("ah").alias("ah")
    )
    many = F.col("n") > F.greatest(F.lit(1.0), F.col("width") / F.greatest(F.lit(1.0), 0.4 * F.col("ah")) + 3)
    flags = F.array_compact(F.array(
        F.when(F.col("mean_width") < 0.8 * 0.1 * F.col("ah"), "tiny_avg_w"), F.when(many, "high_char_count"),
        F.when(F.col("n_dots") > F.greatest(F.lit(3), F.floor(F.col("n") / 2)), "many_dots"),
    ))
    return per.withColumn("flags", F.array_join(flags, ",")).drop("ah")


def crop_images(crops: DataFrame, pieces: DataFrame | None = None) -> DataFrame:
    """Characters' images under names of their page and place, of all crops or of those of some pieces (page, line, paw)."""
    rows = crops if pieces is None else crops.join(pieces.select("page", "line", "paw").distinct(), ["page", "line", "paw"], "left_semi")
    stem = F.regexp_extract("page", r"([^/]+?)(?:\.[^./]*)?$", 1)
    name = F.concat_ws("_", stem, F.format_string("line%d", "line"), F.format_string("paw%d", "paw"), F.format_string("char%d", "char"))
    return rows.select(name.alias("name"), "height", "width", "channels", "data")


def first_candidates(ranked: DataFrame, n: int = 10) -> DataFrame:
    """The n best candidates of each place of rows with a ``rank``."""
    return ranked.where(F.col("rank") <= n)


def compared(one: DataFrame, other: DataFrame, script: str) -> DataFrame:
    """(page, other_a, other_b, distance, change) of two variants' texts (page, text), then their means with a null page.

    other_a and other_b count characters that are neither of the script nor white space. A page that one variant lacks has an
    empty text there.
    """
    both = one.select("page", F.col("text").alias("a")).join(other.select("page", F.col("text").alias("b")), "page", "full").na.fill("", ["a", "b"])
    count = lambda c: X.non_script_count(F.col(c), script).cast("double")
    rows = both.select("page", count("a").alias("other_a"), count("b").alias("other_b"), F.levenshtein("a", "b").cast("double").alias("distance"), X.relative_change(F.col("a"), F.col("b")).alias("change"))
    means = rows.agg(*(F.avg(c).alias(c) for c in rows.columns[1:])).select(F.lit(None).cast("string").alias("page"), *rows.columns[1:])
    return rows.unionByName(means)
