"""Pages as relations: one pass of the page kernels gives ink runs and glyph features; all later stages are tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import page as K


def _image(row) -> np.ndarray:
    return np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)


def page_runs(pages: DataFrame, side: int = 2000) -> DataFrame:
    """(page, page_height, page_width, angle, y, x1, x2) of the preprocessed pages; a page is one row of bounded size.

    Pixels don't leave this stage: later stages read run lengths only.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                clean, angle = K.preprocessed(_image(row), side)
                y, a, b = K.runs(clean).T
                yield pd.DataFrame({"page": row.page, "page_height": clean.shape[0], "page_width": clean.shape[1], "angle": angle, "y": y, "x1": a, "x2": b})

    return pages.mapInPandas(run, "page string, page_height int, page_width int, angle double, y int, x1 int, x2 int")


def region(boxes: DataFrame, padding: int = 2) -> DataFrame:
    """Boxes (x1, y1, x2, y2) grown by ``padding`` within the page (page_width, page_height)."""
    return boxes.withColumns({
        "x1": F.greatest(F.lit(0), F.col("x1") - padding), "y1": F.greatest(F.lit(0), F.col("y1") - padding),
        "x2": F.least("page_width", F.col("x2") + padding), "y2": F.least("page_height", F.col("y2") + padding),
    })


def piece_boxes(chars: DataFrame, keys: list[str]) -> DataFrame:
    """The box around all characters of each piece."""
    return chars.groupBy(*keys).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
