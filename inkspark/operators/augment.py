"""Drawn changes of glyph images for training, the same for the same key and seed."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..kernels import page as K
from .recognise import image_of


def turned(image: np.ndarray, degrees: float) -> np.ndarray:
    return K.rotated(image, degrees)


def noisy(image: np.ndarray, deviation: float, draw: np.random.Generator) -> np.ndarray:
    return np.clip(image + draw.normal(0, deviation, image.shape), 0, 255).astype(np.uint8)


def thickened(image: np.ndarray, thin: bool) -> np.ndarray:
    """Ink grown, or paper grown, by one pixel up and left."""
    return K._square(image, np.maximum if thin else np.minimum)


def for_training(image: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Turned by up to 10 degrees; noise in half the cases; thicker or thinner ink in two of five."""
    out = turned(image, draw.uniform(-10, 10))
    if draw.random() < 0.5:
        out = noisy(out, 8, draw)
    return thickened(out, draw.random() < 0.5) if draw.random() < 0.4 else out


def for_synthesis(image: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Blur in half the cases, noise in three of five, brightness and a turn of up to 5 degrees in two of five each."""
    out = K.blurred(image) if draw.random() < 0.5 else image
    if draw.random() < 0.6:
        out = noisy(out, draw.uniform(3, 14), draw)
    if draw.random() < 0.4:
        out = np.clip(out.astype(int) + draw.integers(-25, 26), 0, 255).astype(np.uint8)
    return turned(out, draw.uniform(-5, 5)) if draw.random() < 0.4 else out


KINDS = {"training": for_training, "synthesis": for_synthesis}


def augmented(glyphs: DataFrame, key: str, kind: str = "training", copies: int = 1, seed: int = 42) -> DataFrame:
    """``copies`` changed images of each gray glyph (key, height, width, channels, data), other columns kept, with ``copy``."""
    change, schema = KINDS[kind], ", ".join(f"`{c}` {t}" for c, t in glyphs.dtypes if c != "copy") + ", copy int"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for nth in range(copies):
                data = []
                for row in frame.itertuples(index=False):
                    draw = np.random.default_rng([seed, nth, zlib.crc32(str(getattr(row, key)).encode())])
                    data.append(change(K.gray(image_of(row)), draw).tobytes())
                yield frame.assign(data=data, channels=1, copy=nth)

    return glyphs.drop("copy").mapInPandas(run, schema)
