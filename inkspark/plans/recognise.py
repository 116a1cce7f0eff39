"""The flagship: benchmark items drawn as page images, recognised, and compared with what was drawn.

A letter is five columns of blocks, each four blocks high at one of three heights, so that letters hold no valley and are
one component; the last column is the others' check sum, so that letters differ in two columns or more. Letters are drawn
from right to left in pieces of two that a thin stroke joins, as joined script is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as X
from ..operators import corpus as C
from ..operators import decode as D
from ..operators import recognise as R
from ..operators.models import Classifier
from .corpus import table

#: Lower-case letters that are drawn, as a character class.
SCRIPT = "a-zß-öø-ÿ"
LETTERS = [chr(c) for c in (*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100))]
CONFIG = Config(script=SCRIPT)
BLOCK, COLUMNS, ROWS, STROKE, GAP, MARGIN = 6, 5, 6, 4, 18, 40
LINE_LETTERS = 36
PAGE = "page string, height int, width int, channels int, data binary"
TREES = 24


def letter(char: str) -> np.ndarray:
    """Ink of a letter, by the digits of its place in the alphabet to the base 3 and their check sum."""
    nth = LETTERS.index(char)
    digits = [nth // 3**k % 3 for k in range(COLUMNS - 1)]
    out = np.zeros((ROWS * BLOCK, COLUMNS * BLOCK), bool)
    for k, top in enumerate([*digits, sum(digits) % 3]):
        out[top * BLOCK : (top + 4) * BLOCK, k * BLOCK : (k + 1) * BLOCK] = True
    return out


def piece(chars: str) -> np.ndarray:
    """Letters from right to left, joined by a thin stroke."""
    stroke = np.zeros((ROWS * BLOCK, STROKE), bool)
    stroke[3 * BLOCK - 1 : 3 * BLOCK + 1] = True
    out = letter(chars[0])
    for char in chars[1:]:
        out = np.concatenate([letter(char), stroke, out], axis=1)
    return out


def drawn(words: list[str]) -> np.ndarray:
    """A page of words, right to left and top down: ink 0 on paper 255."""
    rows: list[list[str]] = [[]]
    for word in words:
        if sum(map(len, rows[-1])) + len(word) > LINE_LETTERS and rows[-1]:
            rows.append([])
        rows[-1].append(word)
    width = max(2 * MARGIN + max((sum(len(w) for w in r) * (COLUMNS * BLOCK + GAP) + len(r) * GAP for r in rows)), 200)
    page = np.full((max(300, 2 * MARGIN + len(rows) * 2 * ROWS * BLOCK), width), 255, np.uint8)
    for k, row in enumerate(rows):
        right, top = width - MARGIN, MARGIN + k * 2 * ROWS * BLOCK
        for word in row:
            for at in range(0, len(word), 2):
                ink = piece(word[at : at + 2])
                page[top : top + ink.shape[0], right - ink.shape[1] : right][ink] = 0
                right -= ink.shape[1] + GAP
            right -= GAP
    return page


def as_pages(rows: DataFrame, key: str) -> DataFrame:
    """Page images of rows (key, words)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            images = [drawn(list(w)) for w in frame["words"]]
            yield pd.DataFrame({"page": frame[key].astype(str), "height": [i.shape[0] for i in images], "width": [i.shape[1] for i in images], "channels": 1, "data": [i.tobytes() for i in images]})

    spread = rows.select(key, "words").repartition(rows.sparkSession.sparkContext.defaultParallelism, key)  # a page is little text and much work
    return spread.mapInPandas(run, PAGE)


def training_pages(spark: SparkSession) -> DataFrame:
    """A page for each letter: alone, and joined to others on either side."""
    words = [(c, [c, *(x for k in (1, 5) for x in (c + LETTERS[(n + k) % len(LETTERS)], LETTERS[(n + 3 * k) % len(LETTERS)] + c))]) for n, c in enumerate(LETTERS)]
    return as_pages(spark.createDataFrame(words, "letter string, words array<string>"), "letter")


def training_rows(spark: SparkSession) -> DataFrame:
    """(label, features) of the characters that the segmentation finds on the training pages, by their place there."""
    crops = R.characters(training_pages(spark))
    # pieces in reading order: the letter alone, then twice first of two and last of two
    mine = F.when(F.col("paw") == 0, F.lit(0)).when(F.col("paw") % 2 == 1, F.lit(0)).otherwise(F.lit(1))
    return R.features(crops.where(F.col("char") == mine), ["page", "above", "below", "spread"]).select(F.col("page").alias("label"), "features")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, words) of the benchmark: its words in lower case."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(f"[{SCRIPT}]+"), F.lit(0))
    return table(spark, sf_dir, "benchmark").select("item_id", words.alias("words")).where("size(words) > 0")


def language_model(spark: SparkSession, sf_dir: str) -> tuple[D.Bigrams, dict[str, float]]:
    """Bigrams and word bonuses of the documents in lower case, up to the caps of the configuration."""
    lower = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    toks = C.tokens(lower, SCRIPT)
    counts = C.word_frequency_top(toks, CONFIG.frequency_cap)
    lexicon = C.capped_vocabulary(toks, CONFIG.lexicon_cap).select("word")
    words = lexicon.union(counts.select("word")).distinct().withColumn("conf", F.lit(0.0))
    scored = C.rescored(words, counts, lexicon, CONFIG.lexicon_bonus, CONFIG.frequency_weight)
    return D.bigram_dict(C.bigrams_within_words(toks)), {r["word"]: r["score"] for r in scored.select("word", "score").collect()}


def classifier(spark: SparkSession) -> Classifier:
    return Classifier("rf", trees=TREES).fit(training_rows(spark))


def flagship_recognise(spark, sf_dir):
    """(item_id, text, n_truth, distance, change): what was read on each item's page, against what was drawn."""
    rows = items(spark, sf_dir)
    labels = spark.createDataFrame([(c, c, c, None, None) for c in LETTERS], "label string, base string, glyph string, exp_above int, exp_below int")
    told = R.recognised(as_pages(rows, "item_id"), classifier(spark), *language_model(spark, sf_dir), CONFIG, labels)
    truth = rows.select(F.col("item_id").cast("string").alias("page"), "item_id", F.array_join("words", " ").alias("truth"))
    both = told.join(truth, "page").withColumn("text", F.translate("text", "\n", " "))
    return both.select("item_id", "text", F.length("truth").cast("long").alias("n_truth"), F.levenshtein("text", "truth").cast("long").alias("distance"), F.round(X.relative_change(F.col("text"), F.col("truth")), 6).alias("change"))


def page_kernels_e2e(spark, sf_dir):
    """Characters of the drawn pages by form and line: the page kernels from image to crops."""
    crops = R.characters(as_pages(items(spark, sf_dir), "item_id"))
    return crops.groupBy("page", "line", "position").agg(F.count("*").alias("n"), F.sum(F.col("x2") - F.col("x1")).cast("long").alias("width"))


QUERIES = {f.__name__: f for f in (flagship_recognise, page_kernels_e2e)}
SQL: dict[str, str] = {}
