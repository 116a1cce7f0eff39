"""The language model as written tables: built from a corpus, and loaded for decoding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..config import Config
from ..sources import files
from . import corpus as C

BIGRAMS, LEXICON, FREQUENCY = "bigrams", "lexicon", "word_freq"


@dataclass(frozen=True)
class LanguageModel:
    """Bigrams (prev, next, p), lexicon (word) and frequencies (word, cnt); a part that was never written is empty."""

    bigrams: DataFrame
    lexicon: DataFrame
    frequency: DataFrame


def build_language_model(spark: SparkSession, docs: DataFrame, path: str, config: Config, words: DataFrame | None = None) -> None:
    """Write bigrams within words and the capped lexicon of (doc_id, text), joined with a further word list."""
    toks = C.tokens(docs, config.script)
    files.write_statistics(C.bigrams_within_words(toks).select("prev", "next", "p"), f"{path}/{BIGRAMS}")
    lexicon = C.capped_vocabulary(toks, config.lexicon_cap).select("word")
    files.write_statistics(lexicon if words is None else files.with_words(lexicon, words), f"{path}/{LEXICON}")


def build_word_frequency(spark: SparkSession, docs: DataFrame, path: str, config: Config) -> None:
    """Write the most frequent words of (doc_id, text) with their counts."""
    files.write_statistics(C.word_frequency_top(C.tokens(docs, config.script), config.frequency_cap), f"{path}/{FREQUENCY}")


def load_language_model(spark: SparkSession, path: str) -> LanguageModel:
    return LanguageModel(
        files.read_or_empty(spark, f"{path}/{BIGRAMS}", "prev string, next string, p double"),
        files.read_or_empty(spark, f"{path}/{LEXICON}", "word string"),
        files.read_or_empty(spark, f"{path}/{FREQUENCY}", "word string, cnt long"),
    )
