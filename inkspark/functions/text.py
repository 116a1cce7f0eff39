"""Scalar text functions over columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RLM = "‏"
#: The range of the short-vowel marks.
HARAKAT = "ً-ٟ"


def strip_marks(text: Column, marks: str = HARAKAT) -> Column:
    """The text without the characters of the range ``marks``; null stays null."""
    return F.regexp_replace(text, f"[{marks}]", "")


def nfc(text: Column) -> Column:
    """Canonical composition; there is no built-in for it. Null stays null."""

    @F.pandas_udf("string")
    def compose(part: pd.Series) -> pd.Series:
        return part.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))

    return compose(text)


def in_script(char: Column, script: str) -> Column:
    return char.rlike(f"^[{script}]$")


def join_rtl(words: Column) -> Column:
    """Words joined by blanks between two right-to-left marks."""
    return F.concat(F.lit(RLM), F.array_join(words, " "), F.lit(RLM))


def non_script_count(text: Column, script: str) -> Column:
    """Characters that are neither of the script nor white space."""
    return F.length(F.regexp_replace(text, f"[{script}\\s]", ""))


def relative_change(a: Column, b: Column) -> Column:
    """Edit distance over the longer length (1 at least)."""
    return F.levenshtein(a, b) / F.greatest(F.lit(1), F.length(a), F.length(b))


def base_of(label: Column) -> Column:
    """A label without its last ``_`` part; a label without one as it is."""
    return F.regexp_replace(label, "_[^_]*$", "")
