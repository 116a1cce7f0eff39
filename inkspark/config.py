"""Constants of the recognition pipeline, as one immutable value that operators take as an argument."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Thresholds and weights of the pipeline. ``script`` is the body of a character class."""

    script: str = "؀-ۿ"
    max_side: int = 2000
    top_k: int = 15
    beam_width: int = 50
    max_span: int = 8
    space_penalty: float = 0.0
    lexicon_cap: int = 500_000
    frequency_cap: int = 100_000
    bigram_miss: float = 1e-6
    lexicon_bonus: float = 0.25
    frequency_weight: float = 15.0
    match_boost: float = 0.20
    mismatch_penalty: float = 0.10
    filter_boost: float = 0.20
    filter_penalty: float = 0.0
    default_height: float = 20.0


#: The script range of the driver's documents, which hold no right-to-left text.
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
