"""All constants that change results, in one frozen object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    aspect_set: str = "core"
    engine: str = "lexicon"
    language_filter: str | None = "en"
    min_review_chars: int = 15
    neutral_weight: float = 0.5
    min_mentions_for_score: int = 3
    shrinkage_strength: float = 5.0
    neutral_prior: float = 0.5
    polarity_cut: float = 0.18
    strength_cut: float = 0.70
    weakness_cut: float = 0.45
    agree_high: float = 0.6
    agree_low: float = 0.4
    max_sentence_chars: int = 320
    min_sentence_chars: int = 3
    annotator_batch: int = 10
    annotator_retries: int = 3
