"""Settings of fingerprinting, scoring and verdicts."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class FingerprintConfig:
    shingle_sizes: tuple[int, ...] = (3, 4, 5)
    min_word_length: int = 2
    drop_stopwords: bool = False
    hash_algorithm: str = "md5"
    hash_length: int = 16
    language: str | None = None


@dataclass(frozen=True)
class MatchConfig:
    window_ms: int = 30_000
    run_gap_ms: int = 4_000
    top_n: int = 5
    min_exact_margin: float = 0.06
    duration_tolerance: float = 0.15
    review_confidence: float = 0.35
    runtime_tolerance_min: float = 4.0


@dataclass(frozen=True)
class FuzzyConfig:
    min_lcs_ratio: float = 0.45
    min_query_tokens: int = 8
    weight: float = 1.0
    min_margin: float = 0.12


@dataclass(frozen=True)
class NgramConfig:
    n: int = 2
    min_similarity: float = 0.20
    min_margin: float = 0.05
    replace_below: float = 0.40
