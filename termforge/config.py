"""Settings of the extraction, as frozen dataclasses; JSON may give some fields, and unknown ones are refused."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field

#: Raised whenever results may change for the same settings and lists.
LOGIC = 1
VERSION = "0.1.0"


@dataclass(frozen=True)
class Prose:
    min_mean_sentence_len: float = 8.0
    min_stopword_ratio: float = 0.20
    max_table_line_ratio: float = 0.40
    min_tokens: int = 120


@dataclass(frozen=True)
class Thresholds:
    """Least scores of shape candidates; the topical one is the highest raw score (lower is better)."""

    identifier: float = 0.55
    technical: float = 0.38
    topical: float = 0.15


@dataclass(frozen=True)
class ShapeWeights:
    internal_caps: float = 0.12
    digit_letter_mix: float = 0.25
    separator_segments: float = 0.12
    unusual_length: float = 0.03
    absent_from_wordlist: float = 0.40
    short_all_caps: float = 0.06
    in_document_frequency: float = 0.02


@dataclass(frozen=True)
class Config:
    min_content_length: int = 16
    no_text_layer_threshold: int = 32
    wordlist_size: int = 65_000
    acronym_wordlist_depth: int = 20_000
    thresholds: Thresholds = field(default_factory=Thresholds)
    shape_weights: ShapeWeights = field(default_factory=ShapeWeights)
    prose: Prose = field(default_factory=Prose)
    strip_quoted_blocks: bool = True
    enable_definitions: bool = True
    enable_topical: bool = True
    yake_ngram_max: int = 3
    retain_features: bool = False

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), indent=2)

    @classmethod
    def from_json(cls, text: str) -> Config:
        return _filled(cls, json.loads(text))

    def replace(self, **changes) -> Config:
        return dataclasses.replace(self, **changes)

    def stamp(self, digests: tuple[str, ...] = (), parsers: str = "") -> str:
        """64 hex digits that change with the logic, the parsers, the lists and every setting but retain_features."""
        told = {k: v for k, v in dataclasses.asdict(self).items() if k != "retain_features"}
        return hashlib.sha256(json.dumps(["termforge", VERSION, LOGIC, parsers, told, list(digests)], sort_keys=True).encode()).hexdigest()


def _filled(kind, given: dict):
    known = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := sorted(set(given) - set(known)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    nested = {"thresholds": Thresholds, "shape_weights": ShapeWeights, "prose": Prose}
    return kind(**{k: _filled(nested[k], v) if k in nested and isinstance(v, dict) else v for k, v in given.items()})
