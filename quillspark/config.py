"""Settings of normalisation, index build and serving, with quality profiles.

A field given by the caller is *explicit*: it wins over the profile, which wins over the default.
"""

from __future__ import annotations

import dataclasses
import importlib.util
from dataclasses import dataclass, field, fields
from typing import Any

MAX_CONTEXT = 6


class _Tracked:
    """Dataclass mix-in that remembers which fields the caller gave."""

    def __new__(cls, *args: Any, **given: Any):
        self = super().__new__(cls)
        names = [f.name for f in fields(cls)]
        object.__setattr__(self, "_explicit", frozenset(names[: len(args)]) | frozenset(given))
        return self

    def __reduce__(self):
        return (_rebuild, (type(self), dataclasses.asdict(self), self._explicit))


def _rebuild(cls, values, explicit):
    if "normalization" in values:
        values = values | {"normalization": NormalizationConfig(**values["normalization"])}
    out = cls(**values)
    object.__setattr__(out, "_explicit", explicit)
    return out


@dataclass(frozen=True)
class NormalizationConfig:
    lowercase: bool = True
    unicode_nfkc: bool = True
    strip_accents: bool = False
    strip_punctuation: bool = True
    split_sentences: bool = True
    pysbd_language: str | None = None

    def __post_init__(self) -> None:
        if self.pysbd_language is not None:
            if not str(self.pysbd_language).strip():
                raise ValueError("pysbd_language must name a language")
            if importlib.util.find_spec("pysbd") is None:
                raise ImportError("pysbd_language needs the optional package pysbd")


@dataclass(frozen=True)
class BuildConfig(_Tracked):
    max_generated_words: int = 4
    max_indexed_prefix_chars: int = 24
    max_context_tokens: int = 3
    top_tokens_per_prefix: int = 64
    top_next_tokens: int = 32
    top_next_phrases: int = 16
    phrase_min_count: int = 2
    phrase_min_doc_freq: int = 1
    phrase_min_pmi: float = 0.0
    phrase_max_dominant_extension_ratio: float = 0.95
    phrase_boundary_generic_min_count: int = 8
    phrase_max_len: int = 4
    vocab_prune_min_total_tokens: int | None = 100_000
    vocab_prune_min_unigram_count: int = 2
    vocab_prune_min_segment_freq: int = 2
    vocab_prune_rescue_unigram: int = 12
    vocab_prune_line_count_to_apply_df: int = 5_000
    normalization: NormalizationConfig = field(default_factory=NormalizationConfig)

    def __post_init__(self) -> None:
        if self.max_context_tokens > MAX_CONTEXT:
            raise ValueError(f"max_context_tokens can be {MAX_CONTEXT} at most")


@dataclass(frozen=True)
class SuggestConfig(_Tracked):
    default_top_k: int = 10
    default_length_bias: float = 0.5
    max_suggestion_words: int = 4
    beam_width: int = 24
    token_branch_limit: int = 8
    phrase_branch_limit: int = 8
    prior_weight: float = 0.35
    noise_penalty_weight: float = 0.35
    suppress_redundant_continuations: bool = True
    min_context_support_ratio: float = 0.0
    context_support_penalty_weight: float = 0.25
    collapse_prefix_ladders: bool = True
    collapse_prefix_ladder_strategy: str = "best"
    unknown_context_strategy: str = "skip"
    normalize_phrase_scores_by_length: bool = False
    fuzzy_prefix: bool | str = "auto"
    max_edit_distance: int = 2

    def __post_init__(self) -> None:
        if self.fuzzy_prefix not in (True, False, "auto"):
            raise ValueError("fuzzy_prefix is True, False or 'auto'")
        if self.max_edit_distance < 0:
            raise ValueError("max_edit_distance can't be negative")
        if self.collapse_prefix_ladder_strategy not in ("best", "prefer_longest", "prefer_shortest"):
            raise ValueError("collapse_prefix_ladder_strategy is 'best', 'prefer_longest' or 'prefer_shortest'")
        if self.unknown_context_strategy not in ("skip", "strict"):
            raise ValueError("unknown_context_strategy is 'skip' or 'strict'")


def _phrases(count: int, df: int, pmi: float, ratio: float | None) -> dict[str, Any]:
    out: dict[str, Any] = {"phrase_min_count": count, "phrase_min_doc_freq": df, "phrase_min_pmi": pmi}
    return out if ratio is None else out | {"phrase_max_dominant_extension_ratio": ratio}


def _serving(beam: int, tokens: int, phrases: int, noise: float, support: float, collapse: bool | None) -> dict[str, Any]:
    out: dict[str, Any] = {"beam_width": beam, "token_branch_limit": tokens, "phrase_branch_limit": phrases, "noise_penalty_weight": noise, "context_support_penalty_weight": support}
    return out if collapse is None else out | {"collapse_prefix_ladders": collapse}


PROFILES: dict[str, tuple[dict[str, Any], dict[str, Any]]] = {
    "balanced": ({}, {}),
    "precision": (_phrases(3, 2, 0.15, 0.8) | {"vocab_prune_min_unigram_count": 3}, _serving(18, 6, 6, 0.6, 0.45, True) | {"min_context_support_ratio": 0.25}),
    "recall": (_phrases(2, 1, -0.25, 1.0) | {"vocab_prune_min_total_tokens": None}, _serving(32, 12, 12, 0.15, 0.1, False)),
    "code_or_logs": (_phrases(2, 1, -0.1, None) | {"max_indexed_prefix_chars": 32, "phrase_boundary_generic_min_count": 4}, _serving(28, 10, 8, 0.05, 0.15, False)),
    "natural_language": (_phrases(3, 2, 0.25, 0.82), _serving(24, 8, 10, 0.5, 0.35, True)),
}


def _layered(kind: type, profile: dict[str, Any], given: Any):
    values = {f.name: getattr(kind(), f.name) for f in fields(kind)} | profile
    if given is not None:
        values |= {n: getattr(given, n) for n in given._explicit}
    return kind(**values)


def apply_quality_profile(profile: str = "balanced", build: BuildConfig | None = None, suggest: SuggestConfig | None = None) -> tuple[BuildConfig, SuggestConfig]:
    """The configs of a profile, overridden by the explicit fields of ``build`` and ``suggest``."""
    if profile not in PROFILES:
        raise ValueError(f"no quality profile {profile!r}")
    b, s = PROFILES[profile]
    return _layered(BuildConfig, b, build), _layered(SuggestConfig, s, suggest)


def to_dict(config: Any) -> dict[str, Any]:
    return dataclasses.asdict(config)


def build_config(values: dict[str, Any]) -> BuildConfig:
    """A BuildConfig from its dictionary, as stored in a manifest."""
    v = dict(values)
    if isinstance(v.get("normalization"), dict):
        v["normalization"] = NormalizationConfig(**v["normalization"])
    return BuildConfig(**v)
