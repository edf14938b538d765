"""Settings of the engine, from the environment where it names them."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    target_words: int = 420
    min_words: int = 180
    overlap_words: int = 64
    max_heading_words: int = 12
    embedding_provider: str = "hashing"
    embedding_dimensions: int = 128
    reranker: str = "token_overlap"
    candidate_multiplier: int = 4
    enable_lexical: bool = True
    rrf_k: int = 20
    dense_weight: float = 0.6
    lexical_weight: float = 0.4
    rerank_weight: float = 0.65
    answer_provider: str = "extractive"
    answer_model: str | None = None
    max_upload_mb: int = 50

    @classmethod
    def from_env(cls, prefix: str = "INKWELL_", env: dict[str, str] | None = None) -> Settings:
        """The defaults, with what INKWELL_TARGET_WORDS and the like say."""
        env, made = dict(os.environ if env is None else env), {}
        for f in fields(cls):
            if (said := env.get(prefix + f.name.upper())) is not None:
                kind = type(f.default) if f.default is not None else str
                made[f.name] = said.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(said)
        return cls(**made)
