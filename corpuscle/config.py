"""Settings with typed defaults, read from the environment once and passed on as a value."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    """Sizes are in characters; environment variables are the field names in upper case."""

    chunk_target: int = 6144
    chunk_max: int = 7680
    chunk_overlap: int = 1228
    embedding_dim: int = 768
    embed_batch: int = 100
    top_k: int = 10
    text_limit: int = 8000
    min_text: int = 10
    first_book: int = 0
    last_book: int = 14

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Config:
        env = dict(os.environ) if env is None else env
        return cls(**{f.name: int(env[f.name.upper()]) for f in fields(cls) if f.name.upper() in env})
