"""Settings from the environment, checked when they are read."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields


class ConfigError(ValueError):
    """A setting can't be read as its type or is out of range."""


def _flag(value: str) -> bool:
    low = value.strip().lower()
    if low in ("1", "true", "yes", "on"):
        return True
    if low in ("0", "false", "no", "off"):
        return False
    raise ValueError(low)


_READ: dict[str, Callable[[str], object]] = {"int": int, "float": float, "bool": _flag, "str": str}


@dataclass(frozen=True)
class Config:
    chunk_size: int = 1000
    chunk_overlap: int = 150
    top_k: int = 5
    threshold: float = 0.35
    bm25_threshold: float = 1.0
    similarity_threshold: float = 0.7
    max_context: int = 4000
    max_quotes: int = 80
    max_quote_chars: int = 24_000
    max_question: int = 4000
    history_messages: int = 6
    debug: bool = False

    def __post_init__(self) -> None:
        if self.top_k <= 0 or not 0 <= self.threshold <= 1:
            raise ConfigError("top_k must be greater than 0 and threshold between 0 and 1")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ConfigError("chunk_overlap must be at least 0 and less than chunk_size")

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ, prefix: str = "SHEAF_") -> Config:
        """Fields from variables such as SHEAF_TOP_K."""
        given = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is not None and raw.strip():
                try:
                    given[f.name] = _READ[f.type](raw)
                except ValueError as error:
                    raise ConfigError(f"{prefix}{f.name.upper()} isn't {f.type}: {raw!r}") from error
        return cls(**given)


@dataclass(frozen=True)
class AnswerOptions:
    """What a question may ask for besides its answer."""

    top_k: int | None = None
    evidence_mode: str = "balanced"
    history_messages: int = 6
    answer_style: str = "concise"
    answer_language: str = "auto"

    def __post_init__(self) -> None:
        if self.top_k is not None and (type(self.top_k) is not int or not 3 <= self.top_k <= 8):
            raise ConfigError("top_k must be a whole number from 3 to 8")
        if self.history_messages not in (0, 6, 12, 20):
            raise ConfigError("history_messages must be 0, 6, 12 or 20")
        if self.evidence_mode not in ("balanced", "strict"):
            raise ConfigError("evidence_mode must be balanced or strict")
