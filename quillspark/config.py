"""Options of the pipeline, checked where they are made."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class PreprocessOptions:
    clean: bool = True
    dehyphenate: bool = True
    dot_leaders: bool = True
    strip_running_lines: bool = True
    drop_empty_pages: bool = True
    least_pages: int = 3
    least_letters: int = 40
    # Phrases of filler pages.
    phrases: tuple[str, ...] = (
        "для заметок", "для записей", "страница намеренно оставлена пустой", "намеренно оставлено пустым", "this page intentionally left blank", "notes",
    )


@dataclass(frozen=True)
class IngestionOptions:
    contextual: bool = False
    max_chunk: int = 800
    preprocess: bool = True
    cleaning: PreprocessOptions = field(default_factory=PreprocessOptions)


@dataclass(frozen=True)
class EmbeddingOptions:
    model: str = "hash-64"
    dimensions: int = 64
    batch: int = 32


@dataclass(frozen=True)
class RerankOptions:
    mode: str = "none"
    candidates: int = 20
    floor: float = 0.0

    def __post_init__(self):
        if self.mode not in ("none", "llm", "cross-encoder", "remote"):
            raise ValueError(f"unknown rerank mode {self.mode}")


@dataclass(frozen=True)
class StoreOptions:
    folder: str = "store"
    rrf_constant: int = 60
    over_fetch: int = 4


@dataclass(frozen=True)
class TokenBudgets:
    """What is left for the base chunk once enrichment has its share of the ceiling."""

    ceiling: int
    context: int = 0
    multimodal: int = 0

    def __post_init__(self):
        if min(self.ceiling, self.context, self.multimodal) < 0 or self.base <= 0:
            raise ValueError("the shares leave no room for the base chunk")

    @property
    def base(self) -> int:
        return self.ceiling - self.context - self.multimodal


@dataclass(frozen=True)
class Features:
    """Flags by dotted name; what is missing or no boolean is off."""

    values: Mapping[str, Any] = field(default_factory=dict)

    def _find(self, name: str) -> Any:
        node: Any = self.values
        for part in name.split("."):
            node = node.get(part) if isinstance(node, Mapping) else None
        return node

    def enabled(self, name: str) -> bool:
        v = self._find(name)
        return v is True or isinstance(v, str) and v.strip().lower() == "true"

    def get(self, name: str, default: Any = None) -> Any:
        v = self._find(name)
        return default if v is None else v
