"""The document object that user-written stages see, one row at a time."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass
class Token:
    text: str
    is_rejected: bool = False
    original: str = ""

    def __post_init__(self) -> None:
        self.original = self.original or self.text


@dataclass
class Document:
    text: str
    is_rejected: bool = False
    tokens: list[Token] = field(default_factory=list)
    extras: dict[str, Any] = field(default_factory=dict)
    reject_reason: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._original = self.text

    @property
    def original(self) -> str:
        return self._original

    def copy(self) -> Document:
        out = Document(self.text, self.is_rejected, [Token(t.text, t.is_rejected, t.original) for t in self.tokens], dict(self.extras), dict(self.reject_reason))
        out._original = self._original
        return out

    def set_tokens(self, tokens: list[str]) -> None:
        self.tokens = [Token(t) for t in tokens]

    def get_tokens(self) -> list[str]:
        return [t.text for t in self.tokens]
