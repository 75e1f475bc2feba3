"""Word lists: a word on each line; empty lines don't count, white space around words goes."""

from __future__ import annotations

from os import PathLike
from pathlib import Path


def read_words(path: str | PathLike) -> list[str]:
    return [w.strip() for w in Path(path).read_text(encoding="utf-8").split("\n") if w]
