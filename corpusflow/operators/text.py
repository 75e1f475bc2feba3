"""Stages that rewrite text, and stages for debugging."""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import functions as F

from corpusflow.functions.text import nfkc
from corpusflow.plans.stage import Change, Stage, State


class AppendTag(Stage):
    """Append a literal."""

    def __init__(self, tag: str = "<tag>", **kwargs: Any) -> None:
        super().__init__(**kwargs)
        self.tag = tag

    def plan(self, s: State) -> Change:
        return Change(text=F.concat(s.text, F.lit(self.tag)))


class Identity(Stage):
    """Change nothing."""

    def plan(self, s: State) -> Change:
        return Change()


class Sleep(Stage):
    """Sleep for some seconds on each document (to test slow stages)."""

    def __init__(self, time: float = 1.0, **kwargs: Any) -> None:
        super().__init__(**kwargs)
        self.time = time

    def plan(self, s: State) -> Change:
        seconds = self.time

        @F.pandas_udf("string")
        def wait(texts: pd.Series) -> pd.Series:
            import time

            time.sleep(seconds * texts.notna().sum())
            return texts

        return Change(text=wait(s.wanted))


class ApplyDiscard(Stage):
    """Empty the text of rejected documents; needs skip_rejected=False to see any within a pipeline."""

    def plan(self, s: State) -> Change:
        return Change(text=F.when(s.is_rejected, F.lit("")).otherwise(s.text))


class DocumentNormalizer(Stage):
    """Unicode NFKC."""

    def plan(self, s: State) -> Change:
        return Change(text=nfkc(s.wanted))


_SEPARATOR = "[- ]?"
#: digits of the middle groups of the telephone numbers that are masked
_GROUPS = ((2, 4), (1, 4), (2, 3), (3, 2), (4, 1))
_ATOM = "A-Za-z0-9!#$%&'*+/=?^_`{|}~.-"


def phone_pattern() -> str:
    middle = "|".join(f"\\d{{{a}}}{_SEPARATOR}\\d{{{b}}}{_SEPARATOR}" for a, b in _GROUPS)
    return f"((?:0|\\+\\d{{1,3}}{_SEPARATOR})(?:{middle}))\\d{{4}}"


def email_pattern() -> str:
    return f"[{_ATOM}]+@[{_ATOM}]+(\\.[A-Za-z0-9-]+)"


class MaskPersonalInformation(Stage):
    """Mask the last four digits of telephone numbers, and e-mail addresses but for their last label."""

    def plan(self, s: State) -> Change:
        text = F.regexp_replace(s.text, "(?U)" + phone_pattern(), "$1XXXX")
        return Change(text=F.regexp_replace(text, email_pattern(), "xxxx@yyy$1"))
