"""Language identification with a model that is loaded once in each worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import functions as F

from corpusflow.functions.taggers import LanguageModel
from corpusflow.plans.stage import Change, Stage, State

Predictor = Callable[[list[str]], list[tuple[str, float]]]


class LanguageIdentificationByFastText(Stage):
    """Reject what isn't the language with at least the score.  predictor: any callable from texts to (language, score)."""

    def __init__(self, language: str, lang_score_threshold: float = 0.50, model_path: str | None = None, *, predictor: Predictor | None = None, **kwargs: Any) -> None:
        super().__init__(**kwargs)
        if predictor is None and model_path is None:
            raise ValueError("give a model_path (a file that every worker can read) or a predictor")
        self.language = language
        self.lang_score_threshold = lang_score_threshold
        self._predictor = predictor or LanguageModel(str(model_path))

    def plan(self, s: State) -> Change:
        predictor, language, least = self._predictor, self.language, self.lang_score_threshold

        @F.pandas_udf("boolean")
        def reject(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                at = [k for k, t in enumerate(texts) if t is not None]
                found = predictor([texts[k].strip().replace("\n", " ") for k in at]) if at else []
                out = pd.Series([None] * len(texts), dtype=object)  # a null text is kept, as in other stages
                out[at] = [not (name == language and score >= least) for name, score in found]
                yield out

        return Change(reject=reject(s.wanted))


class AcceptJapaneseByFastText(LanguageIdentificationByFastText):
    """Reject what isn't Japanese."""

    def __init__(self, lang_score_threshold: float = 0.50, model_path: str | None = None, **kwargs: Any) -> None:
        super().__init__("ja", lang_score_threshold, model_path, **kwargs)
