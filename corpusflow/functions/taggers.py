"""Backends that need packages or models: loaded once in each Python worker, replaceable by any callable."""

from __future__ import annotations

from collections.abc import Iterator


def pieces(text: str, size: int) -> Iterator[str]:
    for k in range(0, len(text), size):
        yield text[k : k + size]


class Tagger:
    """Callable: text to [(surface, part of speech)].  This one uses the fugashi package with UniDic."""

    def __init__(self) -> None:
        self._tagger = None

    def __getstate__(self) -> dict:
        return {"_tagger": None}

    def __call__(self, text: str) -> list[tuple[str, str]]:
        if self._tagger is None:
            try:
                from fugashi import Tagger as Backend
            except ImportError as e:
                raise ImportError("this stage needs the fugashi package with UniDic, or a tagger of your own") from e
            self._tagger = Backend()
        return [(w.surface, w.feature.pos1) for w in self._tagger(text)]


class RegexTagger(Tagger):
    """Words by a regular expression, all of one part of speech."""

    def __init__(self, pattern: str = "[A-Za-z_0-9]+", kind: str = "") -> None:
        super().__init__()
        self.pattern, self.kind = pattern, kind

    def __getstate__(self) -> dict:
        return vars(self)

    def __call__(self, text: str) -> list[tuple[str, str]]:
        import re

        return [(w, self.kind) for w in re.findall(self.pattern, text)]


class LanguageModel:
    """Callable: texts to [(language, score)].  This one uses a fastText model file."""

    def __init__(self, model_path: str) -> None:
        self.model_path = model_path
        self._model = None

    def __getstate__(self) -> dict:
        return {"model_path": self.model_path, "_model": None}

    def __call__(self, texts: list[str]) -> list[tuple[str, float]]:
        if self._model is None:
            try:
                import fasttext
            except ImportError as e:
                raise ImportError("this stage needs the fasttext package and a model file, or a predictor of your own") from e
            self._model = fasttext.load_model(self.model_path)
        labels, scores = self._model.predict(texts)
        return [(names[0].removeprefix("__label__"), float(s[0])) for names, s in zip(labels, scores)]
