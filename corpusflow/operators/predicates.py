"""Stages that reject documents."""

from __future__ import annotations

from collections.abc import Iterable
from os import PathLike
from pathlib import Path
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.symbols import special_table
from corpusflow.functions.taggers import Tagger, pieces
from corpusflow.functions.text import escaped, json_quoted_native, pattern_count, trie_pattern
from corpusflow.plans.stage import Change, Stage, State
from corpusflow.sources.dictionary import read_words

DICTS = Path(__file__).resolve().parent.parent / "dicts"
KATAKANA = "[ァ-ヴー]"


class DiscardContainingKeyword(Stage):
    """Reject what contains a keyword (the empty one is in every text)."""

    def __init__(self, keyword: str, **kwargs: Any) -> None:
        super().__init__(**kwargs)
        self.keyword = keyword

    def plan(self, s: State) -> Change:
        return Change(reject=s.text.contains(self.keyword))


class DiscardAll(Stage):
    """Reject everything."""

    def plan(self, s: State) -> Change:
        return Change(reject=F.lit(True))


class DocumentLengthFilter(Stage):
    """Reject what has fewer or more characters than the bounds, which are both inclusive and optional."""

    def __init__(self, min_doc_len: int | None = None, max_doc_len: int | None = None, **kwargs: Any) -> None:
        super().__init__(**kwargs)
        self.min_doc_len = min_doc_len
        self.max_doc_len = max_doc_len

    def plan(self, s: State) -> Change:
        n, bad = F.length(s.text), F.lit(False)
        if self.min_doc_len is not None:
            bad = bad | (n < self.min_doc_len)
        if self.max_doc_len is not None:
            bad = bad | (n > self.max_doc_len)
        return Change(reject=bad)


def katakana_only(word: str) -> bool:
    return bool(word) and all("ァ" <= c <= "ヴ" or c == "ー" for c in word)


def ja_patterns(words: list[str], ignore_confused: bool) -> tuple[str, str]:
    """(pattern for yes or no, pattern whose leftmost match is the word found)."""
    if not ignore_confused:
        return ("" if "" in words else trie_pattern(words)), "|".join(map(escaped, words))
    plain, kata = [w for w in words if not katakana_only(w)], [w for w in words if katakana_only(w)]
    alone = f"(?<!{KATAKANA})(?:{'|'.join(map(escaped, kata))})(?!{KATAKANA})"
    ordered = "|".join(map(escaped, plain)) + "|" + alone
    if not plain or "" in plain:
        return ordered, ordered  # an empty alternative is found everywhere
    return trie_pattern(plain) + "|" + (f"(?<!{KATAKANA})(?:{trie_pattern_exact(kata)})(?!{KATAKANA})" if kata else alone), ordered


def trie_pattern_exact(words: Iterable[str]) -> str:
    """Alternatives, the longest first: with boundaries, shorter words don't stand for longer ones."""
    return "|".join(escaped(w) for w in sorted(set(words), key=lambda w: (-len(w), w)))


class NgWordsFilterJa(Stage):
    """Reject what contains a word of a dictionary (a file with a word on each line).

    ignore_confused: words of katakana only count where no katakana is next to them.
    The reason has the word found first and 20 characters around it.
    """

    def __init__(self, dict_path: str | PathLike | None = None, ignore_confused: bool = False, *, words: Iterable[str] | None = None, **kwargs: Any) -> None:
        super().__init__(**kwargs)
        self._words = list(words) if words is not None else read_words(dict_path)
        self._ignore_confused = ignore_confused

    def plan(self, s: State) -> Change:
        test, ordered = ja_patterns(self._words, self._ignore_confused)
        if not self._words:
            return Change(reject=F.lit(True))  # the empty pattern
        word = F.regexp_extract(s.text, f"({ordered})", 1)
        start = F.length(F.regexp_extract(s.text, f"(?s)^(.*?)(?:{ordered})", 1))
        end, size = start + F.length(word), F.length(s.text)
        first = F.when(start >= 20, start - 20).otherwise(F.greatest(F.lit(0), size + start - 20))
        around = F.substring(s.text, first + 1, F.greatest(F.lit(0), F.least(end + 20, size) - first))
        return Change(reject=s.text.rlike(test), reason={"matched_text": json_quoted_native(word), "matched_text_neighbor": json_quoted_native(around)})


class NgWordsFilterEn(Stage):
    """Reject what contains a word of a dictionary, in any case, after the start or a space and before a space, comma, full stop or the end."""

    def __init__(self, dict_path: str | PathLike | None = None, *, words: Iterable[str] | None = None, **kwargs: Any) -> None:
        super().__init__(**kwargs)
        self._words = list(words) if words is not None else read_words(dict_path)

    def plan(self, s: State) -> Change:
        return Change(reject=s.text.rlike(f"(?iud)(?:^| )(?:{'|'.join(map(escaped, self._words))})(?:[ ,.]|$)"))


class DiscardAdultContentJa(NgWordsFilterJa):
    """Reject Japanese adult content by dictionary; pass dict_path for a list of your own."""

    def __init__(self, dict_path: str | PathLike = DICTS / "adult_ja.txt", ignore_confused: bool = False, **kwargs: Any) -> None:
        super().__init__(dict_path, ignore_confused, **kwargs)


class DiscardAdultContentEn(NgWordsFilterEn):
    """Reject English adult content by dictionary."""

    def __init__(self, dict_path: str | PathLike = DICTS / "adult_en.txt", **kwargs: Any) -> None:
        super().__init__(dict_path, **kwargs)


class DiscardDiscriminationContentJa(NgWordsFilterJa):
    """Reject Japanese discriminating content by dictionary."""

    def __init__(self, dict_path: str | PathLike = DICTS / "discrimination_ja.txt", ignore_confused: bool = False, **kwargs: Any) -> None:
        super().__init__(dict_path, ignore_confused, **kwargs)


class DiscardViolenceContentJa(NgWordsFilterJa):
    """Reject Japanese violent content by dictionary."""

    def __init__(self, dict_path: str | PathLike = DICTS / "violence_ja.txt", ignore_confused: bool = False, **kwargs: Any) -> None:
        super().__init__(dict_path, ignore_confused, **kwargs)


def bbs_pattern() -> str:
    """Marks of bulletin boards: dates, words, and any hyphen."""
    date = "[ ]*\\d{1,2}".join(["\\d{4}[年./-]", "[月./-]", "日*"])
    words = ("コメント", "SOLD OUT", "レビュー", "投稿", "ページ", "\\([日月火水木金土]\\)", "質問", "\\d+話", "楽天市場", "-")
    return "|".join((date, *words))


class DiscardBBSComments(Stage):
    """Reject what has more than so many marks of bulletin boards and shops."""

    def __init__(self, max_allowed_num: int = 14, **kwargs: Any) -> None:
        super().__init__(**kwargs)
        self.max_allowed_num = max_allowed_num

    def plan(self, s: State) -> Change:
        return Change(reject=pattern_count(s.text, "(?U)" + bbs_pattern()) > self.max_allowed_num)


class DiscardAds(Stage):
    """Reject what has more than so many words of advertisements."""

    def __init__(self, dict_path: str | PathLike = DICTS / "ads_ja.txt", max_allowed_num: int = 14, *, words: Iterable[str] | None = None, **kwargs: Any) -> None:
        super().__init__(**kwargs)
        self._words = list(words) if words is not None else read_words(dict_path)
        self.max_allow_num = max_allowed_num

    def plan(self, s: State) -> Change:
        return Change(reject=pattern_count(s.text, "|".join(map(escaped, self._words))) > self.max_allow_num)


class AcceptJapanese(Stage):
    """Reject what has no hiragana or katakana in its first characters."""

    def __init__(self, lookup_size: int = 50, **kwargs: Any) -> None:
        super().__init__(**kwargs)
        self.lookup_size = lookup_size

    def plan(self, s: State) -> Change:
        return Change(reject=~F.substring(s.text, 1, self.lookup_size).rlike("[ぁ-んァ-ン]"))


class DiscardRareKuten(Stage):
    """Reject what has fewer Japanese full stops than one for so many characters."""

    def __init__(self, max_average_sentence_length: int = 100, **kwargs: Any) -> None:
        super().__init__(**kwargs)
        self.max_average_sentence_length = max_average_sentence_length

    def plan(self, s: State) -> Change:
        return Change(reject=pattern_count(s.text, "。") < F.length(s.text) / F.lit(self.max_average_sentence_length))


class DiscardTooManySpecialToken(Stage):
    """Reject what has more than a share of punctuation, white space, symbols and emoji."""

    def __init__(self, threshold: float = 0.4, **kwargs: Any) -> None:
        super().__init__(**kwargs)
        self.threshold = threshold

    def plan(self, s: State) -> Change:
        return Change(reject=_ratio(special_share)(s.wanted) > self.threshold)


class SingleCharacterRepetitionFilter(Stage):
    """Reject what has a run of so many equal characters."""

    def __init__(self, threshold: int = 200, **kwargs: Any) -> None:
        super().__init__(**kwargs)
        self.threshold = threshold

    def plan(self, s: State) -> Change:
        if self.threshold <= 0:
            return Change(reject=F.length(s.text) > 0)
        return Change(reject=s.text.rlike(f"(?s)(.)\\1{{{self.threshold - 1}}}"))


class DiscardTooManyEndingEllipsis(Stage):
    """Reject what has more than a share of its lines end in an ellipsis."""

    def __init__(self, threshold: float = 0.7, **kwargs: Any) -> None:
        super().__init__(**kwargs)
        self.threshold = threshold

    def plan(self, s: State) -> Change:
        breaks = F.greatest(pattern_count(s.text, "\n"), F.lit(1))
        return Change(reject=pattern_count(s.text, "(?:\\.{3}|…)\n") / breaks > self.threshold)


class DiscardTooShortLines(Stage):
    """Reject what has more than a share of lines of at most 10 characters."""

    def __init__(self, threshold: float = 0.5, **kwargs: Any) -> None:
        super().__init__(**kwargs)
        self.threshold = threshold

    def plan(self, s: State) -> Change:
        lines = F.split(s.text, "\n", -1)
        return Change(reject=F.size(F.filter(lines, lambda x: F.length(x) <= 10)) / F.size(lines) > self.threshold)


def special_share(text: str) -> float:
    """By a table of all code points: a regular expression of so many ranges, which the JVM tests one by one, took 25 times as long."""
    return float(special_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].mean()) if text else 0.0


def gram_counts(codes: np.ndarray, n: int, starts: np.ndarray | None = None) -> np.ndarray:
    """How often each n-gram of the codes (of those that start where starts is set) occurs.  Symbols are numbered densely, and grams again when their number would overflow."""
    number = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    base = int(number.max()) + 1
    grams, size = number[: len(number) - n + 1], base
    for k in range(1, n):
        if size > (1 << 62) // base:
            grams = np.unique(grams, return_inverse=True)[1].astype(np.int64)
            size = int(grams.max()) + 1
        grams = grams * base + number[k : len(number) - n + 1 + k]
        size *= base
    return np.unique(grams if starts is None else grams[starts], return_counts=True)[1]


def char_repetition(text: str, n: int) -> float:
    """Share that the commonest n-grams have; how many count as such depends on how many repeat."""
    if len(text) < n or n <= 0:
        return 0.0
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    counts = gram_counts(codes, n)
    top = min(int(np.sqrt(len(counts))), len(counts) - int((counts == 1).sum()))
    return float(np.sort(counts)[::-1][:top].sum() / counts.sum())


def word_repetition(chunks: Iterable[list[str]], n: int) -> float:
    """Share of word n-grams (within a chunk) that occur more than once."""
    if n <= 0:
        return 0.0
    numbers: dict[str, int] = {}
    parts: list[np.ndarray] = []
    for words in chunks:
        if len(words) >= n:
            parts.append(np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64))
    if not parts:
        return 0.0
    # a word of its own, never in a counted n-gram, ends each chunk
    flat = np.concatenate([x for p in parts for x in (p, [len(numbers)])])
    starts = np.ones(len(flat), dtype=bool)
    for p in np.flatnonzero(flat == len(numbers)):
        starts[max(0, p - n + 1) : p + 1] = False
    counts = gram_counts(flat, n, starts[: len(flat) - n + 1])
    return float(counts[counts > 1].sum() / counts.sum())


def _ratio(fn) -> Any:
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else fn(x))

    return run


class CharRepetitionRatioFilter(Stage):
    """Reject what consists of repeated character n-grams to at least a share."""

    def __init__(self, threshold: float = 0.33, ngram_size: int = 5, **kwargs: Any) -> None:
        super().__init__(**kwargs)
        self.threshold = threshold
        self.ngram_size = ngram_size

    def ratio(self, text: Column) -> Column:
        n = self.ngram_size
        return _ratio(lambda x: char_repetition(x, n))(text)

    def plan(self, s: State) -> Change:
        return Change(reject=self.ratio(s.wanted) >= self.threshold)


class WordRepetitionRatioFilter(Stage):
    """Reject what consists of repeated word n-grams to at least a share.  tagger: gives the words (the morphological one by default)."""

    def __init__(self, threshold: float = 0.40, ngram_size: int = 7, max_parse_chars: int = 100_000, *, tagger: Tagger | None = None, **kwargs: Any) -> None:
        super().__init__(**kwargs)
        self.threshold = threshold
        self.ngram_size = ngram_size
        self.max_parse_chars = max_parse_chars
        self._tagger = tagger or Tagger()

    def ratio(self, text: Column) -> Column:
        tagger, n, size = self._tagger, self.ngram_size, self.max_parse_chars
        return _ratio(lambda x: word_repetition(([w for w, _ in tagger(c)] for c in pieces(x, size)), n))(text)

    def plan(self, s: State) -> Change:
        return Change(reject=self.ratio(s.wanted) >= self.threshold)


class DiscardTooManyNouns(Stage):
    """Reject what has at least a share of nouns among its words without supplementary symbols."""

    def __init__(self, threshold: float = 0.80, max_parse_chars: int = 100_000, *, tagger: Tagger | None = None, **kwargs: Any) -> None:
        super().__init__(**kwargs)
        self.threshold = threshold
        self.max_parse_chars = max_parse_chars
        self._tagger = tagger or Tagger()

    def plan(self, s: State) -> Change:
        tagger, size = self._tagger, self.max_parse_chars

        def share(text: str) -> float:
            kinds = [kind for c in pieces(text, size) for _, kind in tagger(c) if kind != "補助記号"]
            return kinds.count("名詞") / len(kinds) if kinds else 0.0

        return Change(reject=_ratio(share)(s.wanted) >= self.threshold)
