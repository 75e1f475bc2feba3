"""Stages on tokens: an array of structs beside the text, transformed by higher-order functions."""

from __future__ import annotations

from collections.abc import Iterable
from os import PathLike
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.document import Token
from corpusflow.functions.text import WHITESPACE, escaped
from corpusflow.plans.stage import Change, Stage, State
from corpusflow.schema import TOKENS
from corpusflow.sources.dictionary import read_words

DICTS = Path(__file__).resolve().parent.parent / "dicts"


def as_tokens(texts: Column) -> Column:
    """Fresh tokens of an array of strings."""
    return F.transform(texts, lambda x: F.struct(x.alias("text"), x.alias("original"), F.lit(False).alias("is_rejected")))


def sentences(text: Column) -> Column:
    """The text cut after each Japanese full stop; of an empty text one empty sentence."""
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit("[^。]*。|[^。]+"), F.lit(0)))


def blank_split(text: Column) -> Column:
    """The text cut at white space, without empty pieces."""
    return F.filter(F.split(text, WHITESPACE, -1), lambda x: x != "")


class TokenStage(Stage):
    uses_tokens = True


class BlankCharTokenizer(TokenStage):
    """Tokens are what stands between white space."""

    def plan(self, s: State) -> Change:
        return Change(tokens=as_tokens(blank_split(s.text)))


class SentenceTokenizer(TokenStage):
    """Tokens are sentences that end in a Japanese full stop."""

    def plan(self, s: State) -> Change:
        return Change(tokens=as_tokens(sentences(s.text)))


class MergeTokens(TokenStage):
    """The text becomes that of all tokens that aren't rejected, one after another."""

    def plan(self, s: State) -> Change:
        left = F.filter(s.tokens, lambda t: ~t["is_rejected"])
        return Change(text=F.array_join(F.transform(left, lambda t: t["text"]), ""))


class HeaderFooterTagsRemover(TokenStage):
    """Reject tokens at the start that begin with a keyword, or whose counterpart at the end does.

    1, 2 or 3 tokens are looked at on either side, of 1 to 3, 4 to 5 or more tokens.
    A hit at the end rejects the token as far from the start, as pipelines made for
    this stage expect; fix_tail=True rejects the one at the end instead.
    """

    def __init__(self, dict_path: str | PathLike = DICTS / "header_footer_ja.txt", *, words: Iterable[str] | None = None, fix_tail: bool = False, **kwargs: Any) -> None:
        super().__init__(**kwargs)
        self._pattern = "^(?:" + "|".join(map(escaped, list(words) if words is not None else read_words(dict_path))) + ")"
        self._fix_tail = fix_tail

    def should_drop_token(self, token: Token) -> bool:
        import re

        return re.match(self._pattern[1:], token.text) is not None

    def plan(self, s: State) -> Change:
        n = F.size(s.tokens)
        window = F.when(n < 4, 1).when(n < 6, 2).otherwise(3)
        hit = lambda i: F.coalesce(F.get(s.tokens, i)["text"].rlike(self._pattern), F.lit(False))

        def mark(t: Column, i: Column) -> Column:
            mirror = n - 1 - i
            head = (i < window) & hit(i)
            tail = (mirror < window) & hit(i) if self._fix_tail else (i < window) & hit(mirror)
            return F.struct(t["text"].alias("text"), t["original"].alias("original"), (t["is_rejected"] | head | tail).alias("is_rejected"))

        return Change(tokens=F.transform(s.tokens, mark))


class TokenFilter(TokenStage):
    """Applied to each token; those rejected before are dropped.

    Override ``apply_token`` (a Token in Python, in Arrow batches), or ``rewritten`` (the
    new text of a token as a column expression).
    """

    def apply_token(self, token: Token) -> Token:
        raise NotImplementedError

    def rewritten(self, text: Column) -> Column | None:
        return None

    def plan(self, s: State) -> Change:
        left = F.filter(s.tokens, lambda t: ~t["is_rejected"])
        if self.rewritten(F.lit("")) is not None:
            return Change(tokens=F.transform(left, lambda t: F.struct(self.rewritten(t["text"]).alias("text"), t["original"].alias("original"), t["is_rejected"].alias("is_rejected"))))
        each = self.apply_token

        @F.pandas_udf(TOKENS)
        def run(rows: pd.Series) -> pd.Series:
            out = []
            for tokens in rows:
                done = [each(Token(t["text"], t["is_rejected"], t["original"])) for t in (tokens if tokens is not None else ())]
                out.append([{"text": t.text, "original": t.original, "is_rejected": t.is_rejected} for t in done])
            return pd.Series(out, dtype=object)

        return Change(tokens=run(left))


class TokenAddTag(TokenFilter):
    """Append a literal to each token."""

    def __init__(self, tag: str = "<sep>", **kwargs: Any) -> None:
        super().__init__(**kwargs)
        self.tag = tag

    def rewritten(self, text: Column) -> Column:
        return F.concat(text, F.lit(self.tag))


def seo_pattern() -> str:
    """A ruled block with an address, or a starred line of dots and dashes."""
    marks = "#$%-"
    rule, wide = f"[{marks}]{{4,}}", f"[＿={marks}]{{4,}}"
    ruled = ",".join(["-{5,}", "@[0-9A-Za-z]+", rule, wide + " *.+? *" + wide])
    return f"{ruled}|★[…━]+★"


class SEOTokenRemover(TokenFilter):
    """Cut the first keyword block out of tokens whose words are longer on average than so many characters."""

    def __init__(self, min_average_seo_char_length: int = 5, **kwargs: Any) -> None:
        super().__init__(**kwargs)
        self.min_average_seo_char_length = min_average_seo_char_length

    def rewritten(self, text: Column) -> Column:
        trimmed = F.regexp_replace(text, f"^{WHITESPACE}|{WHITESPACE}$", "")
        average = F.length(text) / F.size(F.split(trimmed, "[ \\-・,]", -1))
        cut = F.regexp_replace(text, f"(?d)^([\\s\\S]*?)(?:{seo_pattern()})", "$1")  # anchored, so only once
        return F.when(average <= self.min_average_seo_char_length, text).otherwise(cut)
