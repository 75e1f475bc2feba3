"""All stages by name."""

from corpusflow.operators.asynchronous import AsyncChatAPI, AsyncFilter
from corpusflow.operators.dedup import BloomDeduplicator, GenerateDedupLSH, InlineDeduplicator, InlineDuplicateAnalyzer, KeyTableDeduplicator
from corpusflow.operators.json_io import JSONDumper, JSONLoader
from corpusflow.operators.language import AcceptJapaneseByFastText, LanguageIdentificationByFastText
from corpusflow.operators.predicates import (
    AcceptJapanese,
    CharRepetitionRatioFilter,
    DiscardAds,
    DiscardAdultContentEn,
    DiscardAdultContentJa,
    DiscardAll,
    DiscardBBSComments,
    DiscardContainingKeyword,
    DiscardDiscriminationContentJa,
    DiscardRareKuten,
    DiscardTooManyEndingEllipsis,
    DiscardTooManyNouns,
    DiscardTooManySpecialToken,
    DiscardTooShortLines,
    DiscardViolenceContentJa,
    DocumentLengthFilter,
    NgWordsFilterEn,
    NgWordsFilterJa,
    SingleCharacterRepetitionFilter,
    WordRepetitionRatioFilter,
)
from corpusflow.operators.text import AppendTag, ApplyDiscard, DocumentNormalizer, Identity, MaskPersonalInformation, Sleep
from corpusflow.operators.tokens import BlankCharTokenizer, HeaderFooterTagsRemover, MergeTokens, SentenceTokenizer, SEOTokenRemover, TokenAddTag, TokenFilter
from corpusflow.plans.pipeline import Pipeline
from corpusflow.plans.stage import Filter, GlobalStage, Stage

__all__ = [name for name in dir() if name[0].isupper()]
