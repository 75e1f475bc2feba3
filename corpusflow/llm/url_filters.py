"""Weighted URL vocabulary: Aho-Corasick counts of strict and soft terms.

One pass of an automaton over each lower-cased, percent-decoded URL finds every
occurrence of every term, overlapping ones too.  A term counts only where both
neighbours are not ASCII letters or digits (or the URL ends), so ``casino`` is
not found in ``casinova``.  A URL is rejected if it has a strict term, or soft
terms that are at least ``min_soft`` distinct ones and weigh ``min_weight``
together (each distinct term once).

Only the key and the URL are read; the automaton is built once per Python worker
from the vocabulary, which is a parameter of fixed size.

* null or empty URL: no hits, not rejected
* bytes that are not UTF-8 after percent-decoding become U+FFFD
* very long URL: searched whole; empty table: empty result; ties: weights and counts are equal or above the limits to reject
* repeated rows: each has its own result; extra columns: not in the result
* a term that is strict and soft, empty, or repeated: ValueError
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm._common import picked

STRICT = ("spam-farm", "cheap-pills", "xxx", "porn", "malware", "phishing", "warez", "torrent-leaks", "escort")
SOFT = (
    ("casino", 1.0), ("poker", 1.0), ("bet", 0.6), ("pills", 0.8), ("cheap", 0.5), ("free", 0.3), ("win", 0.4), ("prize", 0.7), ("loan", 0.7), ("spam", 0.9), ("ref", 0.2), ("feed", 0.2),
    ("farm", 0.3), ("adult", 0.8), ("crack", 0.6), ("keygen", 0.9), ("lottery", 0.9), ("page", 0.1), ("blog", 0.1), ("utm_source", 0.2),
)
MIN_SOFT, MIN_WEIGHT = 3, 0.5

_SCHEMA = "strict_hits int, soft_hits int, soft_distinct int, soft_weight double, terms array<string>"


def _is_word(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


@lru_cache(maxsize=8)
def _automaton(terms: tuple[str, ...]):
    import ahocorasick

    auto = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        auto.add_word(term, k)
    auto.make_automaton()
    return auto


def normalise(url: str) -> str:
    return unquote(url, errors="replace").lower()


def term_hits(url: str, terms: tuple[str, ...]) -> dict[int, int]:
    """Occurrences with boundaries on both sides, by index of the term."""
    hits: dict[int, int] = {}
    last = len(url) - 1
    for end, k in _automaton(terms).iter(url):
        first = end - len(terms[k]) + 1
        if (first == 0 or not _is_word(url[first - 1])) and (end == last or not _is_word(url[end + 1])):
            hits[k] = hits.get(k, 0) + 1
    return hits


def filter_urls(
    pages: DataFrame, key: str = "page_id", url: str = "url", strict: Sequence[str] = STRICT, soft: Sequence[tuple[str, float]] = SOFT, min_soft: int = MIN_SOFT, min_weight: float = MIN_WEIGHT
) -> DataFrame:
    """key, url, strict_hits, soft_hits, soft_distinct, soft_weight, terms (the distinct hits, sorted) and rejected, a row for each page."""
    terms = tuple(t.lower() for t in strict) + tuple(t.lower() for t, _ in soft)
    if len(set(terms)) < len(terms) or "" in terms:
        raise ValueError("terms must be distinct and not empty")
    n_strict, weights = len(strict), [0.0] * len(strict) + [float(w) for _, w in soft]

    @F.pandas_udf(_SCHEMA)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for u in batch:
                hits = term_hits(normalise(u), terms) if u and terms else {}
                soft_found = sorted(k for k in hits if k >= n_strict)
                rows.append((sum(c for k, c in hits.items() if k < n_strict), sum(hits[k] for k in soft_found), len(soft_found), round(sum(weights[k] for k in soft_found), 6), sorted(terms[k] for k in hits)))
            yield pd.DataFrame(rows, columns=["strict_hits", "soft_hits", "soft_distinct", "soft_weight", "terms"])

    out = picked(pages, key, url).select(F.col(f"`{key}`").alias(key), F.col(f"`{url}`").alias("url")).withColumn("_s", scan("url")).select(key, "url", "_s.*")
    return out.withColumn("rejected", (F.col("strict_hits") > 0) | ((F.col("soft_distinct") >= min_soft) & (F.col("soft_weight") >= min_weight)))
