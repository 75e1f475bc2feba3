"""Column functions on text that Spark has no single expression for."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: what str.split() without arguments splits at
WHITESPACE = "[\\t-\\r\\x1c-\\x20\\x85\\p{Z}]+"


def pattern_count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(text: Column) -> Column:
    """NFKC; ASCII is invariant and never leaves the JVM."""
    other = F.octet_length(text) != F.length(text)
    return F.coalesce(_nfkc(F.when(other, text)), text)


@F.pandas_udf(StringType())
def _json_quoted(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else json.dumps(x, ensure_ascii=False))


def json_quoted(text: Column) -> Column:
    """text as a JSON string, spelled as Python's json does."""
    plain = F.to_json(F.array(text))
    native = F.substring(plain, F.lit(2), F.length(plain) - 2)
    # control characters without a short escape: lower-case hex digits; DEL and others are left as they are
    return F.coalesce(_json_quoted(F.when(text.rlike("[\\x00-\\x07\\x0b\\x0e-\\x1f\\x7f]"), text)), native)


def json_object(pairs: list[tuple[str, Column]]) -> Column:
    """``{"name": value, ...}`` of columns that are JSON text already."""
    parts: list[Column] = []
    for k, (name, value) in enumerate(pairs):
        parts += [F.lit((", " if k else "{") + json.dumps(name, ensure_ascii=False) + ": "), value]
    return F.concat(*parts, F.lit("}"))


def json_map(m: Column) -> Column:
    """A map of JSON text as one JSON object, in the map's order."""
    entries = F.transform(F.map_entries(m), lambda e: F.concat(json_quoted_native(e["key"]), F.lit(": "), F.coalesce(e["value"], F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))


def json_quoted_native(text: Column) -> Column:
    plain = F.to_json(F.array(text))
    return F.substring(plain, F.lit(2), F.length(plain) - 2)


def merged(a: Column, b: Column) -> Column:
    """Maps as dict.update does it: a's order, then b's new keys; b's values win."""
    new = F.map_filter(b, lambda k, v: ~F.array_contains(F.map_keys(a), k))
    old = F.transform_values(a, lambda k, v: F.when(F.array_contains(F.map_keys(b), k), F.element_at(b, k)).otherwise(v))
    return F.map_concat(old, new)


def escaped(word: str) -> str:
    """A literal for regular expressions that Java and RE2 both read."""
    return re.sub(r"([^\w\s])", r"\\\1", word, flags=re.ASCII) if word.isascii() else "".join("\\" + c if c.isascii() and not (c.isalnum() or c in "_ ") else c for c in word)


def trie_pattern(words: Iterable[str]) -> str:
    """A regular expression that matches where any word occurs, with shared prefixes factored out.

    For yes-or-no questions only: which of several words it matches is not defined.
    """
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            if "" in node:
                break  # a shorter word is found wherever this one is
            node = node.setdefault(c, {})
        else:
            node.clear()
            node[""] = {}

    def build(node: dict) -> str:
        if "" in node:
            return ""
        parts = [escaped(c) + build(child) for c, child in sorted(node.items())]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return build(root)
