"""Near-duplicate detection by MinHash bands: keys beside each document, then first-seen wins.

A document is rejected if any of its keys was introduced by an earlier one (smaller
doc_id), rejected or not.  As a set: reject where the smallest doc_id of some key is
smaller than the document's own.  Only keys and ids are shuffled; the smallest id of
a key is a partial aggregation, so a key that very many documents share is no
hot spot of the aggregation, and AQE splits it in the join.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import json_quoted_native
from corpusflow.plans.stage import Change, GlobalStage, Stage, State
from corpusflow.schema import EXTRAS
from corpusflow.sources.storage import exists, removed, written

KEY = "dedup_lsh"
PRIME = (1 << 31) - 1


def char_level_splitter(text: str) -> list[str]:
    return list(text)


def non_alpha_num_splitter(text: str) -> list[str]:
    import re

    return re.findall("[A-Za-z_0-9]+", text)


class japanese_word_splitter:  # noqa: N801
    """Surfaces of a morphological tagger, which is loaded once in each worker."""

    def __init__(self, tagger: Callable[[str], list[tuple[str, str]]] | None = None) -> None:
        from corpusflow.functions.taggers import Tagger

        self._tagger = tagger or Tagger()

    def __call__(self, text: str) -> list[str]:
        return [w for w, _ in self._tagger(text)]


@lru_cache
def band_parameters(threshold: float, num_perm: int) -> tuple[int, int]:
    """(bands, rows of a band) for which false positives below and false negatives above the threshold have the smallest sum."""
    s = (np.arange(4000) + 0.5) / 4000
    below = s < threshold
    best, least = (1, 1), np.inf
    for bands in range(1, num_perm + 1):
        for rows in range(1, num_perm // bands + 1):
            miss = (1 - s**rows) ** bands
            cost = np.where(below, 1 - miss, miss).sum()
            if cost < least:
                best, least = (bands, rows), cost
    return best


def permutations(num_perm: int, seed: int) -> tuple[list[int], list[int]]:
    """Multipliers and offsets below PRIME, from a generator that any language can repeat."""
    out = [int.from_bytes(hashlib.md5(f"{seed}:{k}".encode()).digest()[:4], "big") % (PRIME - 1) + 1 for k in range(2 * num_perm)]
    return out[:num_perm], out[num_perm:]


@lru_cache
def _permutation_arrays(num_perm: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = permutations(num_perm, seed)
    return np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)


#: so many characters of documents are worked on at once, or a quarter as many tokens
CHUNK = 1 << 21
#: bytes of the values kept of a block of permutations, n-grams of a document looked up at once, n-grams permuted at once
_TABLE, _ROWS, _FEW = 1 << 26, 1 << 10, 1 << 8


def _grams(tokens: list[Sequence[str]], n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(hashes of the distinct n-grams of a list of token sequences, for each sequence the places of its own among them).

    An n-gram that many documents have is hashed once.  Its hash is of the bytes that its tokens, joined by spaces, are in UTF-8.
    """
    lengths = np.array([len(t) for t in tokens])
    first = np.cumsum(lengths) - lengths
    none = [np.zeros(0, dtype=np.int64)] * len(tokens)
    if not (lengths >= n).any():
        return np.zeros(0, dtype=np.uint64), none
    if all(isinstance(t, str) for t in tokens):
        flat = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        one = pd.factorize(flat)[0].astype(np.int64)
    else:
        flat = [w for t in tokens for w in t]
        one = pd.factorize(np.fromiter(flat, dtype=object, count=len(flat)))[0].astype(np.int64)
    # n-grams as numbers: of equal ones only; those that begin before n tokens of a document's end
    width = int(one.max()) + 1
    code, high = one[: len(one) - n + 1], width
    for k in range(1, n):
        if high > (1 << 62) // width:
            code, found = pd.factorize(code)
            code, high = code.astype(np.int64), len(found)
        code = code * width + one[k : len(one) - n + 1 + k]
        high *= width
    whole = np.ones(len(code), dtype=bool)
    for k in range(1, n):
        ends = first[1:] - k
        whole[ends[(ends >= 0) & (ends < len(code))]] = False
    places = np.flatnonzero(whole)
    code = pd.factorize(code[places])[0]
    new = places[np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1))]
    if isinstance(flat, np.ndarray):
        joined = np.full(len(flat) * 2, ord(" "), dtype=np.uint32)
        joined[::2] = flat
        octets = 1 + (flat > 0x7F).astype(np.int64) + (flat > 0x7FF) + (flat > 0xFFFF)
        data = joined.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    else:
        words = [w.encode("utf-8", "surrogatepass") for w in flat]
        octets, data = np.fromiter(map(len, words), dtype=np.int64, count=len(words)), b" ".join(words)
    starts = np.cumsum(octets + 1) - octets - 1
    ends = starts + octets
    digests = b"".join([hashlib.md5(data[x:y]).digest() for x, y in zip(starts[new].tolist(), ends[new + n - 1].tolist())])
    cuts = np.searchsorted(places, np.append(first, len(one)))
    return np.frombuffer(digests, dtype=">u4")[::4].astype(np.uint64), [pd.unique(code[x:y]) for x, y in zip(cuts, cuts[1:])]


def signatures(hashes: np.ndarray, places: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The signature of each document.  A permutation's values are computed once for each n-gram of the chunk."""
    out = np.full((len(places), len(a)), PRIME, dtype=np.uint32)
    some = [k for k, p in enumerate(places) if len(p)]
    wide = max(1, min(len(a), _TABLE // (4 * max(1, len(hashes)))))
    for k in range(0, len(a), wide):
        table = np.empty((len(hashes), len(a[k : k + wide])), dtype=np.uint32)
        for x in range(0, len(hashes), _FEW):
            table[x : x + _FEW] = permuted(hashes[x : x + _FEW], a[k : k + wide], b[k : k + wide])
        for d in some:
            least = out[d, k : k + wide]
            for x in range(0, len(places[d]), _ROWS):
                np.minimum(least, table.take(places[d][x : x + _ROWS], axis=0).min(axis=0), out=least)
    return out


def permuted(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(a * hash + b) % PRIME, a row for each hash.  PRIME is 2**31 - 1, so the remainder is taken by shifts."""
    low, bits = np.uint64(PRIME), np.uint64(31)
    values = hashes[:, None] * a
    values += b
    for _ in range(2):
        high = values >> bits
        values &= low
        values += high
    np.minimum(values, values - low, out=values)  # below PRIME the difference wraps around
    return values


def band_keys(sig: np.ndarray, bands: int, rows: int) -> list[str]:
    return [f"{k}+{hashlib.md5(','.join(map(str, sig[k * rows : (k + 1) * rows].tolist())).encode()).hexdigest()}" for k in range(bands)]


class GenerateDedupLSH(Stage):
    """Put the document's band keys (``band+32 hex digits``) into extras["dedup_lsh"]."""

    def __init__(self, num_perm: int = 500, threshold: float = 0.8, tokenizer: Callable[[str], Iterable[str]] = char_level_splitter, n_grams: int = 5, seed: int = 42, **kwargs: Any) -> None:
        super().__init__(**kwargs)
        self.num_perm = num_perm
        self.threshold = threshold
        self._tokenizer = tokenizer
        self.n_grams = n_grams
        self.seed = seed
        self.num_bands, self.band_size = band_parameters(threshold, num_perm)

    def keys(self, text: str) -> list[str]:
        return next(self.keys_of([text]))

    def keys_of(self, texts: Iterable[str]) -> Iterator[list[str]]:
        """The keys of each text; texts of up to CHUNK in all are worked on together."""
        used = self.num_bands * self.band_size  # the last permutations are in no band
        a, b = (x[:used] for x in _permutation_arrays(self.num_perm, self.seed))

        def done() -> Iterator[list[str]]:
            for sig in signatures(*_grams(held, self.n_grams), a, b):
                yield band_keys(sig, self.num_bands, self.band_size)

        held: list[Sequence[str]] = []
        n = 0
        for text in texts:
            tokens = text if self._tokenizer is char_level_splitter else list(self._tokenizer(text))
            size = len(tokens) * (1 if isinstance(tokens, str) else 4)
            if held and n + size > CHUNK:
                yield from done()
                held, n = [], 0
            held.append(tokens)
            n += size
        if held:
            yield from done()

    def plan(self, s: State) -> Change:
        keys_of = self.keys_of

        @F.pandas_udf("string")
        def run(texts: pd.Series) -> pd.Series:
            found = keys_of(x for x in texts if x is not None)
            return pd.Series([None if x is None else json.dumps(next(found)) for x in texts], dtype=object)

        return Change(new_extras=F.create_map(F.lit(KEY), run(s.wanted)).cast(EXTRAS))


def exploded(docs: DataFrame) -> DataFrame:
    """doc_id, pos and key; a document without keys fails the job."""
    keys = F.from_json(F.col("extras")[KEY], "array<string>")
    keys = F.when(keys.isNull(), F.raise_error(F.lit(f"no {KEY} in extras: apply GenerateDedupLSH first")).cast("array<string>")).otherwise(keys)
    return docs.select("doc_id", F.posexplode(keys).alias("pos", "key"))


def packed(keys: DataFrame) -> DataFrame:
    """keys with the key in half the bytes: ``band+32 hex digits`` as the band and 16 bytes, others as they are behind another first byte."""
    key = F.col("key")
    short = F.concat(F.encode(F.concat(F.lit("\0"), F.substring_index(key, "+", 1)), "utf-8"), F.unhex(F.substring_index(key, "+", -1)))
    return keys.withColumn("key", F.when(key.rlike("^[0-9]{1,9}[+][0-9a-f]{32}\\z"), short).otherwise(F.encode(F.concat(F.lit("\1"), key), "utf-8")))


def collisions(keys: DataFrame) -> DataFrame:
    """doc_id and owner: who introduced the last (in key order) of its keys that an earlier document has."""
    first = keys.groupBy("key").agg(F.min("doc_id").alias("first"))
    return keys.join(first, "key").filter(F.col("first") < F.col("doc_id")).groupBy("doc_id").agg(F.max_by("first", "pos").alias("owner"))


def found_once(docs: DataFrame) -> DataFrame:
    """collisions of docs, stored; the keys go."""
    keys = written(packed(exploded(docs)), "keys")
    found = written(collisions(keys), "collisions")
    removed(keys)
    return found


class InlineDeduplicator(GlobalStage):
    """Reject documents that share a key with an earlier one."""

    def verdicts(self, docs: DataFrame) -> DataFrame:
        return found_once(docs).select("doc_id", F.lit(True).alias("reject"))


class InlineDuplicateAnalyzer(GlobalStage):
    """Like InlineDeduplicator, and extras["similar_doc"] has the text of the earlier document (as this stage finds it)."""

    def verdicts(self, docs: DataFrame) -> DataFrame:
        found = found_once(docs)
        owners = docs.select(F.col("doc_id").alias("owner"), F.col("text").alias("owner_text"))
        similar = F.create_map(F.lit("similar_doc"), json_quoted_native(F.col("owner_text"))).cast(EXTRAS)
        return found.join(owners, "owner").select("doc_id", F.lit(True).alias("reject"), similar.alias("new_extras"))


class KeyTableDeduplicator(GlobalStage):
    """Reject documents that share a key with an earlier one of this or any earlier run.

    path: a folder of keys in shared storage, to which each run adds a part of its own
    (named by batch, so that a repeated batch replaces its part and does not see it).
    The verdicts are stored before the new keys are added.
    """

    def __init__(self, path: str, key_prefix: str = "dedup", *, batch: str | None = None, **kwargs: Any) -> None:
        super().__init__(**kwargs)
        self.key_prefix = key_prefix
        self._path = f"{path.rstrip('/')}/{key_prefix}"
        self._batch = batch

    def _stored_form(self, keys: DataFrame) -> DataFrame:
        return keys

    def verdicts(self, docs: DataFrame) -> DataFrame:
        spark, batch = docs.sparkSession, self._batch or uuid.uuid4().hex
        keys = written(self._stored_form(exploded(docs)), "keys")
        hits = collisions(keys).select("doc_id")
        known = None
        if exists(spark, self._path):
            known = spark.read.schema(keys.select("key").schema.add("batch", "string")).parquet(self._path).filter(F.col("batch") != batch).select("key").distinct()
            hits = hits.union(keys.join(known, "key", "left_semi").select("doc_id"))
        out = written(hits.distinct().withColumn("reject", F.lit(True)), "verdicts")
        new = keys.select("key").distinct()
        if known is not None:
            new = written(new.join(known, "key", "left_anti"), "new_keys")
        new.write.mode("overwrite").parquet(f"{self._path}/batch={batch}")
        removed(keys, *([new] if known is not None else []))
        return out


class BloomDeduplicator(KeyTableDeduplicator):
    """KeyTableDeduplicator on 64-bit hashes of the keys: an eighth of the space, no false negatives, and false positives below error_rate as long as no more than expected_docs come."""

    def __init__(self, path: str, expected_docs: int, key_prefix: str = "bloomdedup", error_rate: float = 1e-7, num_bands: int | None = None, **kwargs: Any) -> None:
        super().__init__(path, key_prefix, **kwargs)
        self.expected_docs = expected_docs
        self.error_rate = error_rate
        self.num_bands = num_bands
        if expected_docs * (num_bands or 32) / 2**64 > error_rate:
            raise ValueError("64-bit hashes don't reach this error rate for so many documents")

    def _stored_form(self, keys: DataFrame) -> DataFrame:
        return keys.withColumn("key", F.xxhash64("key"))
