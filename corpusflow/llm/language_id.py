"""Language identification by error-correcting output codes.

Each language has a codeword of bits.  For each bit a binary classifier (regularised
least squares on hashed character n-grams of 1 to 3 folded letters) predicts it.  Decoding is loss-weighted: a language's
distance is the sum over the bits of exp(-bit * margin), each bit weighted by how
often its classifier is right on the training rows of that language; the nearest
codeword wins, and a document is ambiguous if the second nearest is less than
``AMBIGUOUS`` of its own distance farther away, or if it has fewer than ``MIN_LETTERS``
letters.

Codewords: up to 5 languages the exhaustive code (2^(k-1) - 1 bits), else the best
of ``CODE_TRIES`` random codes of 10 log2 k bits by smallest Hamming distance of two
codewords.  Everything is seeded and deterministic.

Training rows: about ``ROWS_PER_LANGUAGE`` documents of each language, chosen by a hash of
doc_id, with their whole texts; the fit takes their n-gram counts only.  A model has at
most ``MAX_LANGUAGES`` languages, the commonest ones (a column of dirty names does not
grow the driver's work); documents of others are scored like all.  Scoring is
one narrow pass over all documents without a shuffle; a text of any length is
scored whole, n-grams across its segments included, and a row's result depends on
nothing but its text.

* null or empty text, or text without letters: language ``und``, ambiguous, null distance and margin
* null or empty lang: not used for training; one language: always it; none: ``und``
* empty table: empty result
* null doc_id: scored like others; repeated rows: each has its own result
* ties: the language whose name comes first; extra columns: not in the result
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import textkernel as tk
from corpusflow.llm._common import picked

ROWS_PER_LANGUAGE, DIMENSIONS, RIDGE, SEED = 300, 1 << 12, 0.05, 29
AMBIGUOUS, MIN_LETTERS, CODE_TRIES, MAX_LANGUAGES = 0.1, 8, 64, 256
_BLOCK_DOCS = 256


def codewords(k: int, seed: int = SEED) -> np.ndarray:
    """k rows of -1 and 1; no column is constant or repeated (or the complement of another)."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 5:
        bits = np.arange(1, 1 << (k - 1))
        return np.concatenate([np.ones((1, len(bits))), np.where((bits[None, :] >> np.arange(k - 1)[:, None]) & 1, -1.0, 1.0)])
    rng, best, most = np.random.default_rng(seed), None, -1
    n = int(np.ceil(10 * np.log2(k)))
    for _ in range(CODE_TRIES):
        code = np.where(rng.random((k, 4 * n)) < 0.5, -1.0, 1.0)
        code *= code[:1]
        code = np.unique(code[:, np.abs(code.sum(axis=0)) < k], axis=1)
        code = code[:, rng.permutation(code.shape[1])[:n]]
        distance = (code.shape[1] - code @ code.T) / 2 + np.eye(k) * n
        if distance.min() > most:
            best, most = code, distance.min()
    return best


def features(raw: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """(letters, counts of hashed n-grams) of rows i..j.  Runs of other bytes count as one space."""
    counts = np.zeros(((j - i) * DIMENSIONS), dtype=np.int32)
    letters = np.zeros(j - i, dtype=np.int64)
    at, hi = int(offsets[i]), int(offsets[j])
    carry, open_word = np.zeros(0, dtype=np.uint32), False  # of the segment before, if a row is cut
    while at < hi:
        stop = tk._segment_end(raw, at, hi)
        part = raw[at:stop]
        fold, mask, _ = tk._word_mask(part)
        mask &= ~tk.IS_DIGIT[part] & (part != 0x5F)
        row = np.searchsorted(offsets[i : j + 1], np.arange(at, stop), side="right") - 1 if j - i > 1 else np.zeros(stop - at, dtype=np.int64)
        letters += np.bincount(row[mask], minlength=j - i)
        keep = mask.copy()
        keep[1:] |= mask[:-1] & (row[1:] == row[:-1])  # of a run of others the first
        keep[0] |= open_word
        c = np.concatenate([carry, np.where(mask, fold, 32)[keep].astype(np.uint32)])
        r = np.concatenate([np.zeros(len(carry), dtype=np.int64), row[keep]])
        for n in (1, 2, 3):
            first = max(0, len(carry) - n + 1)  # those within the carry have been counted
            m = len(c) - n + 1
            if m <= first:
                continue
            g = np.zeros(m - first, dtype=np.uint32)
            for k in range(n):
                g = (g << np.uint32(8)) | c[first + k : m + k]
            same = r[first:m] == r[first + n - 1 :]
            h = (g * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(20)
            counts += np.bincount((r[first:m] * DIMENSIONS + h)[same], minlength=len(counts)).astype(np.int32)
        carry, open_word, at = c[-2:], bool(mask[-1]), stop
    return letters, counts.reshape(j - i, DIMENSIONS)


def _normal(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts.astype(np.float32))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # dimensions x bits
    bias: np.ndarray  # bits
    trust: np.ndarray  # languages x bits, rows sum to 1

    @classmethod
    def fit(cls, counts: np.ndarray, names: list[str]) -> Model:
        languages = sorted(set(names))
        code = codewords(len(languages))
        which = np.searchsorted(languages, names)
        x, y = _normal(counts), code[which]
        centre, bias = x.mean(axis=0), y.mean(axis=0)
        gram = (x - centre) @ (x - centre).T
        weights = (x - centre).T @ np.linalg.solve(gram + RIDGE * np.eye(len(x), dtype=np.float32), y - bias)
        bias = bias - centre @ weights
        right = np.sign(x @ weights + bias) == y
        trust = np.stack([right[which == k].mean(axis=0) for k in range(len(languages))]) + 1e-3
        return cls(languages, code, weights.astype(np.float32), bias.astype(np.float32), trust / trust.sum(axis=1, keepdims=True))

    def distances(self, counts: np.ndarray) -> np.ndarray:
        f = _normal(counts) @ self.weights + self.bias
        return (self.trust[None] * np.exp(-self.code[None] * f[:, None, :])).sum(axis=2)


_SCHEMA = "doc_id bigint, lang string, letters bigint, language string, distance double, margin double, ambiguous boolean"


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model | None:
    known = picked(docs, "doc_id", "lang", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").alias("lang"), F.col("text").alias("text")).filter("doc_id is not null and lang <> ''")
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    if not sizes:
        return None
    million = 1_000_000
    share = F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(million, -(-rows_per_language * million // r["count"])))]), F.col("lang"))
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(million)) < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = tk.string_buffer(b.column(2))
            for i, j in tk.blocks(offsets, block_docs=_BLOCK_DOCS):
                letters, counts = features(raw, offsets, i, j)
                at = np.flatnonzero(letters)
                sparse = [np.flatnonzero(counts[k]) for k in at]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i).take(pa.array(at)), b.column(1).slice(i, j - i).take(pa.array(at)), pa.array([s.astype(np.int16) for s in sparse], pa.list_(pa.int16())), pa.array([counts[k][s] for k, s in zip(at, sparse)], pa.list_(pa.int32()))],
                    names=["doc_id", "lang", "which", "n"],
                )

    rows = sample.mapInArrow(run, "doc_id bigint, lang string, which array<smallint>, n array<int>").toArrow()
    if not rows.num_rows:
        return None
    rows = rows.take(pa.array(np.lexsort((rows.column("lang").to_numpy(), rows.column("doc_id").to_numpy()))))
    counts = np.zeros((rows.num_rows, DIMENSIONS), dtype=np.int32)
    for k, (which, n) in enumerate(zip(rows.column("which"), rows.column("n"))):
        counts[k, which.values.to_numpy()] = n.values.to_numpy()
    return Model.fit(counts, rows.column("lang").to_pylist())


def identify(docs: DataFrame, model: Model | None = None, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """doc_id, lang (as declared), letters, language, distance, margin (by how much of its distance the second is farther) and ambiguous."""
    model = model or train(docs, rows_per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = tk.string_buffer(b.column(2))
            for i, j in tk.blocks(offsets, block_docs=_BLOCK_DOCS):
                letters, counts = features(raw, offsets, i, j)
                blank = letters == 0
                if model is None:
                    name, first, margin = np.full(j - i, "und", dtype=object), np.full(j - i, np.nan), np.full(j - i, np.nan)
                    blank[:] = True
                else:
                    d = model.distances(counts)
                    order = np.argsort(d, axis=1, kind="stable")
                    line = np.arange(j - i)
                    first = d[line, order[:, 0]].astype(float)
                    second = d[line, order[:, 1]] if d.shape[1] > 1 else np.full(j - i, np.inf)
                    margin = (second - first) / second if d.shape[1] > 1 else np.ones(j - i)
                    name = np.where(blank, "und", np.array(model.languages, dtype=object)[order[:, 0]])
                unclear = blank | (letters < MIN_LETTERS) | ~(margin >= AMBIGUOUS)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(letters), pa.array(name, pa.string()), pa.array(first, pa.float64(), mask=blank), pa.array(margin, pa.float64(), mask=blank), pa.array(unclear)],
                    names=["doc_id", "lang", "letters", "language", "distance", "margin", "ambiguous"],
                )

    return picked(docs, "doc_id", "lang", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").alias("lang"), F.col("text").alias("text")).mapInArrow(run, _SCHEMA)
