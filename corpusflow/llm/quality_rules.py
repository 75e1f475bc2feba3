"""Quality rules: an isolation forest on rule statistics.

Each document gets the statistics of the usual heuristic rules (``RULES``).  A forest
of ``TREES`` trees, each over ``SUBSAMPLE`` rows, splits them at random: in a node a
rule and a value between the rule's smallest and largest one there.  The mean path
length h of a document over the trees gives its anomaly score 2 ** (-h / c(SUBSAMPLE)),
near 1 for documents that few splits isolate.  The threshold is calibrated on all
labelled rows: of all cuts between scores (in steps of 1/``BINS``) the one with the
best balance of rejected bad rows less rejected good rows, among those that reject at
most ``MAX_LOSS`` of the good ones.

The forest is fitted on at most about ``FIT_ROWS`` labelled good rows, chosen by a hash of
doc_id (it learns what normal documents look like; an anomaly is what they isolate
early), or without labels on as many of all rows.  Everything else covers all
documents: text is read once by the scoring pass, whose narrow result (doc_id,
statistics, score) is stored; calibration joins its scores with the labels.

* null or empty text, or text without words: score 1, always rejected
* null doc_id: scored like others, never labelled
* a doc_id that is labelled several times with different values: not used to calibrate
* repeated rows: each is scored (to the same score)
* no labels, or labels of one kind only: threshold ``DEFAULT_THRESHOLD``
* very long texts: as any other, their statistics are of the whole text
* ties: a score at exactly the threshold is rejected; of equally good thresholds the highest is taken
* extra columns: not in the result (``kept`` keeps all columns); empty tables: empty result
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import textkernel as tk
from corpusflow.llm._common import by_ids, picked, stored

TREES, SUBSAMPLE, FIT_ROWS, SEED = 128, 256, 20_000, 17
BINS, MAX_LOSS, DEFAULT_THRESHOLD = 1000, 0.005, 0.5
RULES = ("symbol_share", "mark_share", "capital_share", "top_word", "repeated_grams")
#: shares of short texts are drawn to 0 as if that many more characters, words or n-grams were inconspicuous
_DAMP_BYTES, _DAMP_WORDS = 80, 20

_SYMBOL = tk._table(b"#$%&*+<=>@[\\]^`{|}~/")
_MARK = tk._table(b"!?")
_SPACE = tk._table(b" \t\n\r\f\v")


def _per_row(table: np.ndarray, part: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(part) + 1, dtype=np.int64)
    np.cumsum(table[part], out=sums[1:])
    return sums[cuts[1:]] - sums[cuts[:-1]]


def statistics(raw: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of words and a row of RULES for each of the documents i..j; of a document without words all 0."""
    lo, cuts = int(offsets[i]), offsets[i : j + 1] - offsets[i]
    part = raw[lo : int(offsets[j])]
    w = tk.words(raw, offsets, i, j)
    bounds = w.bounds()
    n_words = np.diff(bounds)
    visible = np.diff(cuts) - _per_row(_SPACE, part, cuts) + _DAMP_BYTES
    capital, small = _per_row(tk.IS_UPPER, part, cuts), _per_row(tk.IS_LOWER, part, cuts)
    out = np.zeros((j - i, len(RULES)))
    out[:, 0] = _per_row(_SYMBOL, part, cuts) / visible
    out[:, 1] = _per_row(_MARK, part, cuts) / visible
    out[:, 2] = capital / (capital + small + _DAMP_BYTES)
    grams, at = tk.ngrams(w.hash, w.row, 3)
    gram_cuts = np.searchsorted(w.row[at], np.arange(j - i + 1))
    for r in range(j - i):
        own = w.hash[bounds[r] : bounds[r + 1]]
        if not len(own):
            continue
        out[r, 3] = np.unique(own, return_counts=True)[1].max() / (len(own) + _DAMP_WORDS)
        g = grams[gram_cuts[r] : gram_cuts[r + 1]]
        out[r, 4] = (len(g) - len(np.unique(g))) / (len(g) + _DAMP_WORDS)
    out[n_words == 0] = 0
    return n_words, out


def _c(n: float) -> float:
    """The mean path length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class Forest:
    """Trees in arrays: rule (-1: leaf), value, left child (the right one follows it), path length of leaves."""

    def __init__(self, rule, value, left, length, roots, scale):
        self.rule, self.value, self.left, self.length, self.roots, self.scale = rule, value, left, length, roots, scale

    @classmethod
    def fit(cls, rows: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> Forest:
        rng = np.random.default_rng(seed)
        size = min(subsample, len(rows))
        limit = int(np.ceil(np.log2(max(size, 2))))
        low, high = rows.min(axis=0), rows.max(axis=0)
        margin = (high - low) / 2 + 1e-9
        rule, value, left, length, roots = [], [], [], [], []

        def add() -> int:
            for column, x in ((rule, -1), (value, 0.0), (left, 0), (length, 0.0)):
                column.append(x)
            return len(rule) - 1

        for _ in range(trees):
            roots.append(add())
            # the box in which values are drawn is wider than the rows, so what lies outside is isolated, too
            todo = [(roots[-1], rows[rng.choice(len(rows), size, replace=False)], 0, low - margin, high + margin)]
            while todo:
                at, sub, depth, lo, hi = todo.pop()
                if depth >= limit or len(sub) <= 1:
                    length[at] = depth + _c(len(sub))
                    continue
                q = int(rng.integers(rows.shape[1]))
                v = float(rng.uniform(max(lo[q], sub[:, q].min() - margin[q]), min(hi[q], sub[:, q].max() + margin[q])))
                rule[at], value[at], left[at] = q, v, add()
                right, below = add(), sub[:, q] < v
                hi2, lo2 = hi.copy(), lo.copy()
                hi2[q] = lo2[q] = v
                todo.append((left[at], sub[below], depth + 1, lo, hi2))
                todo.append((right, sub[~below], depth + 1, lo2, hi))
        return cls(np.array(rule), np.array(value), np.array(left), np.array(length), np.array(roots), _c(size) or 1.0)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not len(rows):
            return np.zeros(0)
        at = np.broadcast_to(self.roots, (len(rows), len(self.roots))).copy()
        line = np.arange(len(rows))[:, None]
        while True:
            q = self.rule[at]
            inner = q >= 0
            if not inner.any():
                break
            go = self.left[at] + (rows[line, np.maximum(q, 0)] >= self.value[at])
            at = np.where(inner, go, at)
        return 2.0 ** (-self.length[at].mean(axis=1) / self.scale)


_FIELDS = "doc_id bigint, n_words bigint, " + ", ".join(f"{r} double" for r in RULES)


def _stat_rows(batches: Iterator[pa.RecordBatch], forest: Forest | None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, offsets = tk.string_buffer(b.column(1))
        for i, j in tk.blocks(offsets):
            n_words, stats = statistics(raw, offsets, i, j)
            score = np.where(n_words == 0, 1.0, forest.score(stats)) if forest else np.zeros(len(stats))
            arrays = [b.column(0).slice(i, j - i), pa.array(n_words.astype(np.int64)), *[pa.array(stats[:, k].copy()) for k in range(len(RULES))], pa.array(score)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", *RULES, "score"])


def rule_statistics(docs: DataFrame) -> DataFrame:
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    return source.mapInArrow(lambda it: _stat_rows(it, None), _FIELDS + ", score double").drop("score")


def _label(labels: DataFrame) -> DataFrame:
    out = picked(labels, "doc_id", "quality").filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    return out.filter("quality = other").select("doc_id", "quality")


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Forest | None:
    """A forest on about fit_rows labelled good documents, or on as many of all documents if none is labelled good; None if no document has words."""
    docs = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    good = _label(labels).filter("quality = 1").select("doc_id")
    for chosen in (good, docs.select("doc_id").filter("doc_id is not null").distinct()):
        n = chosen.count()
        share = int(min(1.0, fit_rows / max(n, 1)) * 1_000_000)
        # the ids first, about fit_rows of them, so that only these texts are looked at
        sample = by_ids(docs, chosen.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share), "left_semi")
        rows = rule_statistics(sample).filter("n_words > 0").select("doc_id", *RULES).toPandas()
        if len(rows):
            rows = rows.sort_values(["doc_id", *RULES])[list(RULES)].to_numpy(dtype=float)
            return Forest.fit(rows)
    return None


def calibrate(scored: DataFrame, labels: DataFrame, max_loss: float = MAX_LOSS) -> float:
    """The threshold: documents whose score is at least that are rejected."""
    bins = scored.filter("n_words > 0").select("doc_id", F.floor(F.col("score") * BINS).cast("int").alias("bin"))
    rows = bins.join(_label(labels), "doc_id").groupBy("bin").agg(F.sum((F.col("quality") > 0).cast("int")).alias("good"), F.sum((F.col("quality") <= 0).cast("int")).alias("bad")).collect()  # at most BINS + 1 rows
    good, bad = np.zeros(BINS + 2), np.zeros(BINS + 2)
    for r in rows:
        good[r["bin"]], bad[r["bin"]] = r["good"], r["bad"]
    if not good.sum() or not bad.sum():
        return DEFAULT_THRESHOLD
    lost, caught = good[::-1].cumsum()[::-1] / good.sum(), bad[::-1].cumsum()[::-1] / bad.sum()
    value = np.where(lost <= max_loss, caught - lost, -1.0)
    return int(np.flatnonzero(value == value.max())[-1]) / BINS


def _scored(docs: DataFrame, forest: Forest | None) -> DataFrame:
    source = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return source.mapInArrow(lambda it: _stat_rows(it, forest or _blank_forest()), _FIELDS + ", score double")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, the statistics, score, threshold and keep, a row for each document."""
    scored = stored(_scored(docs, fit(docs, labels)), "quality")
    threshold = calibrate(scored, labels)
    return scored.withColumn("threshold", F.lit(threshold)).withColumn("keep", (F.col("n_words") > 0) & (F.col("score") < F.col("threshold")))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns.

    The forest is fitted and the threshold calibrated as in ``score``, from the labelled
    documents alone; the verdict is then computed in the scan that copies the documents.
    """
    forest = fit(docs, labels)
    labelled = by_ids(picked(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), _label(labels), "left_semi")
    threshold = calibrate(_scored(labelled, forest), labels)
    rows = forest or _blank_forest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = tk.string_buffer(b.column("text"))
            keep = np.zeros(b.num_rows, dtype=bool)
            for i, j in tk.blocks(offsets):
                n_words, stats = statistics(raw, offsets, i, j)
                keep[i:j] = (n_words > 0) & (rows.score(stats) < threshold)
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def _blank_forest() -> Forest:
    return Forest(np.array([-1]), np.array([0.0]), np.array([0]), np.array([1.0]), np.array([0]), 1.0)
