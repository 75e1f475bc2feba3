"""Benchmark decontamination by template canonicalisation.

Words become templates: a word with a digit is ``<NUM>``, a capitalised word that
does not begin a sentence is ``<NAME>`` (words all in capitals stay literal), a unit of
measure after a number is ``<UNIT>``; all others are themselves, folded.  Windows of
``WINDOW`` templates of the documents are joined by hash with those of the benchmark,
so a question asked again with other numbers, names or units still joins.

The windows of the folded words themselves are joined too, so a verbatim copy is found
where templates can't tell (few literal words) or differ (other capitals).

Joined windows of a document and an item are put on diagonals (position in the
document less position in the item), so each diagonal is one alignment.  Slot
consistency: within an alignment each value of a slot in the item must always have
become the same value in the document (``7 ... 7`` may become ``12 ... 12``, not
``12 ... 15``).  A window that breaks the majority's mapping of one of its slots is
dropped.  A position of the item is covered if its window of either kind is left, in
any alignment.  An item is found in a document if at least ``coverage`` of its
positions are covered, or of those positions that have a template window.

Documents are read once and reduced, next to the scan, to the few windows that the
benchmark has: its sorted window hashes are sent to the tasks if there are at most
``SENT_WINDOWS`` (8 bytes each), else all windows are joined by a shuffle.

A template window needs ``MIN_LITERAL`` literal words, or tables of other numbers would
match.  An item of fewer than WINDOW words is one window as long as itself; one of fewer
than ``MIN_ITEM`` words, or without enough literal words, is found by its words only.

* null or empty text, null doc_id or item_id: not in the result
* repeated documents: one row for each doc_id and item_id; for repeated item_ids
  the windows of all their different texts count as one item
* very long text: processed whole; ties: of values that are equally common on a diagonal the smallest is the mapping
* extra columns: not in the result; empty tables: empty result
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm import textkernel as tk
from corpusflow.llm._common import picked, stored

WINDOW, COVERAGE, MIN_LITERAL, MIN_ITEM = 8, 0.4, 4, 4
SENT_WINDOWS = 4_000_000
UNITS = ("kg", "g", "mg", "lb", "lbs", "oz", "km", "m", "cm", "mm", "mi", "mile", "miles", "ft", "feet", "inch", "inches", "yd", "meter", "meters", "metre", "metres", "l", "ml", "litre", "litres", "liter", "liters", "gallon", "gallons", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "usd", "eur", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "kmh", "mph", "c", "f", "k", "w", "kw", "v", "hz", "gb", "mb")

_NUM, _NAME, _UNIT, _WORDS = (np.uint64(tk.mix(np.array([k], dtype=np.uint64))[0]) for k in (101, 102, 103, 104))


def word_hashes(items: list[str]) -> np.ndarray:
    raw, offsets = tk.string_buffer(pa.array(items, pa.large_string()))
    return np.array([tk.words(raw, offsets, i, i + 1).hash[0] for i in range(len(items))], dtype=np.uint64)


_UNIT_HASHES = np.sort(word_hashes(list(UNITS)))


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    if not len(among) or not len(values):
        return np.zeros(len(values), dtype=bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def templates(raw: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[tk.Words, np.ndarray, np.ndarray]:
    """(words, template of each, which of them are slots) of rows i..j."""
    w = tk.words(raw, offsets, i, j, flags=True)
    if not len(w.hash):
        return w, w.hash, np.zeros(0, dtype=bool)
    number = w.digits > 0
    first = raw[w.start]
    after = np.minimum(w.start + 1, w.end - 1)
    capital = tk.IS_UPPER[first] | ((first == 0xC3) & (raw[after] >= 0x80) & (raw[after] <= 0x9E))
    name = capital & (w.lower > 0) & ~number
    at = np.flatnonzero(name)
    begin = offsets[i:j][w.row[at]]
    opens = np.ones(len(at), dtype=bool)  # a sentence
    back = w.start[at] - 1
    seen = np.zeros(len(at), dtype=bool)
    for _ in range(4):  # over spaces, quotes and brackets
        inside = (back >= begin) & ~seen
        c = raw[np.maximum(back, 0)]
        ends = inside & np.isin(c, np.frombuffer(b".!?:\n\r|", dtype=np.uint8))
        skip = inside & np.isin(c, np.frombuffer(b" \t\"'()[]*", dtype=np.uint8))
        stop = inside & ~ends & ~skip
        opens[stop] = False
        seen |= ends | stop
        back = back - skip
    name[at[opens]] = False
    previous = np.zeros(len(number), dtype=bool)
    previous[1:] = number[:-1] & (w.row[1:] == w.row[:-1])
    unit = previous & ~number & ~name & _member(w.hash, _UNIT_HASHES)
    out = w.hash.copy()
    out[number], out[name], out[unit] = _NUM, _NAME, _UNIT
    return w, out, number | name | unit


def _cut(w, template, slot, length, keep, exact, whole=False):
    """(row, position, hash, values of slots) of windows of that length, of those in keep; exact: of the words, else of templates with enough literals; whole: only rows of exactly that length."""
    grams, at = tk.ngrams(w.hash if exact else template, w.row, length)
    if exact:
        grams = tk.mix(grams ^ _WORDS)
        ok = np.ones(len(at), dtype=bool)
    else:
        literal = np.concatenate([[0], np.cumsum(~slot)])
        ok = literal[at + length] - literal[at] >= min(MIN_LITERAL, length)
    if keep is not None:
        ok &= _member(grams, keep)
    bounds = w.bounds()
    if whole:
        ok &= np.diff(bounds)[w.row[at]] == length
    grams, at = grams[ok], at[ok]
    row = w.row[at]
    none = np.zeros(0, dtype=np.uint64)
    return row, at - bounds[row], grams, [none if exact else w.hash[k : k + length][slot[k : k + length]] for k in at]


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, part (its text), pos, length, exact, hash and slots of each window; alike: whether its position has a template window; n and n_alike: the positions of the item, and those alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, parts = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            raw, offsets = tk.string_buffer(b.column(1))
            for i, j in tk.blocks(offsets):
                words, template, slot = templates(raw, offsets, i, j)
                for length in range(1, WINDOW + 1):
                    for exact in (True, False) if length >= MIN_ITEM else (True,):
                        row, pos, grams, slots = _cut(words, template, slot, length, None, exact, whole=length < WINDOW)
                        out = _batch(ids[i:j][row], pos, length, grams, slots, "item_id")
                        yield out.append_column("part", pa.array(parts[i:j][row], pa.int64())).append_column("exact", pa.array(np.full(len(row), exact)))

    found = picked(benchmark, "item_id", "text").select(F.col("item_id").cast("bigint"), F.col("text"), F.xxhash64("text").alias("part")).filter("item_id is not null and text is not null").distinct()
    found = found.mapInArrow(run, "item_id bigint, pos int, length int, hash bigint, slots array<bigint>, part bigint, exact boolean")
    found = found.withColumn("alike", F.bool_or(~F.col("exact")).over(Window.partitionBy("item_id", "part", "pos")))
    item = Window.partitionBy("item_id")
    return found.withColumn("n", F.count_if("exact").over(item)).withColumn("n_alike", F.count_if(~F.col("exact")).over(item))


def _batch(ids, pos, length, grams, slots, key: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(pos, pa.int32()), pa.array(np.full(len(pos), length), pa.int32()), pa.array(grams.view(np.int64)), pa.array([s.view(np.int64) for s in slots], pa.list_(pa.int64()))],
        names=[key, "pos", "length", "hash", "slots"],
    )


def document_windows(docs: DataFrame, lengths: list[tuple[int, bool]], keep: np.ndarray | None) -> DataFrame:
    """doc_id, pos, length, hash and slots of the documents' windows (of those in keep); lengths: of each, and whether exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            raw, offsets = tk.string_buffer(b.column(1))
            for i, j in tk.blocks(offsets):
                words, template, slot = templates(raw, offsets, i, j)
                for length, exact in lengths:
                    row, pos, grams, slots = _cut(words, template, slot, length, keep, exact)
                    if len(row):
                        yield _batch(ids[i:j][row], pos, length, grams, slots, "doc_id")

    source = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), F.col("text")).filter("doc_id is not null and text is not null")
    return source.mapInArrow(run, "doc_id bigint, pos int, length int, hash bigint, slots array<bigint>")


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, windows (of the item found), item_windows and covered, a row for each item found in a document."""
    bench = stored(benchmark_windows(benchmark), "benchmark_windows")
    lengths = sorted((r["length"], r["exact"]) for r in bench.select("length", "exact").distinct().collect())  # at most 2 * WINDOW rows
    distinct = bench.select("hash").distinct()
    keep = None
    if distinct.limit(SENT_WINDOWS + 1).count() <= SENT_WINDOWS:
        keep = np.sort(distinct.toPandas()["hash"].to_numpy().astype(np.int64).view(np.uint64))
    found = document_windows(docs, lengths, keep)
    b = bench.select("item_id", F.struct("part", "pos").alias("place"), F.col("pos").alias("at"), "length", "hash", F.col("slots").alias("asked"), "alike", "n", "n_alike")
    hits = found.dropDuplicates(["doc_id", "pos", "length", "hash"]).join(b, ["hash", "length"]).withColumn("diagonal", F.col("pos") - F.col("at"))
    # stored, as two branches read it: the documents are read once
    hits = stored(hits.withColumn("pairs", F.arrays_zip("asked", "slots")).drop("asked", "slots", "hash", "length", "at"), "hits")
    key = ["doc_id", "item_id", "diagonal"]
    # the document's value for each of the item's values: the commonest on the diagonal, of equally common ones the smallest
    votes = hits.filter(F.size("pairs") > 0).select(*key, F.explode("pairs").alias("p")).groupBy(*key, F.col("p.asked").alias("asked"), F.col("p.slots").alias("value")).agg(F.count(F.lit(1)).alias("votes"))
    chosen = votes.groupBy(*key, "asked").agg(F.min_by("value", F.struct(-F.col("votes"), F.col("value"))).alias("value"))
    mapping = chosen.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("asked", "value"))).alias("mapping"))
    kept = hits.join(mapping, key, "left").filter(F.forall("pairs", lambda p: F.element_at(F.col("mapping"), p["asked"]) == p["slots"]))
    out = kept.groupBy("doc_id", "item_id").agg(
        F.count_distinct("place").alias("windows"),
        F.count_distinct(F.when(F.col("alike"), F.col("place"))).alias("windows_alike"),
        F.max("n").alias("item_windows"),
        F.max("n_alike").alias("item_windows_alike"),
    )
    by_alike = F.coalesce(F.col("windows_alike") * F.col("item_windows") > F.col("windows") * F.col("item_windows_alike"), F.lit(False))
    out = out.select("doc_id", "item_id", *[F.when(by_alike, F.col(f"{c}_alike")).otherwise(F.col(c)).alias(c) for c in ("windows", "item_windows")])
    out = out.withColumn("covered", F.col("windows") / F.col("item_windows"))
    return out.filter(F.col("covered") >= coverage)
