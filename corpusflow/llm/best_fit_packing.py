"""Best-fit packing of documents into training sequences by minimum bin slack.

Lengths are words (runs of characters that are not white space).  A document of
over ``capacity`` words gives full pieces of ``capacity`` words and one remainder;
nothing is dropped or truncated.  Bins are filled one by one: the longest piece
that is left opens the bin, and a subset-sum dynamic programme over the lengths
that are left, its states the bits of one integer, finds the fullest feasible
combination with it, which is removed.

The programme sees only how many pieces of each length are left, a table of at
most ``capacity`` rows whatever the size of the corpus, and a combination is taken
as often as the counts allow before the next programme runs (until one of its
lengths runs out the programme would choose it again).  So one global plan, not a
plan for each partition, is made on the driver from bounded data; pieces find
their bins by their rank among those of their length, which is computed in
parallel in two levels (rank within a hashed bucket, plus the bucket's offset).

Ties: among equally full combinations the one with the longest lengths; pieces of
one length in the order of (hash, doc_id, piece).

* null or empty text, or white space only: 0 words, no piece
* null doc_id: packed like any other, with doc_id null
* empty table: empty result; very long text: as many pieces as it needs
* repeated rows: each is packed; extra columns: not in the result
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm._common import picked, stored

CAPACITY = 2048
#: pieces that one ranking task should get
BUCKET_ROWS = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0B]+")), F.lit(0))


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum of at most ``room``; lengths are tried from the longest."""
    if room <= 0:
        return {}
    full, reach, trail = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if 0 < x <= room), reverse=True):
        left, step = min(counts[length], room // length), 1
        while left:  # binary parts of the multiplicity
            take = min(step, left)
            trail.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            step *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(trail):
        if not before >> at & 1:
            at -= length * take
            out[length] = out.get(length, 0) + take
    return out


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, lengths of each) in the order in which they are filled."""
    left = {k: int(v) for k, v in counts.items() if v > 0}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("lengths must be from 1 to the capacity")
    plan = []
    while left:
        first = max(left)
        left[first] -= 1
        combo = fullest({k: v for k, v in left.items() if v}, capacity - first)
        left[first] += 1
        combo[first] = combo.get(first, 0) + 1
        times = min(left[k] // n for k, n in combo.items())
        plan.append((times, combo))
        for k, n in combo.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return plan


def _ranges(plan: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first ranks of its ranges, and of each range the first bin, pieces a bin, offset in the bin, slot."""
    used: dict[int, int] = {}
    rows: dict[int, list[tuple[int, ...]]] = {}
    bin_id = 0
    for times, combo in plan:
        offset = slot = 0
        for length in sorted(combo, reverse=True):
            n = combo[length]
            rows.setdefault(length, []).append((used.get(length, 0), bin_id, n, offset, slot))
            used[length] = used.get(length, 0) + n * times
            offset += length * n
            slot += n
        bin_id += times
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v)) for k, v in rows.items()}


def pieces(docs: DataFrame, capacity: int) -> DataFrame:
    """doc_id, piece (from 0), start (in words) and length of each piece."""
    n = picked(docs, "doc_id", "text").select(F.col("doc_id"), word_count(F.col("text")).alias("n")).filter("n > 0")
    parts = F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("int"))
    out = n.select("doc_id", "n", F.explode(parts).alias("piece"))
    start = F.col("piece") * F.lit(capacity)
    return out.select("doc_id", "piece", start.alias("start"), F.least(F.lit(capacity), F.col("n") - start).cast("int").alias("length"))


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """bin_id, slot, bin_offset, doc_id, piece, start, length: a row for each piece."""
    items = stored(pieces(docs, capacity).withColumn("_h", F.xxhash64("doc_id", "piece")), "pieces")
    counts = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}  # at most capacity rows
    total = sum(counts.values())
    buckets = max(1, -(-total // BUCKET_ROWS))
    ranges = _ranges(plan_bins(counts, capacity))
    items = items.withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets)))
    # offsets of (length, bucket): a table of at most capacity rows for each 50,000 pieces, summed in parallel by length
    sizes = items.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumn("_first", F.sum("_n").over(Window.partitionBy("length").orderBy("_b")) - F.col("_n")).drop("_n")
    ranked = items.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_b").orderBy("_h", "doc_id", "piece")) - 1)
    ranked = ranked.join(offsets, ["length", "_b"]).select("doc_id", "piece", "start", "length", (F.col("_first") + F.col("_r")).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            out = {k: np.zeros(len(b), dtype=np.int64) for k in ("bin_id", "slot", "bin_offset")}
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for at in np.split(order, cuts):
                if not len(at):
                    continue
                size = int(length[at[0]])
                first, bin0, each, offset, slot = ranges[size]
                k = np.searchsorted(first, rank[at], side="right") - 1
                within = rank[at] - first[k]
                out["bin_id"][at] = bin0[k] + within // each[k]
                out["slot"][at] = slot[k] + within % each[k]
                out["bin_offset"][at] = offset[k] + within % each[k] * size
            yield pd.DataFrame(out | {c: b[c].to_numpy() for c in ("piece", "start", "length")}).assign(doc_id=b["doc_id"].astype("Int64"))[_COLUMNS]

    return ranked.mapInPandas(place, "bin_id bigint, slot bigint, bin_offset bigint, doc_id bigint, piece int, start int, length int")


_COLUMNS = ["bin_id", "slot", "bin_offset", "doc_id", "piece", "start", "length"]
