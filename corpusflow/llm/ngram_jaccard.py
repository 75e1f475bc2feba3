"""Self-join of documents by the Jaccard similarity of their word n-gram sets, exact for sets of any size.

Every document is a query; every pair of documents with similarity of at least
``threshold`` is found.  ``classes`` reports a row for each document (its class and
the number of its links), ``join`` the pairs themselves.

1. A document's set is its distinct n-gram hashes.  Equal sets are one *node*;
   their documents are joined back at the end.  Of a node's documents one goes on, as
   long as the copies are at most ``SENT_IDS``; beyond, they cost work but change nothing.
2. Global order.  How many documents have each n-gram is counted over all documents.
   A block of documents sends its n-grams, packed, to the tasks that count them, one
   entry for each n-gram that ``LOCAL`` or more of its documents have (a hot n-gram is
   aggregated before the shuffle) and gets back those that another document
   has, with their counts (a byte: ``_code``); most n-grams occur once and go no further.
   N-grams are put in the order (count, hash), rarest first.  Large tables are counted in
   ``PASSES`` passes, each over its share of the n-grams, so that the disk holds one
   share at a time.
3. Prefix filter.  Two nodes x, y at the threshold t share at least
   t / (1 + t) * (|x| + |y|) n-grams, so they share one of the first
   |x| - ceil(t |x|) + 1 of x and of y; only these are indexed, and of these only
   n-grams that another document has.  No sketch, no sample: nothing is lost.
4. Index-level skipping.  The list of an n-gram is sorted by set size, so the size filter is a range
   of it, and the range is cut into blocks of ``BLOCK`` places.  A pair whose first
   shared n-gram is at positions i and j shares at most min(|x| - i, |y| - j), so
   entries, and whole blocks by their largest rest, are skipped by position.
   Lists that near copies share go to one task (that of their smallest node), which
   reports a pair once however many n-grams it shares; where these are more than about
   ``_ROWS_AT_ONCE`` rows they go to several tasks, by n-gram, and a pair's repeats are
   removed afterwards.  Where classes alone are asked for (``duplicates``), pairs that are connected anyway
   are not made (``node_classes``).  Lists of over ``LIST_ROWS``
   are cut into parts and each pair of parts is a task of its own: nothing is capped.
5. Answer-level skipping.  Candidates are verified in groups, the sets of a group
   shipped once; a group of over ``GROUP_PAIRS`` is cut, and a set goes to each piece that has a pair of it.  The group's leader L is intersected with each set x once; what
   x and L don't share is x's difference.  The overlap of two sets x, y then follows
   from the leader's answers and the differences alone:
   |x & y| = |L| - |L-x| - |L-y| + |(L-x) & (L-y)| + |(x-L) & (y-L)|.

Shuffled, each step's gone before the next: n-gram hashes (packed), the index, candidates,
and the sets of the documents that have candidates.  A block is named by its contents, and its
replies are counted: should a lost executor's input come back in another order, the job
fails rather than lose an n-gram.

* null doc_id: in no pair, not in ``classes``
* null text, text without words: in no pair; in ``classes`` a class of its own without links
* empty table: empty result; very long texts: as any other
* 1 to n-1 words: one n-gram of all words
* repeated rows: a doc_id is not paired with itself; a doc_id with several texts is
  in the pairs of each, and has a row for each in ``classes``
* ties: a pair at exactly the threshold is in; extra columns: not in the result
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm import textkernel as tk
from corpusflow.llm._common import SENT_IDS, by_ids, discard, picked, release_shuffles, stored

N, THRESHOLD = 3, 0.5
#: n-grams that this many documents of a block have are sent once for the block
LOCAL = 8
#: n-gram entries that a counting task should get; tables of more are taken in PASSES shares of the n-grams, one after the other
COUNTED, PASSES = 1_000_000, 2
LIST_ROWS, BLOCK = 1024, 64
#: so many nodes that have candidates (some 60 bytes each) are sent to the texts; beyond, they meet in a shuffle
SENT_NODES = SENT_IDS // 5
_ROWS_AT_ONCE, _PAIRS_AT_ONCE = 200_000, 500_000
#: distinct pairs that a task collects before it hands them on; repeats are removed afterwards
_PAIRS_HELD = 2_000_000
#: candidates of a group that are verified in one task, about
GROUP_PAIRS = 250_000


def node_of(grams: np.ndarray) -> int:
    """A 64-bit hash of a set."""
    with np.errstate(over="ignore"):
        total = tk.mix(grams + np.uint64(0x51ED270B)).sum(dtype=np.uint64)
        return int(tk.mix(np.array([total + np.uint64(len(grams))], dtype=np.uint64)).view(np.int64)[0])


def _int64(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def sizes(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, node and size; of documents without words node is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = tk.string_buffer(b.column(1))
            for i, j in tk.blocks(offsets):
                sets = tk.shingle_sets(raw, offsets, i, j, n)
                size = np.array([len(s) for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array([node_of(s) for s in sets], pa.int64(), mask=size == 0), pa.array(size, pa.int32())], names=["doc_id", "node", "size"]
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")).filter("doc_id is not null").mapInArrow(run, "doc_id bigint, node bigint, size int")


_PACKET = "to int, block bigint, packets int, tok binary, idx binary, many binary, n binary"


def _packed(to, block, packets, tok, idx, many, n) -> pa.RecordBatch:
    cells = [pa.array([x.tobytes() for x in column], pa.binary()) for column in (tok, idx, many, n)]
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(block, pa.int64()), pa.array(packets, pa.int32()), *cells], names=["to", "block", "packets", "tok", "idx", "many", "n"])


#: n-grams travel as 48 bits of their hash.  Where two n-grams share these, they count as one in the order, which the prefix filter allows; overlaps are of the whole hashes.
_BITS = np.uint64((1 << 48) - 1)


def _six(tok: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(tok).view(np.uint8).reshape(-1, 8)[:, :6]


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _code(df: np.ndarray) -> np.ndarray:
    """A count as a byte that grows with it: exact below 128, then four steps to a doubling.  N-grams of one code are in the order of their hashes, which the prefix filter allows."""
    high = 128 + np.floor(4 * np.log2(np.maximum(df, 128) / 128)).astype(np.int64)
    return np.where(df < 128, df, np.minimum(high, 255)).astype(np.uint8)


def packets(docs: DataFrame, n: int, parts: int, share: int = 0, shares: int = 1) -> DataFrame:
    """The n-grams, of one of so many shares, of blocks of documents.  To each counting task: tok, idx (entries of rare n-grams, and whose they are), many and n (n-grams that LOCAL or more have, and how many).

    For the block's owner (to < 0; a counting task hands it on): nodes, sizes, and the n-grams of many with whose they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = tk.string_buffer(b.column(0))
            for i, j in tk.blocks(offsets):
                sets = [s for s in tk.shingle_sets(raw, offsets, i, j, n) if len(s)]
                if not sets:
                    continue
                size = np.array([len(s) for s in sets], dtype=np.int32)
                nodes = np.array([node_of(s) for s in sets], dtype=np.int64)
                block = int(_int64(tk.mix(nodes.view(np.uint64) + np.arange(len(nodes), dtype=np.uint64))).sum())
                tok, idx = np.concatenate(sets) & _BITS, np.repeat(np.arange(len(sets), dtype=np.uint16), size)
                mine = tok % np.uint64(shares) == share
                tok, idx = tok[mine], idx[mine]
                part = ((tok >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)
                order = np.lexsort((tok, part))
                tok, idx, part = tok[order], idx[order], part[order]
                first = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]])[: len(tok)])
                count = np.diff(np.append(first, len(tok)))
                hot = count >= LOCAL
                rare = ~np.repeat(hot, count)
                many, m_part, m_count, m_idx = tok[first[hot]], part[first[hot]], count[hot].astype(np.int32), idx[~rare]
                tok, idx, part = tok[rare], idx[rare], part[rare]
                order = np.argsort(part.astype(np.int64) << 16 | idx, kind="stable")  # runs of idx are compressed
                tok, idx, part = tok[order], idx[order], part[order]
                to = np.unique(np.concatenate([part, m_part]))
                cut, m_cut = (np.searchsorted(p, np.append(to, parts)) for p in (part, m_part))
                spans, m_spans = list(zip(cut[:-1], cut[1:])), list(zip(m_cut[:-1], m_cut[1:]))
                yield _packed(to, [block] * len(to), [len(to)] * len(to), [_six(tok[x:y]) for x, y in spans], [idx[x:y] for x, y in spans], [_six(many[x:y]) for x, y in m_spans], [m_count[x:y] for x, y in m_spans])
                yield _packed([-1 - block % parts], [block], [len(to)], [nodes], [size], [np.concatenate([m_idx.view(np.uint8), _six(many).ravel()])], [m_count])

    return docs.select("text").filter("doc_id is not null and text is not null").mapInArrow(run, _PACKET)


def counted(sent: DataFrame, parts: int, share: int = 0) -> DataFrame:
    """The replies to packets: entries that another document has, and the code of how many have them (n: of tok, then of many).  Owners' rows as they are.  to: numbered through all shares, -1 - share for the owners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["to"]):
            if t.column("to")[0].as_py() < 0:
                yield from t.set_column(0, "to", pa.array(np.full(t.num_rows, -1 - share, dtype=np.int32))).to_batches()
                continue
            tok, many = ([_from_six(x) for x in t.column(c).to_pylist()] for c in ("tok", "many"))
            n = [np.frombuffer(x, np.int32) for x in t.column("n").to_pylist()]
            idx = [np.frombuffer(x, np.uint16) for x in t.column("idx").to_pylist()]
            every, at = np.unique(np.concatenate([*tok, *many]), return_inverse=True)
            rows = sum(map(len, tok))
            df = np.bincount(at[:rows], minlength=len(every)) + np.bincount(at[rows:], np.concatenate(n) if len(at) > rows else None, minlength=len(every)).astype(np.int64)
            df = _code(df)
            of_tok = np.split(df[at[:rows]], np.cumsum([len(x) for x in tok])[:-1])
            of_many = np.split(df[at[rows:]], np.cumsum([len(x) for x in many])[:-1])
            keep = [d > 1 for d in of_tok]
            to = t.column("to").to_numpy() + np.int32(share * parts)
            yield _packed(to, t.column("block").to_numpy(), t.column("packets").to_numpy(), [_six(x[k]) for x, k in zip(tok, keep)], [x[k] for x, k in zip(idx, keep)], [_six(x[:0]) for x in many], [np.concatenate([d[k], m]) for d, k, m in zip(of_tok, keep, of_many)])

    part = F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to"))
    return sent.repartitionById(parts, part).sortWithinPartitions("to").mapInArrow(run, _PACKET)


def postings(replies: DataFrame, parts: int, shares: int, threshold: float) -> DataFrame:
    """tok, node, size and pos: the prefix of each node, of n-grams that another document has.  replies: of all shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["block"]):
            rows = {}
            for r in t.to_pylist():  # of each share, the owner's row and one for each part
                rows.setdefault(r["to"], r)
            own = [rows.pop(-1 - k, None) for k in range(shares)]
            if None in own or len(rows) != sum(o["packets"] for o in own):
                raise RuntimeError("a block of n-grams did not get all its replies: its input changed between two runs of a task")
            node, size = np.frombuffer(own[0]["tok"], np.int64), np.frombuffer(own[0]["idx"], np.int32).astype(np.int64)
            tok, idx, df, m_df = [], [], [], [[] for _ in own]
            for to, r in sorted(rows.items()):
                x = _from_six(r["tok"])
                d = np.frombuffer(r["n"], np.uint8)
                tok.append(x)
                idx.append(np.frombuffer(r["idx"], np.uint16))
                df.append(d[: len(x)])
                m_df[to // parts].append(d[len(x) :])
            for o, m in zip(own, m_df):
                repeat = np.frombuffer(o["n"], np.int32)  # in the order of parts, as the replies
                hot = int(repeat.sum()) * 2
                tok.append(np.repeat(_from_six(o["many"][hot:]), repeat))
                idx.append(np.frombuffer(o["many"][:hot], np.uint16))
                df.append(np.repeat(np.concatenate([df[0][:0], *m]), repeat))
            tok, idx, df = np.concatenate(tok), np.concatenate(idx).astype(np.int64), np.concatenate(df)
            order = np.lexsort((tok, df, idx))
            tok, idx, df = tok[order], idx[order], df[order]
            start = np.searchsorted(idx, np.arange(len(node)))
            shared = np.bincount(idx, minlength=len(node))
            pos = np.arange(len(idx)) - start[idx] + (size - shared)[idx]  # after the n-grams that it has alone
            prefix = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
            at = np.flatnonzero(pos < prefix[idx])
            if len(at):
                who = idx[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_int64(tok[at])), pa.array(node[who]), pa.array(size[who].astype(np.int32)), pa.array(pos[at].astype(np.int32))], names=["tok", "node", "size", "pos"]
                )

    return replies.repartition("block").sortWithinPartitions("block").mapInArrow(run, "tok bigint, node bigint, size int, pos int")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, of rows sorted by key."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        changed = np.zeros(b.num_rows - 1, dtype=bool)
        for k in keys:
            v = b.column(k).to_numpy(zero_copy_only=False)
            changed |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(changed) + 1), b.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            part = b.slice(s, e - s)
            if held and s == 0 and any(held[-1].column(k)[0] != part.column(k)[0] for k in keys):
                yield pa.Table.from_batches(held)
                held = []
            elif held and s:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _chunks(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """(columns, number of the group) of whole groups of rows sorted by key: of as many groups as have so many rows together.  No table is made for each group: most have few rows."""
    held: list[pa.RecordBatch] = []
    n = 0

    def whole() -> tuple[dict[str, np.ndarray], np.ndarray]:
        t = pa.Table.from_batches(held)
        col = {k: t.column(k).to_numpy() for k in t.column_names}
        begins = np.zeros(t.num_rows, dtype=bool)
        for k in keys:
            begins[1:] |= col[k][1:] != col[k][:-1]
        held.clear()
        return col, np.cumsum(begins)

    for b in batches:
        if not b.num_rows:
            continue
        begins = np.zeros(b.num_rows, dtype=bool)
        for k in keys:
            v = b.column(k).to_numpy(zero_copy_only=False)
            begins[1:] |= v[1:] != v[:-1]
            begins[0] |= bool(held) and held[-1].column(k)[-1].as_py() != v[0]
        starts, done = np.flatnonzero(begins), 0
        while (at := np.searchsorted(starts, done + rows - n)) < len(starts):
            if starts[at] > done:
                held.append(b.slice(done, starts[at] - done))
            yield whole()
            done, n = int(starts[at]), 0
        held.append(b.slice(done))
        n += b.num_rows - done
    if held:
        yield whole()


def _spans(n: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of n, each of about so much in all."""
    cuts = np.searchsorted(np.cumsum(n), np.arange(most, n.sum() + most, most), side="right") if len(n) else []
    x = 0
    for y in [*cuts, len(n)]:
        if x < y:
            yield x, max(x + 1, int(y))
            x = max(x + 1, int(y))


def list_pairs(*lists) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of pair_parts, all at once."""
    pairs = np.unique(np.concatenate([np.column_stack(x) for x in pair_parts(*lists)]), axis=0)
    return pairs[:, 0], pairs[:, 1]


def pair_parts(group: np.ndarray, tok, node, size, pos, part, cross, root, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of the lists (group, tok): of different roots, of sizes, and with rests after their positions, that allow the threshold.  cross: only pairs of different parts.

    They come as they are made, distinct ones of about _PAIRS_HELD and more at a time.
    """
    order = np.lexsort((size, tok, group))
    group, tok, node, size, pos, part, cross, root = (x[order] for x in (group, tok, node, size, pos, part, cross, root))
    m = len(order)
    which = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]) | (tok[1:] != tok[:-1])]))
    wide = np.int64(int(size.max()) * 2 + 2)
    key = which * wide + size
    end = np.searchsorted(key, which * wide + np.minimum(np.floor(size / threshold + 1e-9).astype(np.int64), wide - 1), side="right")
    share = threshold / (1 + threshold)
    rest, least = size - pos, np.ceil(2 * share * size - 1e-9)  # the partner is at least as large
    names, code = np.unique(node, return_inverse=True)
    at = np.flatnonzero((end > np.arange(m) + 1) & (rest >= least))
    best = np.maximum.reduceat(rest, np.arange(0, m, BLOCK))
    # pieces of each range that lie in one block of places; those without a rest that is long enough are skipped
    low, high = (at + 1) // BLOCK, (end[at] - 1) // BLOCK
    pieces = high - low + 1
    found, fresh, held = np.zeros(0, dtype=np.int64), [], 0
    for i, j in _spans(pieces, _PAIRS_AT_ONCE):
        n = pieces[i:j]
        who = np.repeat(at[i:j], n)
        block = np.repeat(low[i:j] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        ok = best[block] >= least[who]
        who, block = who[ok], block[ok]
        start = np.maximum(who + 1, block * BLOCK)
        n = np.minimum(end[who], (block + 1) * BLOCK) - start
        for x, y in _spans(n, _PAIRS_AT_ONCE):
            k = n[x:y]
            a = np.repeat(who[x:y], k)
            b = np.repeat(start[x:y] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            ok = (np.minimum(rest[a], rest[b]) >= np.ceil(share * (size[a] + size[b]) - 1e-9)) & (root[a] != root[b]) & (~cross[a] | (part[a] != part[b]))
            u, v = code[a[ok]], code[b[ok]]
            fresh.append(np.unique(np.minimum(u, v) * len(names) + np.maximum(u, v)))
            held += len(fresh[-1])
            if held > max(2 * _PAIRS_AT_ONCE, len(found)):  # lists of near copies repeat their pairs
                found, fresh, held = np.unique(np.concatenate([found, *fresh])), [], 0
                if len(found) > _PAIRS_HELD:
                    yield names[found // len(names)], names[found % len(names)]
                    found = found[:0]
    found = np.unique(np.concatenate([found, *fresh]))
    yield names[found // len(names)], names[found % len(names)]


def _with_one(lists: DataFrame, threshold: float) -> DataFrame:
    """a, b: of the candidates, those of each row and low, another row of its list that is not larger."""
    rest = F.least(F.col("size") - F.col("pos"), F.col("low.size") - F.col("low.pos"))
    may = (F.col("low.size") >= F.ceil(F.lit(threshold) * F.col("size") - 1e-9)) & (rest >= F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("size") + F.col("low.size")) - 1e-9))
    return lists.filter((F.col("node") != F.col("low.node")) & may).select(F.least("node", "low.node").alias("a"), F.greatest("node", "low.node").alias("b")).distinct()


def starred(index: DataFrame, threshold: float) -> DataFrame:
    """a, b: of the candidates, those of each list's smallest set (of ties the smallest node)."""
    return _with_one(index.withColumn("low", F.min(F.struct("size", "node", "pos")).over(Window.partitionBy("tok"))), threshold)


def chained(lists: DataFrame, threshold: float) -> DataFrame:
    """a, b: of the candidates of different roots, those of neighbours in a list by size."""
    before = F.lag(F.struct("size", "node", "pos", "root")).over(Window.partitionBy("tok").orderBy("size", "node"))
    return _with_one(lists.withColumn("low", before).filter(F.col("low.root") != F.col("root")), threshold)


def rooted(index: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """index with each node's root, and many: whether that is the root of most rows of the list (of ties the largest).

    Without what no candidate of different roots comes from: rows whose rest is too short for every set of the list, then lists of one root.
    """
    of = Window.partitionBy("tok")
    lists = index.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = F.greatest(F.min("size").over(of), F.ceil(F.lit(threshold) * F.col("size") - 1e-9))
    lists = lists.withColumn("least", least).filter(F.col("size") - F.col("pos") >= F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("size") + F.col("least")) - 1e-9))
    lists = lists.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("tok", "root")))
    lists = lists.withColumn("most", F.max(F.struct("n", "root")).over(of)).withColumn("two", F.min("root").over(of) < F.max("root").over(of))
    return lists.filter("two").select("tok", "node", "size", "pos", "root", (F.col("root") == F.col("most.root")).alias("many"))


def candidates(index: DataFrame, threshold: float) -> DataFrame:
    """a, b: pairs of nodes that share an n-gram of their prefixes and may reach the threshold.  Of an index that has roots (``rooted``), pairs of different roots only."""
    of = Window.partitionBy("tok")
    if "root" not in index.columns:
        index = index.withColumns({"root": F.col("node"), "many": F.lit(False)})
    lists = index.withColumn("rep", F.min("node").over(of)).withColumn("last", F.max("node").over(of)).withColumn("n", F.count(F.lit(1)).over(of)).withColumn("widest", F.max("size").over(of)).filter("rep < last")
    # a power of two, so that a node's parts are nested
    halves = lambda n: F.pow(F.lit(2.0), F.greatest(F.lit(0), F.ceil(F.log2(n / F.lit(LIST_ROWS))).cast("int"))).cast("int")
    # the rows of the root of most get parts of their own, after those of the others, and meet the others only
    few = F.col("n") - F.sum(F.col("many").cast("int")).over(of)
    lists = lists.withColumn("first", F.when(few == 0, 0).otherwise(halves(few))).withColumn("parts", F.when(few == F.col("n"), F.col("first")).otherwise(F.col("first") + halves(F.col("n") - few)))
    # rows of a group, were all n-grams of its smallest node in lists as long as this one
    rows = F.col("n") / F.col("parts") * F.least(F.col("parts"), F.lit(2)) * (F.floor((1 - threshold) * F.col("widest")) + 1)
    lists = lists.withColumn("slice", F.pmod(F.xxhash64("tok"), F.ceil(rows / F.lit(_ROWS_AT_ONCE))).cast("int"))
    part = F.when(F.col("many"), F.col("first") + F.pmod(F.xxhash64("node"), F.col("parts") - F.col("first"))).otherwise(F.pmod(F.xxhash64("node"), F.col("first"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("many"), F.col("first")).otherwise(F.col("parts")) - 1)
    lists = lists.withColumn("part", part).select("rep", "slice", "tok", "node", "size", "pos", "root", "part", F.explode(others).alias("other"))
    lists = lists.select("rep", "slice", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "tok", "node", "size", "pos", "root", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for col, group in _chunks(batches, ["rep", "slice", "p", "q"], _ROWS_AT_ONCE):
            for a, b in pair_parts(group, col["tok"], col["node"], col["size"].astype(np.int64), col["pos"].astype(np.int64), col["part"], col["p"] != col["q"], col["root"], threshold):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return lists.repartition("rep", "slice", "p", "q").sortWithinPartitions("rep", "slice", "p", "q").mapInArrow(run, "a bigint, b bigint").distinct()


def overlaps(sets: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """|x & y| of pairs of a group, derived from the answers of the group's leader."""
    if len(a) == 1:
        return np.array([len(np.intersect1d(sets[a[0]], sets[b[0]], assume_unique=True))])
    names, which = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = which[: len(a)], which[len(a) :]
    leader = sets[names[np.bincount(which).argmax()]]  # the node with the most pairs
    extra, missing, n_extra, n_missing = [], [], [], []
    for node in names:
        s = sets[node]
        at = np.minimum(np.searchsorted(leader, s), len(leader) - 1)
        hit = leader[at] == s
        extra.append(s[~hit])
        gone = np.ones(len(leader), dtype=bool)
        gone[at[hit]] = False
        missing.append(np.flatnonzero(gone))
        n_extra.append(len(extra[-1]))
        n_missing.append(len(missing[-1]))
    n_missing = np.array(n_missing)
    out = len(leader) - n_missing[x] - n_missing[y]
    codes = np.unique(np.concatenate(extra), return_inverse=True)[1]
    extra = np.split(codes, np.cumsum(n_extra)[:-1])
    for parts, width in ((missing, len(leader)), (extra, int(codes.max(initial=-1)) + 1)):
        if width:
            out += _common_counts(parts, x, y, width)
    return out


def _common_counts(parts: list[np.ndarray], x: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """|parts[x] & parts[y]| of each pair."""
    out = np.zeros(len(x), dtype=np.int64)
    mark = np.zeros(width, dtype=bool)
    order = np.argsort(x, kind="stable")
    for run in np.split(order, np.flatnonzero(np.diff(x[order])) + 1):
        mine = parts[x[run[0]]]
        if not len(mine):
            continue
        mark[mine] = True
        for k in range(0, len(run), 512):
            theirs = [parts[v] for v in y[run[k : k + 512]]]
            sums = np.concatenate([[0], np.cumsum(mark[np.concatenate(theirs)])])
            ends = np.cumsum([len(t) for t in theirs])
            out[run[k : k + 512]] = sums[ends] - sums[np.concatenate([[0], ends[:-1]])]
        mark[mine] = False
    return out


def cut_groups(led: DataFrame) -> DataFrame:
    """led (g, a, b) with groups of over GROUP_PAIRS pairs cut: a group's nodes are dealt into parts, and each pair of parts is a group of its own.

    A new g is a hash.  Should two be equal, their groups are verified together, which gives the same pairs.
    """
    parts = F.ceil(F.sqrt(F.lit(2.0) * F.col("n") / GROUP_PAIRS)).cast("int")
    large = led.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP_PAIRS).select(F.col("g").alias("_g"), parts.alias("_parts"))
    p, q = (F.pmod(F.xxhash64(c), F.col("_parts")) for c in ("a", "b"))
    # few are large: one for GROUP_PAIRS pairs at most
    return led.join(F.broadcast(large), F.col("g") == F.col("_g"), "left").select(F.when(F.col("_g").isNull(), F.col("g")).otherwise(F.xxhash64("g", F.least(p, q), F.greatest(p, q))).alias("g"), "a", "b")


def verified(docs: DataFrame, holders: DataFrame, pairs: DataFrame, n: int, threshold: float) -> DataFrame:
    """a, b, jaccard of the candidate pairs of nodes that reach the threshold.  holders: node and doc_id of a document that has it."""
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("o")).union(pairs.select("b", "a"))
    lead = both.groupBy("node").agg(F.least(F.min("o"), F.col("node")).alias("lead"))
    led = pairs.join(lead.select(F.col("node").alias("a"), F.col("lead").alias("la")), "a").join(lead.select(F.col("node").alias("b"), F.col("lead").alias("lb")), "b")
    led = cut_groups(stored(led.select(F.least("la", "lb").alias("g"), "a", "b"), "led"))
    member = led.select("g", F.col("a").alias("node")).union(led.select("g", "b")).distinct().groupBy("node").agg(F.collect_list("g").alias("gs"))
    wanted = member.join(holders, "node").select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"), "gs")
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")).filter("doc_id is not null and text is not null")
    wanted = stored(wanted, "wanted")
    few = wanted.limit(SENT_NODES + 1).count() <= SENT_NODES
    if not few:  # of these documents only, the texts move
        source = by_ids(source, wanted.select(F.col("_id").alias("doc_id")), "left_semi")
    text = source.join(F.broadcast(wanted) if few else wanted.hint("shuffle_hash"), source["doc_id"] == F.col("_id")).select("_node", "gs", "text")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = b.column(0).to_numpy()
            raw, offsets = tk.string_buffer(b.column(2))
            for i, j in tk.blocks(offsets):
                sets = tk.shingle_sets(raw, offsets, i, j, n)
                at = [k for k, s in enumerate(sets) if len(s) and node_of(s) == nodes[i + k]]  # a doc_id may have another text too
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[i:j][at], pa.int64()), b.column(1).take(pa.array([i + k for k in at], pa.int64())), pa.array([sets[k].tobytes() for k in at], pa.binary())], names=["node", "gs", "grams"]
                )

    rebuilt = text.mapInArrow(rebuild, "node bigint, gs array<bigint>, grams binary").select(F.explode("gs").alias("g"), F.col("node").alias("a"), F.lit(None).cast("bigint").alias("b"), "grams")
    rows = rebuilt.unionByName(led.select("g", "a", "b", F.lit(None).cast("binary").alias("grams")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["g"]):
            held = t.filter(t.column("grams").is_valid())
            sets = {k: np.frombuffer(s.as_buffer(), dtype=np.uint64) for k, s in zip(held.column("a").to_pylist(), held.column("grams"))}
            t = t.filter(t.column("b").is_valid())
            x, y = t.column("a").to_numpy(), t.column("b").to_numpy()
            shared = overlaps(sets, x, y)
            names = np.array(sorted(sets), dtype=np.int64)
            size = np.array([len(sets[k]) for k in names.tolist()])
            score = shared / (size[np.searchsorted(names, x)] + size[np.searchsorted(names, y)] - shared)
            good = score >= threshold
            if good.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[good]), pa.array(y[good]), pa.array(score[good])], names=["a", "b", "jaccard"])

    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(check, "a bigint, b bigint, jaccard double")


def without_copies(docs: DataFrame, members: DataFrame, holders: DataFrame) -> DataFrame:
    """docs without those that hold no node: their sets are those of documents with smaller ids.  All docs where these are too many to be sent."""
    low = holders.select("node", F.col("doc_id").alias("low"))
    copies = members.join(low, "node").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("low")).alias("holds")).filter("not holds").select(F.col("doc_id").alias("_id"))
    copies = stored(copies, "copies")
    if copies.limit(SENT_IDS + 1).count() > SENT_IDS:
        return docs
    return docs.join(F.broadcast(copies), docs["doc_id"].cast("bigint") == F.col("_id"), "left_anti")


def prefix_index(docs: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(members: node, size and doc_id, of all documents; holders: node and one of its documents; index: postings; shares that it is worked on in), stored."""
    if not 0 < threshold <= 1 or n < 1 or n > len(tk._MULTIPLIERS):
        raise ValueError("threshold must be in (0, 1], n from 1 to 64")
    docs = picked(docs, "doc_id", "text")
    spark = docs.sparkSession
    members = stored(sizes(docs, n).distinct(), "sizes")
    holders = members.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    once = without_copies(docs, members, holders)
    total = members.agg(F.sum(F.col("size").cast("bigint"))).first()[0] or 0
    shares = 1 if total <= COUNTED else PASSES
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (COUNTED * shares)))
    # each step is stored, so that the shuffles of one are gone before the next begins
    replies = []
    for k in range(shares):
        replies.append(stored(counted(packets(once, n, parts, k, shares), parts, k), "replies"))
        release_shuffles(spark)
    index = stored(postings(functools.reduce(DataFrame.union, replies), parts, shares, threshold), "index")
    discard(*replies)
    release_shuffles(spark)
    return members, holders, index, shares


def all_candidates(index: DataFrame, shares: int, threshold: float) -> DataFrame:
    """candidates of the index, share by share, stored; the index goes."""
    found = []
    for k in range(shares):
        found.append(stored(candidates(index.filter(F.pmod(F.xxhash64("tok"), F.lit(shares)) == k), threshold), "candidates"))
        release_shuffles(index.sparkSession)
    discard(index)
    pairs = found[0]
    if shares > 1:
        pairs = stored(functools.reduce(DataFrame.union, found).distinct(), "candidates")
        discard(*found)
    return pairs


def node_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members: node and doc_id, of all documents; pairs: a, b, jaccard, of different nodes).  Together they hold every pair of documents."""
    docs = picked(docs, "doc_id", "text")
    members, holders, index, shares = prefix_index(docs, n, threshold)
    pairs = all_candidates(index, shares, threshold)
    return members.select("node", "doc_id").distinct(), verified(docs, holders, pairs, n, threshold)


def node_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members, as of node_join; node and root, of the components of its pairs).  Exact, but a group of k similar sets costs k pairs, not k * k / 2.

    First each list's smallest set is held against the others, then neighbours of what is not connected yet.  Of the
    other candidates, only those whose nodes are still not connected are made and verified: the rest can connect nothing.
    """
    docs = picked(docs, "doc_id", "text")
    spark = docs.sparkSession
    members, holders, index, shares = prefix_index(docs, n, threshold)

    def grown(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
        """roots, with what the candidates that hold connect."""
        edges = stored(verified(docs, holders, pairs, n, threshold).select("a", "b"), "near")
        discard(pairs)
        release_shuffles(spark)
        return stored(components(edges if roots is None else edges.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))), "roots")

    roots = None
    for some in (starred, chained):
        pairs = stored(some(index, threshold), some.__name__)
        release_shuffles(spark)
        roots = grown(pairs, roots)
        left = stored(rooted(index.select("tok", "node", "size", "pos"), roots, threshold), "rooted")
        discard(index)
        release_shuffles(spark)
        index = left
    return members.select("node", "doc_id").distinct(), grown(all_candidates(index, shares, threshold), roots)


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its connected component of the join) and links (how many other documents are similar to it, equal ones included)."""
    members, pairs = node_join(docs, n, threshold)
    pairs = stored(pairs.select("a", "b"), "pairs")
    held = members.filter("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"))
    both = pairs.union(pairs.select("b", "a"))
    links = both.join(held.select(F.col("node").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("more"))
    info = held.join(components(pairs), "node", "left").join(links.withColumnRenamed("a", "node"), "node", "left")
    info = info.select("node", F.coalesce("root", "node").alias("root"), "low", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"))
    lowest = info.groupBy("root").agg(F.min("low").alias("class_id"))
    info = info.join(lowest, "root").select("node", "class_id", "links")
    return members.join(info, "node", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """doc_a < doc_b and jaccard, a row for each pair of documents at or over the threshold (copies expanded, so for tables of few copies)."""
    members, pairs = node_join(docs, n, threshold)
    members = members.filter("node is not null")
    one = members.select(F.col("node").alias("a"), F.col("doc_id").alias("x"))
    two = members.select(F.col("node").alias("b"), F.col("doc_id").alias("y"))
    across = pairs.join(one, "a").join(two, "b").select("x", "y", "jaccard")
    within = one.join(two, F.col("a") == F.col("b")).filter("x < y").select("x", "y", F.lit(1.0).alias("jaccard"))
    out = across.union(within).filter("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its connected component) of undirected edges (a, b), by alternating stars."""
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    last = None
    while True:
        # large star: every larger neighbour is hung on the smallest of the neighbourhood
        both = e.union(e.select("v", "u"))
        root = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour, and the node, is hung on the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low).distinct()
        e = stored(small, "edges")
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())


def duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and kept: each document of a group of similar ones (a connected component of the join) except the one with the smallest doc_id, which is kept."""
    members, roots = node_classes(docs, n, threshold)
    members = members.filter("node is not null")
    grouped = members.join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    kept = grouped.groupBy("root").agg(F.min("doc_id").alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return grouped.join(kept, "root").filter("doc_id <> kept").select("doc_id", "kept").distinct()
