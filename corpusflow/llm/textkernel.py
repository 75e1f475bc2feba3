"""Vectorised token hashing over the UTF-8 buffers of Arrow string columns.

All content operators share one definition of a *word*: a maximal run of ASCII
letters, digits, ``_`` and non-ASCII bytes, where Latin-1 symbols (U+0080-U+00BF
without the letters), general punctuation (U+2000-U+207F) and CJK punctuation
(U+3000-U+303F) separate words and each kana, Han or Hangul character starts a
new one.  Case is folded for ASCII and Latin-1 letters.  Rows of any length are
processed in segments that end where a word ends; a word of any length is one word.

Hashes are 64-bit: a polynomial over the folded bytes, computed for all words of
a block at once from one prefix sum, then finalised with a bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
BLOCK_DOCS = 2048
_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[np.frombuffer(chars, dtype=np.uint8)] = True
    return out


_DIGITS = b"0123456789"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
IS_WORD = _table(_DIGITS + _UPPER + _LOWER + b"_" + bytes(range(0x80, 0x100)))
IS_DIGIT = _table(_DIGITS)
IS_UPPER = _table(_UPPER)
IS_LOWER = _table(_LOWER)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_pow = np.ones(1, dtype=np.uint64)
_ipow = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _ipow
    if len(_pow) < n:
        size = max(n, BLOCK_BYTES + 1)
        tables = []
        for base in (_BASE, _BASE_INV):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            tables.append(np.cumprod(factors, dtype=np.uint64))
        _pow, _ipow = tables
    return _pow, _ipow


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise uint64 values so that every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of length n+1) of a string array; null rows are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if not pa.types.is_large_string(array.type):
        array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    n = len(array)
    if n == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offs, data = array.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[array.offset : array.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, offsets


def blocks(offsets: np.ndarray, block_bytes: int = BLOCK_BYTES, block_docs: int = BLOCK_DOCS) -> Iterator[tuple[int, int]]:
    """Row ranges of about block_bytes; a longer row is a block by itself."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + block_bytes, side="right")) - 1
        j = min(max(j, i + 1), i + block_docs, n)
        yield i, j
        i = j


class Words:
    """Words of a range of rows, in order: row (relative), hash, first and last+1 byte, flags."""

    __slots__ = ("row", "hash", "start", "end", "upper", "lower", "digits", "n_rows")

    def __init__(self, row, hash, start, end, upper, lower, digits, n_rows):  # noqa: A002
        self.row, self.hash, self.start, self.end = row, hash, start, end
        self.upper, self.lower, self.digits, self.n_rows = upper, lower, digits, n_rows

    def bounds(self) -> np.ndarray:
        """Offsets (n_rows+1) of each row's words."""
        return np.searchsorted(self.row, np.arange(self.n_rows + 1))


def _word_mask(seg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, word mask, forced starts) of a segment."""
    fold, mask = FOLD[seg], IS_WORD[seg]
    forced = np.zeros(len(seg), dtype=bool)
    if len(seg) and seg.max() >= 0x80:
        last = len(seg) - 1
        at = np.flatnonzero(seg == 0xC3)
        at = at[at < last] + 1
        at = at[(seg[at] >= 0x80) & (seg[at] <= 0x9E) & (seg[at] != 0x97)]
        fold[at] += 0x20
        at = np.flatnonzero(seg == 0xC2)
        at = at[at < last]
        at = at[~np.isin(seg[at + 1], (0xAA, 0xB5, 0xBA))]
        mask[at] = False
        mask[at + 1] = False
        for lead, low, high in ((0xE2, 0x80, 0x81), (0xE3, 0x80, 0x80)):
            at = np.flatnonzero(seg == lead)
            at = at[at < last - 1]
            at = at[(seg[at + 1] >= low) & (seg[at + 1] <= high)]
            for k in range(3):
                mask[at + k] = False
        forced = (seg >= 0xE3) & (seg <= 0xED) & mask
    return fold, mask, forced


def _segment_words(seg: np.ndarray, row_starts: np.ndarray) -> tuple[np.ndarray, ...]:
    n = len(seg)
    fold, mask, forced = _word_mask(seg)
    forced[row_starts[row_starts < n]] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = mask[:-1]
    first = mask & (~before | forced)
    starts = np.flatnonzero(first)
    stop = before & (~mask | first)
    ends = np.flatnonzero(stop)
    if n and mask[-1]:
        ends = np.append(ends, n)
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((fold.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return starts, ends, hashes


def _segment_end(raw: np.ndarray, at: int, hi: int) -> int:
    """Where a segment of about a block ends: before an ASCII byte that separates words, or a byte that leads a character which begins a word or separates; without any, at the end of the row."""
    stop = at + BLOCK_BYTES
    while stop < hi:
        part = raw[stop : min(hi, stop + BLOCK_BYTES)]
        cut = np.flatnonzero(~IS_WORD[part] | ((part >= 0xE3) & (part <= 0xED)))
        if len(cut):
            return stop + int(cut[0])
        stop += len(part)
    return hi


def words(raw: np.ndarray, offsets: np.ndarray, i: int, j: int, flags: bool = False) -> Words:
    """Words of rows i..j; with flags, also counts of capitals, lower-case letters and digits in each."""
    lo, hi = int(offsets[i]), int(offsets[j])
    starts, ends, hashes = [], [], []
    at = lo
    while at < hi:
        stop = _segment_end(raw, at, hi)  # only a row of over a block is cut
        rows = offsets[i:j]
        s, e, h = _segment_words(raw[at:stop], rows[(rows >= at) & (rows < stop)] - at)
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(h)
        at = stop
    if not starts:
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none.astype(np.uint64), none, none, none, none, none, j - i)
    start, end, hashed = np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
    row = np.searchsorted(offsets[i : j + 1], start, side="right") - 1
    upper = lower = digits = None
    if flags:
        part = raw[lo:hi]
        counts = []
        for table in (IS_UPPER, IS_LOWER, IS_DIGIT):
            sums = np.zeros(len(part) + 1, dtype=np.int64)
            np.cumsum(table[part], out=sums[1:])
            counts.append(sums[end - lo] - sums[start - lo])
        upper, lower, digits = counts
    return Words(row, hashed, start, end, upper, lower, digits, j - i)


_MULTIPLIERS = np.array([((2 * k + 1) * 0xD6E8FEB86659FD93 + 2 * k) & _M64 | 1 for k in range(64)], dtype=np.uint64)


def ngrams(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of first word) of every n-gram that lies within one row."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        out = np.full(m, n, dtype=np.uint64)
        for k in range(n):
            out += hashes[k : k + m] * _MULTIPLIERS[k]
    at = np.flatnonzero(row[:m] == row[n - 1 :])
    return mix(out[at]), at


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, i: int, j: int, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each row; a row of 1..n-1 words has the one n-gram of all its words, a row without words none."""
    w = words(raw, offsets, i, j)
    grams, at = ngrams(w.hash, w.row, n)
    rows = w.row[at]
    cut = np.searchsorted(rows, np.arange(w.n_rows + 1))
    bounds = w.bounds()
    out = []
    for r in range(w.n_rows):
        if cut[r + 1] > cut[r]:
            out.append(np.unique(grams[cut[r] : cut[r + 1]]))
        elif bounds[r + 1] > bounds[r]:
            few = w.hash[bounds[r] : bounds[r + 1]]
            out.append(ngrams(few, np.zeros(len(few), dtype=np.int64), len(few))[0])
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
