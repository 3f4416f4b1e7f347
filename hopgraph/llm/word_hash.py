"""Hashes of all words of a batch of texts at once, and of their n-grams, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
PIECE = 1 << 20
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and its inverse modulo 2**64, for k < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(PIECE, 1 << (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        have = _powers[base] = tuple(both)
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _sums(values: np.ndarray, base: int, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Polynomial hashes of values[first:after]."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], dtype=np.uint64, out=total[1:])
    return mixed((total[after] - total[first]) * down[first])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of texts (null: empty), and where each text begins and the last ends."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_hashes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (between the six ASCII blanks), and at which word each text begins (and the last ends)."""
    data, offsets = text_bytes(column)
    if lower:
        data = LOWER[data]
    blank = IS_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.r_[True, blank[:-1]] if len(data) else blank
    first = np.flatnonzero(~blank & (before | edge[:-1]))
    behind = np.r_[blank[1:], True] if len(data) else blank
    after = np.flatnonzero(~blank & (behind | edge[1:])) + 1
    out = np.empty(len(first), np.uint64)
    at = 0
    while at < len(first):  # pieces of whole words
        stop = max(at + 1, int(np.searchsorted(after, first[at] + PIECE, "right")))
        lo, hi = first[at], after[stop - 1]
        out[at:stop] = _sums(data[lo:hi].astype(np.uint64) + np.uint64(1), BASE, first[at:stop] - lo, after[at:stop] - lo)
        at = stop
    return out, np.searchsorted(first, offsets)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n neighbouring words (across texts too)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    at = np.arange(len(words) - n + 1)
    return _sums(words, WORD_BASE, at, at + n)


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of every ``width`` neighbours, by doubling."""
    span, have = 1, values
    while span * 2 <= width:
        have, span = best(have[:-span], have[span:]), span * 2
    left = width - span
    return best(have[:len(have) - left], have[left:]) if left else have


def chunks(column: pa.Array, size: int):
    """(begin, end) of groups of neighbouring texts of about ``size`` bytes."""
    lengths = np.diff(text_bytes(column)[1])
    begin, total = 0, 0
    for k, n in enumerate(lengths):
        total += n
        if total >= size:
            yield begin, k + 1
            begin, total = k + 1, 0
    if begin < len(lengths):
        yield begin, len(lengths)
