"""Which parts of texts can be one of very many words: a bitmap of hashes, probed at every place of every text."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One bitmap row: 32768 bits, what bitmap_construct_agg makes.
BITMAP_BITS = 32768
#: The filter is never larger than this (64 MB); beyond it more parts pass, never fewer.
MAX_FILTER_BITS = 2**29
BITS_PER_WORD = 16
PROBES = 3
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 2**64)


def filter_bits(words: int) -> int:
    return min(MAX_FILTER_BITS, max(2**15, 2 ** math.ceil(math.log2(max(1, words) * BITS_PER_WORD))))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _hashes(points: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` code points from every place on: differences of sums of code points times powers, all modulo 2^64."""
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(points.astype(np.uint64) * _powers(BASE, len(points)), out=sums[1:], dtype=np.uint64)
    h = (sums[size:] - sums[:-size]) * _powers(INVERSE, len(points))[: len(points) - size + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _slots(h: np.ndarray, probe: int, bits: int) -> np.ndarray:
    return ((h + np.uint64(probe) * (h >> np.uint64(40) | np.uint64(1))) & np.uint64(bits - 1)).astype(np.int64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_filter(words: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of words(word), distinct and not empty. Spark sets the bits; at most 64 MB come to the driver."""

    def run(batches):
        for b in batches:
            h = np.array([_hashes(_points(w), len(w))[0] for w in b.column(0).to_pylist()], np.uint64)
            slots = np.concatenate([_slots(h, p, bits) for p in range(PROBES)])
            yield pa.RecordBatch.from_arrays([pa.array(slots)], ["slot"])

    slots = words.select("word").mapInArrow(run, "slot long")
    rows = slots.groupBy(F.expr(f"slot div {BITMAP_BITS}").alias("bucket")).agg(F.bitmap_construct_agg(F.col("slot") % BITMAP_BITS).alias("bitmap"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():
        out[r.bucket * BITMAP_BITS // 8:(r.bucket + 1) * BITMAP_BITS // 8] = np.frombuffer(bytes(r.bitmap), np.uint8)
    return out


def possible_parts(texts: DataFrame, words: DataFrame, sizes: list[int]) -> DataFrame:
    """texts(row long, data), words(word) of ``sizes`` code points -> (row, word): every part of a text that is a word, and few that aren't."""
    bits = filter_bits(words.count())
    shared = texts.sparkSession.sparkContext.broadcast(word_filter(words, bits))

    def run(batches):
        bitmap = shared.value
        for b in batches:
            rows, found_rows, found = b.column(0).to_numpy(zero_copy_only=False), [], []
            data = b.column(1).to_pylist()
            whole, lengths = "".join(data), np.array([len(t) for t in data], np.int64)
            points, ends = _points(whole), np.cumsum(lengths)
            owner = np.repeat(np.arange(len(data)), lengths)
            for size in sizes:
                if len(points) < size:
                    continue
                h = _hashes(points, size)
                at = np.flatnonzero(ends[owner[: len(h)]] - np.arange(len(h)) >= size)
                for p in range(PROBES):
                    slot = _slots(h[at], p, bits)
                    at = at[(bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1]
                found_rows += rows[owner[at]].tolist()
                found += [whole[k:k + size] for k in at.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(found_rows, pa.int64()), pa.array(found, pa.string())], ["row", "word"])

    return texts.where("data is not null").select("row", "data").mapInArrow(run, "row long, word string")
