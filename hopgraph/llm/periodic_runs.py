"""Periodic runs of words: maximal stretches in which a phrase repeats at once.

A run is a stretch of consecutive words with smallest period q and at least
``EXPONENT`` periods and ``LEAST`` words that no neighbouring word extends.
Every such run has a Lyndon root: in one of the two orders of the alphabet the
longest Lyndon word from some place of its first period on has the length q. So
the longest Lyndon words from every place, in both orders, are all candidates,
two for each place. They are extended to the right by the longest common
extension in the suffix tree of the words and to the left by that in the tree of
the reversal: Ukkonen's trees, whose lowest common ancestors come from an Euler
tour in constant time. All of it takes time in proportion to the text (the table
of minima a logarithm more of memory).

In a run every word occurs EXPONENT times at least, so a word that occurs less
often cuts a text into stretches that are searched on their own, and does so
again within a stretch (``stretches``). Nothing is lost by that, and trees are
built only where words repeat. One text is one task's work, as its words must be
seen together.

Defined results: null and empty texts and texts without words have no runs, and
nothing to drop; a word dropped for one run is dropped, whatever other runs say;
rows that repeat an id are rows of their own; null ids are kept; an empty table
gives an empty result; other columns are ignored, and kept by ``collapse_runs``.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopgraph.llm.common import WORD, read_table, text_of
from hopgraph.llm.suffix_tree import Extensions, next_smaller

LEAST, EXPONENT = 6, 4
#: How often stretches are cut again; what isn't cut is searched whole.
CUTS = 8
WORDS = re.compile(WORD)


def stretches(words: list[str], exponent: int, least: int) -> list[tuple[int, int]]:
    """Places (from, to) of the stretches that can hold a run: between words that occur fewer than ``exponent`` times."""
    found, waiting = [], [(0, len(words), CUTS)]
    while waiting:
        a, b, cuts = waiting.pop()
        count = Counter(words[a:b])
        rare = [k for k, w in enumerate(words[a:b], a) if count[w] < exponent]
        if not rare or not cuts:
            found.append((a, b))
            continue
        last = a
        for k in [*rare, b]:
            if k - last >= least:
                waiting.append((last, k, cuts - 1))
            last = k + 1
    return sorted(s for s in found if s[1] - s[0] >= least)


def _runs_of(seq: list[int], symbols: int, least: int, exponent: int) -> set[tuple[int, int, int]]:
    n = len(seq)
    ahead = Extensions(seq, symbols, both_orders=True)
    places, periods, reach = [], [], []
    for rank in (ahead.rank, ahead.other_rank):
        p = next_smaller(rank) - np.arange(n, dtype=np.int32)
        i = np.flatnonzero(p * exponent <= n)
        # The first root of a run starts within its first period.
        f = ahead(i, i + p[i])
        far = f >= p[i] * (exponent - 2)
        places.append(i[far])
        periods.append(p[i][far])
        reach.append(f[far])
    i, p, f = (np.concatenate(x).astype(np.int64) for x in (places, periods, reach))
    if not len(i):
        return set()
    back = Extensions(seq[::-1], symbols)(n - i, n - i - p)
    start, length = i - back, back + p + f
    good = (length >= least) & (length >= exponent * p)
    return set(zip(start[good].tolist(), length[good].tolist(), p[good].tolist()))


def runs_of(words: list[str], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``exponent`` (two or more) periods, by start, then period."""
    out = []
    for a, b in stretches(words, exponent, least):
        number: dict[str, int] = {}
        seq = [number.setdefault(w, len(number) + 1) for w in words[a:b]]
        out += [(a + s, n, p) for s, n, p in _runs_of(seq, len(number) + 1, least, exponent)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """Words but those that a run holds after its first period."""
    if not runs:
        return words
    change = [0] * (len(words) + 1)
    for s, n, p in runs:
        change[s + p] += 1
        change[s + n] -= 1
    out, inside = [], 0
    for w, c in zip(words, change):
        inside += c
        if not inside:
            out.append(w)
    return out


def longest_in_periods(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most periods, exactly compared; the first by start, then period on ties."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, start, length, period, phrase: a row for each run; words are numbered from 0 and the phrase is one period of them."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = WORDS.findall(text)
                rows += [(doc_id, s, n, p, " ".join(words[s:s + p])) for s, n, p in runs_of(words, least, exponent)]
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 4, pa.string()))], ["doc_id", "start", "length", "period", "phrase"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, start long, length long, period long, phrase string")


def collapse_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """docs, all columns, with one period left of every run; texts with runs get single blanks, the others stay as they are."""

    def clean(text: str | None) -> str | None:
        words = WORDS.findall(text or "")
        runs = runs_of(words, least, exponent)
        return " ".join(kept_words(words, runs)) if runs else text

    return docs.withColumn("text", F.pandas_udf(lambda texts: pd.Series([clean(t) for t in texts], dtype=object), "string")(F.col("text")))


def looped(words: list[str], doc_id: int | None) -> list[str]:
    """What op13 looks at: in one of ten documents, by its id, the words from some place on repeat; a null id changes nothing."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


FIELDS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _digest(doc_id: int | None, text: str) -> tuple:
    words = looped(WORDS.findall(text), doc_id)
    runs = runs_of(words)
    best = longest_in_periods(runs)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    kept = " ".join(kept_words(words, runs))
    facts = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *facts, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode("utf-8", "replace")).hexdigest()


def op13_periodic_runs(spark, sf_dir):
    def run(batches):
        for batch in batches:
            rows = [_digest(i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            columns = list(zip(*rows)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k > 5 else pa.int64()) for k, c in enumerate(columns)], [f.split()[0] for f in FIELDS.split(", ")])

    docs = read_table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, FIELDS)
