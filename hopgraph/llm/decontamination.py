"""Benchmark decontamination with a BM25 inverted index and block-max WAND.

The test items are the indexed side. Every training document is cut into
overlapping passages long enough to hold a whole item, and each passage is a
query that retrieves every item whose BM25 score is at least ``THRESHOLD`` of the
score the item gives itself. Weights are divided by that threshold, so an item
is retrieved at 1.

Items are numbered, and every term has its postings in order of items, with the
largest weight in the whole list and in each block of ``BLOCK`` items. A passage
has a cursor in the list of each of its terms. Sorted by the items they stand at,
the cursors' list maxima are summed up to the pivot, the first item that can reach
1. If the maxima of the pivot's block cannot reach it, the cursors skip behind the
block; else the item is scored, or the cursors before it move up to it.
Retrieved items are verified by the words and shingles they share with the
passage: the whole item's, and its answer's (its last sentence).

Most passages have no item at all, and that is seen for many at once: a term is
essential in a block unless it belongs to the commonest terms of each of its
items, whose weights together stay below the threshold. Only passages whose
essential terms' block maxima and the rest can reach 1 in some block are searched.

The index is made of shards of bounded size, each broadcast in turn; statistics
are those of all items.

Defined results: null or empty texts match nothing, and null, empty or wordless
items are never found; items with equal text are all reported; rows repeated
with one id report once; items and documents without an id take part like others
and are reported with a null id; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopgraph.llm.common import read_table, text_of, written

K1, B = 1.2, 0.75
THRESHOLD = 0.5
#: Share of the threshold that a block's inessential terms may have; below 1.
MAX_REST = 0.5
BLOCK = 8
SHINGLE = 5
MIN_OVERLAP = 0.8
MIN_ANSWER = 0.5
MIN_PASSAGE = 64
#: Characters of items in a shard of the index.
SHARD_CHARS = 8_000_000
#: Words of documents that are looked at together.
CHUNK_WORDS = 1 << 18
TOKEN = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def answer_tokens(text: str) -> list[str]:
    """The last sentence of an item; all of it if there is only one."""
    parts = [t for s in SENTENCE.split(text.strip()) if (t := tokens(s))]
    return parts[-1] if parts else []


def shingles(words: list[str], n: int = SHINGLE) -> set:
    n = min(n, len(words))
    return set(zip(*(words[k:] for k in range(n)))) if n else set()


class ItemIndex:
    """One shard: items (id, text), and of all items their number, mean length and document frequencies."""

    def __init__(self, items, n_items: int, mean_length: float, frequency: dict[str, int]):
        self.items = sorted(((len(w), i, w, answer_tokens(t)) for i, t in items if (w := tokens(t))), key=lambda x: (x[0], x[1]))
        self.passage = max(MIN_PASSAGE, 2 * max((x[0] for x in self.items), default=0))
        idf = {t: math.log(1 + (n_items - n + 0.5) / (n + 0.5)) for t, n in frequency.items()}
        self.weights = []
        for length, _, words, _ in self.items:
            norm = K1 * (1 - B + B * length / mean_length)
            weights = {t: idf[t] * f * (K1 + 1) / (f + norm) for t, f in Counter(words).items()}
            enough = THRESHOLD * sum(weights.values())
            self.weights.append({t: w / enough for t, w in weights.items()})
        self.vocabulary: dict[str, int] = {}
        lists: list[dict[int, float]] = []
        self.rest = np.zeros(-(-len(self.items) // BLOCK))
        for k, weights in enumerate(self.weights):
            block, rest = k // BLOCK, 0.0
            for t, w in sorted(weights.items(), key=lambda x: (idf[x[0]], x[0])):
                if rest + w < MAX_REST:
                    rest += w
                    continue
                at = self.vocabulary.setdefault(t, len(lists))
                if at == len(lists):
                    lists.append({})
                lists[at][block] = max(w, lists[at].get(block, 0.0))
            self.rest[block] = max(rest, self.rest[block])
        self.sizes = np.array([len(x) for x in lists], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blocks = np.array([b for x in lists for b in x], np.int64)
        self.maxima = np.array([w for x in lists for w in x.values()])
        postings = defaultdict(list)
        for k, weights in enumerate(self.weights):
            for t, w in weights.items():
                postings[t].append((k, w))
        #: By term: items, weights, the largest weight by block and of all.
        self.postings = {}
        for t, found in postings.items():
            blocks: dict[int, float] = {}
            for k, w in found:
                blocks[k // BLOCK] = max(w, blocks.get(k // BLOCK, 0.0))
            self.postings[t] = [k for k, _ in found], [w for _, w in found], blocks, max(blocks.values())

    def retrieve(self, terms) -> list[tuple[int, float]]:
        """(item, score) of all items that the distinct terms give a score of 1 or more, by block-max WAND."""
        need = 1 - 1e-6
        # A cursor: items, weights, block maxima, list maximum, place in the list.
        cursors = [[*self.postings[t], 0] for t in terms if t in self.postings]
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0][c[4]])
            bound, pivot = 0.0, None
            for k, c in enumerate(cursors):
                bound += c[3]
                if bound >= need:
                    pivot = c[0][c[4]]
                    break
            if pivot is None:
                return found
            while k + 1 < len(cursors) and cursors[k + 1][0][cursors[k + 1][4]] == pivot:
                k += 1
            block, near = pivot // BLOCK, cursors[:k + 1]
            if sum(c[2].get(block, 0.0) for c in near) < need:
                target = (block + 1) * BLOCK
                if k + 1 < len(cursors):
                    target = min(target, cursors[k + 1][0][cursors[k + 1][4]])
            elif cursors[0][0][cursors[0][4]] == pivot:
                score = sum(c[1][c[4]] for c in near)
                if score >= need:
                    found.append((pivot, score))
                target = pivot + 1
            else:
                target = pivot
            for c in near:
                c[4] = bisect_left(c[0], target, c[4])
            cursors = [c for c in cursors if c[4] < len(c[0])]
        return found

    def _passing(self, ids: np.ndarray, passages: np.ndarray) -> list[int]:
        """Passages whose bound reaches 1 in some block, from their essential terms (ids)."""
        pairs = np.unique(passages * len(self.sizes) + ids)
        passages, ids = np.divmod(pairs, len(self.sizes))
        sizes = self.sizes[ids]
        at = np.repeat(self.starts[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        keys = np.repeat(passages, sizes) * len(self.rest) + self.blocks[at]
        order = np.argsort(keys, kind="stable")
        keys, bounds = keys[order], self.maxima[at][order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sums, keys = np.add.reduceat(bounds, first), keys[first]
        p, b = np.divmod(keys, len(self.rest))
        ok = sums + self.rest[b] >= 1 - 1e-6
        return np.unique(p[ok]).tolist()

    def search(self, texts):
        """For each text its verified items: {place among items: (score, item overlap, answer overlap)}."""
        found = [{} for _ in texts]
        if not self.items:
            return found
        half, get = self.passage // 2, self.vocabulary.get
        chunk, size = [], 0
        for k, text in enumerate(texts):
            words = tokens(text)
            if words:
                chunk.append((k, words))
                size += len(words)
            if size >= CHUNK_WORDS:
                self._search(chunk, half, get, found)
                chunk, size = [], 0
        if chunk:
            self._search(chunk, half, get, found)
        return found

    def _search(self, chunk, half, get, found):
        ids, places, whose, base = [], [], [], 0
        for k, words in chunk:
            known = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
            at = np.flatnonzero(known >= 0)
            ids.append(known[at])
            places.append(base + at // half)
            count = (len(words) - 1) // half + 1
            whose += [(k, words, j) for j in range(count)]
            base += count + 1
            whose.append(None)
        ids, places = np.concatenate(ids), np.concatenate(places)
        if not len(ids):
            return
        # Passage j holds the half-passages j and j + 1.
        ids2, places2 = np.concatenate([ids, ids]), np.concatenate([places, places - 1])
        keep = places2 >= 0
        for p in self._passing(ids2[keep], places2[keep]):
            if whose[p] is None:
                continue
            k, words, j = whose[p]
            passage = words[j * half:(j + 2) * half]
            retrieved = self.retrieve(set(passage))
            if not retrieved:
                continue
            near, have = shingles(passage), Counter(passage)
            for i, score in retrieved:
                own, last = self.items[i][2], Counter(self.items[i][3])
                whole = shingles(own)
                overlap = len(whole & (near if len(own) >= SHINGLE else shingles(passage, len(own)))) / len(whole)
                met = sum((last & have).values()) / max(1, sum(last.values()))
                if overlap >= MIN_OVERLAP and met >= MIN_ANSWER:
                    found[k][i] = max(found[k].get(i, (0, 0, 0)), (score * THRESHOLD, overlap, met))


def index_shards(benchmark: DataFrame, shard_chars: int = SHARD_CHARS):
    """Yield an ItemIndex for each shard of the items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).distinct()

    def terms(batches):
        for batch in batches:
            rows = [(i, t, len(w)) for i, text in zip(*(c.to_pylist() for c in batch.columns)) for w in (tokens(text),) for t in set(w)]
            i, t, n = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(t, pa.string()), pa.array(n, pa.int64())], ["item_id", "term", "length"])

    rows = written(items.mapInArrow(terms, "item_id long, term string, length long"), "item-terms")
    frequency = written(rows.groupBy("term").agg(F.count("*").alias("df")), "item-df")
    lengths = rows.groupBy("item_id").agg(F.max("length").alias("length")).agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    if not lengths.n:
        return
    chars = items.agg(F.sum(F.char_length("text"))).first()[0]
    shards = max(1, -(-chars // shard_chars))
    shard = F.pmod(F.xxhash64("item_id"), F.lit(shards))
    for s in range(shards):
        own = [(r.item_id, r.text) for r in items.where(shard == s).collect()]
        used = rows.where(shard == s).select("term").distinct()
        yield ItemIndex(own, lengths.n, lengths.mean, {r.term: r.df for r in frequency.join(used, "term").collect()})


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, item_overlap, answer_overlap), a row per document and item it holds."""
    spark, out = docs.sparkSession, None
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, score double, item_overlap double, answer_overlap double"
    for index in index_shards(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            index = shared.value
            for batch in batches:
                found = index.search(batch.column(1).to_pylist())
                rows = [(d, index.items[i][1], *facts) for d, f in zip(batch.column(0).to_pylist(), found) for i, facts in f.items()]
                columns = list(zip(*rows)) if rows else [()] * 5
                types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                names = ["doc_id", "item_id", "score", "item_overlap", "answer_overlap"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        part = docs.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema)
    best = F.max(F.struct("score", "item_overlap", "answer_overlap")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item."""
    for index in index_shards(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        holds = F.pandas_udf(lambda texts, shared=shared: pd.Series([bool(f) for f in shared.value.search(list(texts))], dtype=bool), "boolean")
        docs = docs.where(~holds(F.col("text")))
    return docs


def op5_decontamination(spark, sf_dir):
    return contaminations(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
