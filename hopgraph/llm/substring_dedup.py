"""Substring de-duplication with repeated-phrase automata.

A window is ``WINDOW`` consecutive words. Of every word sequence that windows
repeat, the first occurrence (smallest id, then earliest start) stays; words that
any other occurrence covers are removed.

1. *Confirm recurring passages.* Every window has an anchor, the smallest hash of
   its ``GRAM``-word phrases; equal windows have equal anchors. Only anchors,
   about one in seven words, are counted over the corpus. Those found twice or
   more make a bitmap of bounded size, and only windows whose anchor is in it can
   recur. (A bitmap that is too small lets more windows through, never fewer.)
2. *Stream all documents.* Runs of such windows with one anchor, at most
   ``REACH`` windows, are passages. Each goes with its words to the shard of its
   anchor, equal ones of a chunk of documents once. An anchor that very many
   passages have would make a large shard, so its windows go one by one to the
   shards of their own hashes (a second bitmap tells such anchors).
3. *Sharded automata.* A shard counts its windows, compiles those found twice or
   more into an Aho-Corasick automaton over words (each word by a number of the
   shard's own, so words are compared and not hashes), and searches all of its
   passages. Of the places where a window is located the first is kept; a window
   that isn't located is found nowhere else.
4. Kept starts go back to their documents, where every other window that can
   recur is removed.

Defined results: null or empty texts have no words; texts shorter than a window
lose nothing; null ids come after all others; rows that share an id are one
document, and equal starts in it are one occurrence; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopgraph.llm.common import read_table, text_of, written
from hopgraph.llm.word_hash import chunks, gram_hashes, mixed, sliding, word_hashes

WINDOW, GRAM = 20, 8
REACH = WINDOW - GRAM + 1
BITMAP_BITS = 32768
MAX_FILTER_BITS, BITS_PER_ANCHOR = 2**29, 16
#: Bytes of text handled at once, passages in one shard on average, and passages of one anchor from which it is spread.
CHUNK_BYTES, SHARD, SPREAD = 1 << 20, 4000, 1000
#: Stands for a null id: after all others.
NO_ID = 2**63 - 1


def inside(places: np.ndarray, n: int) -> np.ndarray:
    """Whether the WINDOW words from each word on are of one text."""
    whose = np.repeat(np.arange(len(places) - 1), np.diff(places))
    return whose[:n] == whose[WINDOW - 1:WINDOW - 1 + n]


def window_anchors(words: np.ndarray, places: np.ndarray):
    """(anchors' hashes at their words, anchor of each window, whether the window is whole)."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    grams = gram_hashes(words, GRAM)
    whole = inside(places, n)
    least = sliding(grams, REACH, np.minimum)
    # A word is an anchor if a whole window that reaches it has its hash as the least.
    pad = np.zeros(REACH - 1, np.uint64)
    reach = sliding(np.concatenate([pad, np.where(whole, least, 0), pad]), REACH, np.maximum)
    return grams[(reach == grams) & (reach > 0)], least, whole


class AnchorFilter:
    """A bitmap of anchor hashes, probed at two places."""

    def __init__(self, bits: int, rows):
        self.mask = np.uint64(bits - 1)
        self.bytes = np.zeros(bits // 8, np.uint8)
        for bucket, bitmap in rows:
            self.bytes[bucket * BITMAP_BITS // 8:(bucket + 1) * BITMAP_BITS // 8] = np.frombuffer(bitmap, np.uint8)


    def _bit(self, slots):
        return (self.bytes[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        return (self._bit(hashes & self.mask) & self._bit((hashes >> np.uint64(32)) & self.mask)).astype(bool)


def count_anchors(docs: DataFrame) -> DataFrame:
    """(h, n): the anchors that are found twice or more in the corpus, and how often."""

    def run(batches):
        for batch in batches:
            for begin, end in chunks(batch.column(0), CHUNK_BYTES * 16):
                found = []
                for a, b in chunks(batch.column(0).slice(begin, end - begin), CHUNK_BYTES):
                    found.append(window_anchors(*word_hashes(batch.column(0).slice(begin + a, b - a)))[0])
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int32))], ["h", "n"])

    anchors = docs.select("text").mapInArrow(run, "h long, n int").groupBy("h").agg(F.sum("n").alias("n"))
    return written(anchors.where("n > 1"), "recurring-anchors")


def anchor_filter(anchors: DataFrame) -> AnchorFilter:
    bits = min(MAX_FILTER_BITS, max(2**20, 2 ** math.ceil(math.log2(max(1, anchors.count()) * BITS_PER_ANCHOR))))
    slots = F.array(F.col("h").bitwiseAND(bits - 1), F.shiftrightunsigned("h", 32).bitwiseAND(bits - 1))
    slots = anchors.select(F.explode(slots).alias("slot"))
    bitmaps = slots.groupBy(F.expr(f"slot div {BITMAP_BITS}").alias("bucket")).agg(F.bitmap_construct_agg(F.col("slot") % BITMAP_BITS).alias("bitmap"))
    # At most MAX_FILTER_BITS / 8 bytes, whatever the corpus.
    return AnchorFilter(bits, ((r.bucket, bytes(r.bitmap)) for r in bitmaps.toLocalIterator()))


def candidate_starts(words: np.ndarray, places: np.ndarray, known: AnchorFilter) -> tuple[np.ndarray, np.ndarray]:
    """Words at which a window starts that may recur, and the windows' anchors."""
    _, least, whole = window_anchors(words, places)
    at = np.flatnonzero(whole & known.may_hold(least)) if len(least) else np.zeros(0, np.int64)
    return at, least[at]


def passages(words: np.ndarray, places: np.ndarray, known: AnchorFilter, spread: AnchorFilter):
    """(text's number, first start, starts, hash that tells the shard) of each run of windows that may recur and have one anchor."""
    at, anchors = candidate_starts(words, places, known)
    doc = np.searchsorted(places, at, "right") - 1
    wide = spread.may_hold(anchors)
    same = (np.diff(at) == 1) & (np.diff(doc) == 0) & (anchors[1:] == anchors[:-1]) & ~wide[1:]
    first = np.flatnonzero(np.r_[True, ~same]) if len(at) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(at)])
    # Runs longer than REACH (a phrase said again and again) are cut.
    pieces = -(-size // REACH)
    piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(first, pieces) + piece * REACH
    size = np.minimum(REACH, np.repeat(size, pieces) - piece * REACH)
    whole = gram_hashes(words, WINDOW)
    key = np.where(wide[begin], whole[at[begin]], anchors[begin]) if len(at) else anchors
    return doc[begin], at[begin] - places[doc[begin]], size, mixed(key + np.uint64(WINDOW))


def shard_rows(docs: DataFrame, known, spread, shards: int) -> DataFrame:
    """(shard, words, d, p, n): all passages of all documents with their words; equal ones of a chunk once, at the first place."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1)
            for begin, end in chunks(texts, CHUNK_BYTES * 4):
                found: dict[bytes, list] = {}
                for a, b in chunks(texts.slice(begin, end - begin), CHUNK_BYTES):
                    part = texts.slice(begin + a, b - a)
                    doc, start, size, key = passages(*word_hashes(part), known.value, spread.value)
                    shard = (key % np.uint64(shards)).astype(np.int64)
                    last, own = -1, []
                    for k, p, n, s in zip(doc.tolist(), start.tolist(), size.tolist(), shard.tolist()):
                        if k != last:
                            last, own = k, part[k].as_py().encode("utf-8", "replace").split()
                        place = (int(ids[begin + a + k]), p)
                        seen = found.setdefault(b" ".join(own[p:p + n + WINDOW - 1]), [s, place, 0])
                        seen[1], seen[2] = min(seen[1], place), seen[2] + 1
                s, at, n = zip(*found.values()) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s, pa.int64()), pa.array(list(found), pa.binary()), pa.array([x[0] for x in at], pa.int64()), pa.array([x[1] for x in at], pa.int32()), pa.array(n, pa.int32())],
                    ["shard", "words", "d", "p", "n"],
                )

    return docs.mapInArrow(run, "shard long, words binary, d long, p int, n int")


def recurring_windows(sequences: list[tuple[int, ...]], times: list[int]) -> list[tuple[int, ...]]:
    """The windows of the sequences that are found twice or more, counted by hash; each as often as its hash has other words."""
    flat = np.fromiter(itertools.chain.from_iterable(sequences), np.uint64)
    sizes = np.fromiter(map(len, sequences), np.int64)
    starts = np.cumsum(sizes) - sizes
    count = sizes - WINDOW + 1
    whose = np.repeat(np.arange(len(sizes)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    hashes = gram_hashes(flat + np.uint64(1), WINDOW)[starts[whose] + offset]
    _, place, total = np.unique(hashes, return_inverse=True, return_counts=True)
    total = np.bincount(place, np.asarray(times)[whose]) if len(place) else total
    return list({sequences[k][o:o + WINDOW] for k, o in zip(*(x[total[place] > 1].tolist() for x in (whose, offset)))})


def located(sequences: list[tuple[int, ...]], windows: list[tuple[int, ...]]):
    """(sequence, start, window) of every place where the automaton of the windows finds one of them."""
    if not windows:
        return
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for k, window in enumerate(windows):
        automaton.add_word(window, k)
    automaton.make_automaton()
    for k, sequence in enumerate(sequences):
        for last, window in automaton.iter(sequence):
            yield k, last - WINDOW + 1, window


def first_places(rows: list[tuple[bytes, int, int, int]]) -> list[tuple[int, int]]:
    """rows (words, d, p, n) of one shard -> (d, p) of the first occurrence of every distinct window."""
    found: dict[bytes, list] = {}
    for words, d, p, n in rows:
        seen = found.setdefault(words, [(d, p), 0])
        seen[0], seen[1] = min(seen[0], (d, p)), seen[1] + n
    number = defaultdict(itertools.count().__next__)
    sequences = [tuple(number[w] for w in words.split(b" ")) for words in found]
    places = [at for at, _ in found.values()]
    windows = recurring_windows(sequences, [n for _, n in found.values()])
    first: list = [None] * len(windows)
    hit = [set() for _ in sequences]
    for k, start, window in located(sequences, windows):
        hit[k].add(start)
        at = (places[k][0], places[k][1] + start)
        if first[window] is None or at < first[window]:
            first[window] = at
    alone = [(d, p + o) for sequence, (d, p), met in zip(sequences, places, hit) for o in range(len(sequence) - WINDOW + 1) if o not in met]
    return [at for at in first if at] + alone


def first_occurrences(docs: DataFrame, known, spread, n_passages: int) -> DataFrame:
    """(doc_id, starts): of every distinct window that may recur the first occurrence, by document."""
    shards = max(1, -(-n_passages // SHARD))

    def run(batches):
        # Rows come sorted by shard; one shard is held at a time.
        shard, rows = None, []
        for batch in itertools.chain(batches, [None]):
            out = []
            for s, *row in zip(*(c.to_pylist() for c in batch.columns)) if batch else [(None,)]:
                if s != shard and rows:
                    out += first_places(rows)
                    rows = []
                shard = s
                if batch:
                    rows.append(row)
            d, p = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(p, pa.int32())], ["d", "p"])

    rows = shard_rows(docs, known, spread, shards).repartition("shard").sortWithinPartitions("shard")
    return rows.mapInArrow(run, "d long, p int").groupBy(F.col("d").alias("id")).agg(F.collect_list("p").alias("starts"))


def covered_words(words: np.ndarray, places: np.ndarray, kept: np.ndarray, known: AnchorFilter) -> np.ndarray:
    """Which words the repeated windows cover; ``kept``: words at which a window starts that is a first occurrence."""
    at = np.setdiff1d(candidate_starts(words, places, known)[0], kept)
    mark = np.zeros(len(words) + 1, np.int64)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + WINDOW, -1)
    return np.cumsum(mark[:-1]) > 0


def repeated_passages(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed, kept_text."""
    spark = docs.sparkSession
    thin = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text_of().alias("text"))
    anchors = count_anchors(thin)
    # A hot anchor is told by its count alone, so all its windows are spread alike.
    shared, spread = (spark.sparkContext.broadcast(anchor_filter(a)) for a in (anchors, anchors.where(F.col("n") > SPREAD)))
    total = anchors.agg(F.sum("n")).first()[0] or 0
    firsts = written(first_occurrences(thin, shared, spread, total), "first-windows").withColumnRenamed("id", "of")
    rows = thin.join(firsts.hint("merge"), F.col("id") == F.col("of"), "left").select("id", "text", "starts")

    def run(batches):
        for batch in batches:
            for begin, end in chunks(batch.column(1), CHUNK_BYTES):
                part = batch.slice(begin, end - begin)
                words, places = word_hashes(part.column(1))
                lists = part.column(2)
                owner = np.repeat(np.arange(len(part)), lists.value_lengths().fill_null(0).to_numpy())
                kept = lists.flatten().to_numpy() + places[owner]
                kept = kept[kept < places[owner + 1]]
                gone = covered_words(words, places, kept, shared.value)
                out = []
                for text, a, b in zip(part.column(1).to_pylist(), places[:-1].tolist(), places[1:].tolist()):
                    own = text.encode("utf-8", "replace").split()
                    lost = int(gone[a:b].sum())
                    if lost:
                        own = list(itertools.compress(own, ~gone[a:b]))
                    out.append((b - a, lost, b" ".join(own).decode("utf-8")))
                n, lost, texts = zip(*out)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(texts, pa.string())], ["id", "n_words", "n_removed", "kept_text"])

    done = rows.mapInArrow(run, "id long, n_words long, n_removed long, kept_text string")
    return done.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept_text")


def op7_substring_dedup(spark, sf_dir):
    done = repeated_passages(read_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
