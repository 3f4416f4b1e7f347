"""Near-duplicate detection by SimHash with pigeonhole blocks.

Fingerprints have 64 bits in six blocks. Two that differ in at most three bits
agree on at least three whole blocks, so every close pair shares one of the 20
choices of three blocks. Distinct fingerprints are joined on those (about 32
bits each, so chance meetings stay rare) and pairs in a shared cell are verified
by Hamming distance. A cell that many fingerprints share is cut into chunks, and
each pair of chunks is its own group, so every pair is still compared but no
group is large. A cell gives the links of a spanning forest of its close pairs,
not all pairs: as many as fingerprints at most, with the same components.

Defined results: null text counts as empty; texts without words have fingerprint
zero and are linked like others; a null id never names a component while
another id is in it; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopgraph.llm.common import read_table, written
from hopgraph.llm.components import components
from hopgraph.llm.near_copies import drop_near_duplicates  # noqa: F401  (the pipeline's stage)

SHINGLE = 3
SEED = 42
MAX_BITS = 3
BLOCKS = (11, 11, 11, 11, 10, 10)
CELL = 1024
PIECE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a whole text as a signed 64-bit integer; long texts go in pieces."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    counts, total, digest = np.zeros(64, np.int64), 0, xxhash.xxh64_intdigest
    shingles = iter(shingles)
    while piece := [digest(s, SEED) for s in itertools.islice(shingles, PIECE)]:
        bits = np.unpackbits(np.array(piece, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
        total += len(piece)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp of every document."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, fp long")


def block_masks(agree: int = len(BLOCKS) - MAX_BITS) -> list[int]:
    """For each choice of blocks the mask of their bits, signed."""
    starts = np.cumsum((0, *BLOCKS))
    masks = []
    for chosen in itertools.combinations(range(len(BLOCKS)), agree):
        mask = sum(((1 << BLOCKS[i]) - 1) << int(starts[i]) for i in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def close_forest(values: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links (a, b) of a spanning forest of the pairs that differ in few bits, each b the smallest of its tree."""
    values = np.unique(values)
    bits = values.view(np.uint64)
    tree = np.arange(len(values))
    for i in range(len(values) - 1):
        near = np.flatnonzero(np.bitwise_count(bits[i + 1:] ^ bits[i]) <= max_bits) + i + 1
        if len(near):
            met = np.unique(np.append(tree[near], tree[i]))
            if len(met) > 1:
                tree[np.isin(tree, met)] = met[0]
    moved = np.flatnonzero(tree != np.arange(len(values)))
    return [(int(values[i]), int(values[tree[i]])) for i in moved]


def close_links(fps: DataFrame, cell: int = CELL) -> DataFrame:
    """fps(fp), distinct -> links (a, b) with the components of all pairs within MAX_BITS bits."""
    keys = F.array(*[F.struct(F.lit(k).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(block_masks())])
    cells = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    shared = cells.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(shared.select("t", "key", F.ceil(F.col("n") / cell).cast("int").alias("chunks")), "simhash-cells")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    rows = (
        cells.join(shared, ["t", "key"]).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("t", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    )
    groups = rows.groupBy("t", "key", "lo", "hi").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1").select("fps")

    def run(batches):
        for batch in batches:
            found = {link for fps in batch.column(0) for link in close_forest(fps.values.to_numpy())}
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return written(groups.mapInArrow(run, "a long, b long"), "simhash-links").distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id."""
    fps = written(fingerprints(docs), "fingerprints")
    first = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-first")
    labels = components(close_links(first.select("fp")))
    linked = first.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    linked = written(linked, "fingerprint-labels")
    lowest = written(linked.groupBy("label").agg(F.min("first").alias("component_id")), "component-ids")
    # Written, so that both sides are dealt anew and a fingerprint that many rows share can be split over tasks.
    named = written(linked.join(lowest, "label").select("fp", "component_id"), "fingerprint-components")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash(spark, sf_dir):
    return near_groups(read_table(spark, sf_dir, "documents"))
