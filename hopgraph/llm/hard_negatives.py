"""Hard negatives by rotated one-bit codes with exact interval filters.

Every vector, as whole numbers, is rotated by one seeded orthogonal matrix; the
signs are its code, a vector x of length one. Stored beside it are its alignment
<v, x> and the length of what is left, r = v - <v, x> x. An anchor q is rotated
too and cut to ``PLANES`` bits a component, so that <q, x> comes from popcounts
of the code with bit planes, up to a known error. Then

    <q, v> = <v, x> <q, x> + <q, r>,   |<q, r>| <= |r| sqrt(|q|^2 - <q, x>^2)

by Cauchy-Schwarz, as r is orthogonal to x. This interval holds for certain (and
is widened for rounding), so pairs that it rules out need no score, and the
results are those of scoring all pairs: survivors are scored in whole numbers.

All rows stand in blocks of ``ROWS``, the anchors in blocks of ``ANCHORS``. Rows
are dealt into slices by block; every block of anchors goes to every slice, where
it meets one block of rows after the other and keeps the best of each anchor. So
a task holds two blocks and a few rows an anchor, and no side is broadcast.

Two passes: the first finds each anchor's positives, the best of its label; the
second the best rows of other labels in each positive's band of scores.

Defined results: rows with a null id, label or vector, or with a null or
non-finite component take no part, nor do those with a component of 2^27 or more
when multiplied by ``SCALE`` (their scores needn't fit a long); fully equal rows
count once; rows that share an id are rows of their own, but are neither
positives nor negatives of each other; ties go to the smaller id; shorter vectors
count as filled up with zeros; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopgraph.llm.common import read_table, written

SCALE, LARGEST = 256, 1 << 27
ROWS, ANCHORS, PLANES, SEED = 2048, 128, 6, 20
#: Up to here sums of products of this many components are exact in doubles.
EXACT = 1 << 53


@lru_cache(maxsize=2)
def rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(SEED).normal(size=(dim, dim)))[0]


def padded(dim: int) -> int:
    return -(-max(dim, 1) // 64) * 64


def rotated(v: np.ndarray) -> np.ndarray:
    dim = padded(v.shape[1])
    wide = np.zeros((len(v), dim))
    wide[:, :v.shape[1]] = v
    return wide @ rotation(dim)


def _bits(on: np.ndarray) -> np.ndarray:
    return np.packbits(on, axis=1).view(np.uint64)


def encoded(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, alignment, length of the rest) of whole-number vectors."""
    y = rotated(v)
    code = y >= 0
    along = np.abs(y).sum(1) / np.sqrt(y.shape[1])
    return _bits(code), along, np.sqrt(np.maximum((y * y).sum(1) - along * along, 0.0))


def intervals(q: np.ndarray, code: np.ndarray, along: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of anchors (rows of q) and coded rows."""
    y = rotated(q)
    dim = y.shape[1]
    low = y.min(1)
    step = np.maximum((y.max(1) - low) / ((1 << PLANES) - 1), 1e-12)
    level = np.rint((y - low[:, None]) / step[:, None]).astype(np.int64)
    error = np.abs(y - low[:, None] - step[:, None] * level).sum(1) / np.sqrt(dim)
    ones = np.bitwise_count(code).sum(1, dtype=np.int64)
    met = np.zeros((len(q), len(code)), np.int64)
    for plane in range(PLANES):
        bits = _bits((level >> plane & 1).astype(bool))
        for w in range(code.shape[1]):
            met += np.bitwise_count(code[None, :, w] & bits[:, w, None]).astype(np.int64) << plane
    # <q, x> of the cut anchor: signs are +1 for ones, -1 for zeros.
    s = (2 * (low[:, None] * ones + step[:, None] * met) - (low * dim + step * level.sum(1))[:, None]) / np.sqrt(dim)
    length = np.sqrt((q.astype(float) ** 2).sum(1))[:, None]
    apart = np.sqrt(np.maximum(length ** 2 - np.maximum(np.abs(s) - error[:, None], 0.0) ** 2, 0.0))
    width = along * error[:, None] + rest * apart + 1e-9 * length * np.hypot(along, rest) + 1e-6
    return along * s - width, along * s + width


def scores(q: np.ndarray, v: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Whole-number inner products of the pairs (a, r)."""
    if not len(a):
        return np.zeros(0, np.int64)
    used, at = np.unique(r, return_inverse=True)
    if q.shape[1] * int(np.abs(q).max(initial=0)) * int(np.abs(v).max(initial=0)) < EXACT:
        return (q.astype(float) @ v[used].T.astype(float))[a, at].astype(np.int64)
    return (q.astype(np.int64) @ v[used].T.astype(np.int64))[a, at]


def guesses(able: np.ndarray, estimate: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k able pairs of each anchor with the highest estimates: scored first, they set the bar for the others."""
    if able.shape[1] > k:
        r = np.argpartition(np.where(able, -estimate, np.inf), k, axis=1)[:, :k]
        a = np.repeat(np.arange(len(able)), k)
        hit = able[a, r.ravel()]
        return a[hit], r.ravel()[hit]
    return np.nonzero(able)


class Best:
    """The k best (score, then smaller id) of each key."""

    def __init__(self, keys: int, k: int):
        self.keys, self.k = keys, k
        self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: The k-th best score of each key, where there are as many.
        self.bar = np.full(keys, -np.inf)

    def add(self, key: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        key, score, ident = (np.concatenate(x) for x in zip(self.rows, (key, score, ident)))
        order = np.lexsort((ident, -score, key))
        key = key[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        keep = order[place < self.k]
        full = order[place == self.k - 1]
        self.rows = key[place < self.k], score[keep], ident[keep]
        self.bar[key[place == self.k - 1]] = score[full]


def prepared(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v: distinct rows that take part, their components as whole numbers."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) >= LARGEST))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v")).distinct()


def blocks(rows: DataFrame, size: int, dim: int, coded: bool) -> DataFrame:
    """Rows packed by the block: block, n, ids, labels, v and, with ``coded``, code, along, rest as bytes."""

    def pack(block, ids, labels, v):
        facts = [block, len(ids), ids.tobytes(), labels.tobytes(), v.tobytes()]
        return facts + [x.tobytes() for x in encoded(v)] if coded else facts

    names = ["block", "n", "ids", "labels", "v", *(["code", "along", "rest"] if coded else [])]
    types = [pa.int64(), pa.int64(), *[pa.binary()] * (len(names) - 2)]

    def run(batches):
        made, held = 0, []
        first = TaskContext.get().partitionId() << 32

        def out(parts):
            ids, labels, v = (np.concatenate(x) for x in zip(*parts))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(pack(first + made, ids, labels, v), types)], names)

        for batch in batches:
            ids, labels = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            lists = batch.column(2)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            v = np.zeros((len(ids), dim), np.int32)
            count = np.diff(at)
            row = np.repeat(np.arange(len(ids)), count)
            v[row, np.arange(at[0], at[-1]) - np.repeat(at[:-1], count)] = flat[at[0]:at[-1]]
            for k in range(0, len(ids), size):
                held.append((ids[k:k + size], labels[k:k + size], v[k:k + size]))
                while sum(len(p[0]) for p in held) >= size:
                    ids_, labels_, v_ = (np.concatenate(x) for x in zip(*held))
                    yield out([(ids_[:size], labels_[:size], v_[:size])])
                    made += 1
                    held = [(ids_[size:], labels_[size:], v_[size:])]
        if sum(len(p[0]) for p in held):
            yield out(held)

    schema = "block long, n long, ids binary, labels binary, v binary" + (", code binary, along binary, rest binary" if coded else "")
    return written(rows.mapInArrow(run, schema), "negative-blocks")


def met(anchors: DataFrame, index: DataFrame, slices: int) -> DataFrame:
    """Every block of anchors with every block of rows, by slice; in a slice a block of anchors meets all blocks of rows in turn."""
    a = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns], F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    r = index.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int"))
    return a.hint("merge").join(r, "slice").drop("slice")


def _array(value, dtype, width: int = 0) -> np.ndarray:
    out = np.frombuffer(value.as_buffer(), dtype)
    return out.reshape(-1, width) if width else out


def _anchors_of(row: dict, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _array(row["a_ids"], np.int64), _array(row["a_labels"], np.int64), _array(row["a_v"], np.int32, dim)


def _rows_of(row: dict, dim: int) -> tuple:
    coded = _array(row["code"], np.uint64, padded(dim) // 64), _array(row["along"], float), _array(row["rest"], float)
    return _array(row["ids"], np.int64), _array(row["labels"], np.int64), _array(row["v"], np.int32, dim), coded


def _streamed(batches, start, meet, finish):
    """For pairs of blocks in a row that have the same anchors: start a state, meet all rows, finish."""
    now, state = None, None
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(c)[k] for c, name in enumerate(batch.schema.names)}
            block = row["a_block"].as_py()
            if block != now:
                if now is not None:
                    yield finish(now, state)
                now, state = block, start(row)
            meet(row, state)
    if now is not None:
        yield finish(now, state)


def best_of_label(pairs: DataFrame, dim: int, k: int) -> DataFrame:
    """block, anchor (its place in the block), anchor_id, positive_id, positive_score: the best k of the anchor's label in each slice."""

    def start(row):
        return Best(row["a_n"].as_py(), k), *_anchors_of(row, dim)

    def meet(row, state):
        best, a_ids, a_labels, q = state
        ids, labels, v, coded = _rows_of(row, dim)
        able = (a_labels[:, None] == labels) & (a_ids[:, None] != ids)
        low, high = intervals(q, *coded)
        a, r = guesses(able, low + high, k)
        best.add(a, scores(q, v, a, r), ids[r])
        able[a, r] = False
        a, r = np.nonzero(able & (high >= best.bar[:, None]))
        best.add(a, scores(q, v, a, r), ids[r])

    def finish(block, state):
        key, score, ident = state[0].rows
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.full(len(key), block), key, state[1][key], ident, score)], ["block", "anchor", "anchor_id", "positive_id", "positive_score"])

    out = pairs.mapInArrow(lambda batches: _streamed(batches, start, meet, finish), "block long, anchor long, anchor_id long, positive_id long, positive_score long")
    place = F.expr("row_number() OVER (PARTITION BY block, anchor ORDER BY positive_score DESC, positive_id)")
    return out.withColumn("place", place.cast("int")).where(F.col("place") <= k)


def best_in_bands(pairs: DataFrame, dim: int, k: int, least: int, most: int) -> DataFrame:
    """block, place of the positive, negative_id, negative_score: in each slice the best k of other labels with least <= 100 score / positive score <= most.

    The anchors' blocks carry a_of and a_goal: the anchor and the score of each of their positives.
    """

    def start(row):
        of, goal = (np.array(row[c].as_py(), np.int64) for c in ("a_of", "a_goal"))
        # least goal <= 100 score <= most goal in whole numbers.
        return Best(len(of), k), *_anchors_of(row, dim), of, -(-least * goal // 100), most * goal // 100

    def meet(row, state):
        best, a_ids, a_labels, q, of, floor, roof = state
        ids, labels, v, coded = _rows_of(row, dim)
        low, high = intervals(q, *coded)
        able = (a_labels[:, None] != labels) & (a_ids[:, None] != ids)
        # The positives of an anchor, which stand together, one after the other.
        order = np.arange(len(of)) - np.searchsorted(of, of)
        turns = [np.flatnonzero(order == nth) for nth in range(int(order.max(initial=-1)) + 1)]

        def take(wanted):
            a, r = np.nonzero(wanted & able)
            able[a, r] = False
            score, bar = scores(q, v, a, r), np.maximum(floor, best.bar)
            for p in turns:
                band = np.full(len(a_ids), -1)
                band[of[p]] = p
                key = band[a]
                at = np.flatnonzero((key >= 0) & (score <= roof[key]) & (score >= bar[key]))
                best.add(key[at], score[at], ids[r[at]])

        wanted = np.zeros_like(able)
        for p in turns:
            a, r = guesses(able[of[p]] & (low[of[p]] + high[of[p]] <= 2 * roof[p, None]), (low + high)[of[p]], k)
            wanted[of[p][a], r] = True
        take(wanted)
        wanted[:] = False
        bar = np.maximum(floor, best.bar)
        for p in turns:
            wanted[of[p]] |= (high[of[p]] >= bar[p, None]) & (low[of[p]] <= roof[p, None])
        take(wanted)

    def finish(block, state):
        key, score, ident = state[0].rows
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.full(len(key), block), key, ident, score)], ["block", "goal", "negative_id", "negative_score"])

    out = pairs.mapInArrow(lambda batches: _streamed(batches, start, meet, finish), "block long, goal long, negative_id long, negative_score long")
    rank = F.expr("row_number() OVER (PARTITION BY block, goal ORDER BY negative_score DESC, negative_id)")
    return out.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(embeddings: DataFrame, is_anchor, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on vec_id. The positives of an anchor are its best rows of the same label; the
    negatives of a positive the best rows of other labels with a score of ``least`` to ``most`` percent of its own.
    """
    spark = embeddings.sparkSession
    rows = written(prepared(embeddings, scale), "negative-rows")
    dim = rows.agg(F.max(F.size("v"))).first()[0]
    if dim is None:
        return spark.createDataFrame([], MINED)
    dim = max(dim, 1)
    index = blocks(rows, ROWS, dim, coded=True)
    anchors = blocks(rows.where(is_anchor), ANCHORS, dim, coded=False)
    slices = max(1, min(index.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = written(best_of_label(met(anchors, index, slices), dim, positives), "negative-positives")
    # Positives of one block: at most ANCHORS times ``positives`` of them.
    goals = found.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("anchor", "place", "positive_score"))).alias("goals"))
    goals = goals.select("block", F.col("goals.anchor").alias("of"), F.col("goals.positive_score").alias("goal"))
    bands = best_in_bands(met(written(anchors.join(goals, "block"), "negative-anchors"), index, slices), dim, negatives, least, most)
    numbered = found.withColumn("goal", F.expr("row_number() OVER (PARTITION BY block ORDER BY anchor, place)").cast("long") - 1)
    return bands.join(numbered, ["block", "goal"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir):
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


OP12_SQL = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND NOT coalesce(list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))), false)),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score FROM e a JOIN e r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score QUALIFY rank <= 5"""
