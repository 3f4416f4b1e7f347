"""Language-model scoring with a hashed maximum-entropy model.

The vocabulary is counted over all training documents and grows with them. Words
with at least one in ``HOT_SHARE`` of all tokens are hot (so there are at most
that many); they are dealt to classes of about equal weight, and all other words,
unknown ones too, make the last class. A token's probability is that of its class
given the tokens before it times its own within the class. The class factor is a
softmax over hashed features of whatever words stand before, hot or not: the word
before, the two before, and the one before that alone (skip). The word factor is
a softmax without features, whose likeliest weights are the logarithms of the
counts, so it is taken from the counts and not climbed to.

Class weights are trained by distributed gradient updates: in every round each
partition of the round's documents takes Adagrad steps from the shared weights,
and the steps are averaged by tokens, bucket by bucket, in Spark. Every training
document is in one round. Steps are local to partitions, so another layout of the
input gives slightly other weights. The table of weights has a fixed size, so it
is broadcast; counts of words that aren't hot are joined with the documents' words.

Defined results: null and empty texts have one token, the end; null ids are never
held out; rows repeated with one id are learnt from and scored separately; with
no training documents every token is unknown; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopgraph.llm.common import read_table, text_of, written
from hopgraph.llm.word_hash import chunks, mixed, word_hashes

FOLDS = 10
HOT_SHARE = 1 << 17
CLASSES = 32
BUCKETS = 1 << 14
ROUNDS = 3
RATE = 0.1
SMOOTH = 0.1
CHUNK_BYTES = 1 << 18
END, BEGIN = (np.uint64(k) for k in (0x0E4D0E4D0E4D0E4D, 0xBE61BE61BE61BE61))


def held_out(id_col: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each text, and where each text's tokens begin (and the last end)."""
    words, places = word_hashes(column, lower=True)
    return np.insert(words, places[1:], END), places + np.arange(len(places))


class MaxEnt:
    """The hot words with their classes and the class weights; the same size for any corpus."""

    def __init__(self, hot: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        order = np.argsort(-counts, kind="stable")
        heads = CLASSES - 1
        upto = np.cumsum(counts[order]) - counts[order] / 2
        classes = np.empty(len(hot), np.int64)
        classes[order] = np.minimum(heads - 1, upto * heads // max(1, counts.sum()))
        sort = np.argsort(hot)
        self.hot, self.classes, counts = hot[sort], classes[sort], counts[sort].astype(float)
        self.total, self.distinct = total, distinct
        weight = np.bincount(self.classes, counts, minlength=CLASSES)
        rare = total - counts.sum()
        #: Of words that aren't hot: the mass that (count + SMOOTH) is divided by, for one unknown word more.
        self.rare_mass = rare + SMOOTH * (distinct - len(hot) + 1)
        self.base_mass = total + SMOOTH * (distinct + 1)
        self.base = np.log10((counts + SMOOTH) / self.base_mass)
        self.within = np.log10(counts / weight[self.classes])
        weight[-1] = rare
        self.bias = np.log((weight + 1) / (weight.sum() + CLASSES)).astype(np.float32)
        self.weights = np.zeros((BUCKETS, CLASSES), np.float32)

    def place(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place among the hot words, whether hot, class) of each token."""
        if not len(self.hot):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool), np.full(len(h), CLASSES - 1)
        at = np.minimum(np.searchsorted(self.hot, h), len(self.hot) - 1)
        hot = self.hot[at] == h
        return at, hot, np.where(hot, self.classes[at], CLASSES - 1)

    @staticmethod
    def features(seen: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
        """Bucket of each hashed feature: word before, both words before, word before that (skip)."""
        one, two = np.empty_like(seen), np.empty_like(seen)
        one[1:], two[2:] = seen[:-1], seen[:-2]
        starts = places[:-1]
        two[starts] = BEGIN
        second = starts + 1
        two[second[second < len(seen)]] = BEGIN
        one[starts] = BEGIN
        salts = [np.uint64(s) for s in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
        mask = np.uint64(BUCKETS - 1)
        return [(mixed(k) & mask).astype(np.int64) for k in (one * salts[0], one * salts[1] + two * salts[2], two + salts[1])]

    def class_probabilities(self, feats: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
        x = weights[feats[0]]
        x += weights[feats[1]]
        x += weights[feats[2]]
        x += self.bias
        x -= x.max(1, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(1, keepdims=True)
        return x

    def steps(self, columns) -> tuple[np.ndarray, int]:
        """Adagrad steps over columns of texts from the shared weights: (weights reached, tokens)."""
        w, seen, n = self.weights.copy(), np.full((BUCKETS, CLASSES), 1e-2, np.float32), 0
        every = np.arange(CLASSES)
        for column in columns:
            h, places = tokens(column)
            target = self.place(h)[2]
            feats = self.features(h, places)
            error = -self.class_probabilities(feats, w)
            error[np.arange(len(h)), target] += 1
            flat = error.ravel()
            for f in feats:
                grad = np.bincount((f[:, None] * CLASSES + every).ravel(), flat, BUCKETS * CLASSES).reshape(BUCKETS, CLASSES).astype(np.float32)
                seen += grad * grad
                w += RATE * grad / np.sqrt(seen)
            n += len(h)
        return w, n


def count_words(docs: DataFrame) -> DataFrame:
    """(h, c): the count of every token of the documents."""

    def run(batches):
        for batch in batches:
            parts = [tokens(batch.column(0).slice(a, b - a))[0] for a, b in chunks(batch.column(0), 1 << 20)]
            h, c = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

    return docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def train(docs: DataFrame, rounds: int = ROUNDS) -> tuple[MaxEnt, DataFrame]:
    """docs(doc_id, text) to learn from -> the model, and (h, c) of all tokens."""
    spark = docs.sparkSession
    counts = written(count_words(docs), "lm-counts")
    whole = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, distinct = whole.n or 0, whole.v
    least = max(1, -(-total // HOT_SHARE))
    hot = counts.where(F.col("c") >= least).orderBy("h").toPandas()  # HOT_SHARE rows at most
    model = MaxEnt(hot["h"].to_numpy(np.int64).view(np.uint64), hot["c"].to_numpy(np.int64), total, distinct)
    names = [f"w{k}" for k in range(CLASSES)]
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches, shared=shared):
            model = shared.value
            w, n = model.steps(b.column(0).slice(s, e - s) for b in batches for s, e in chunks(b.column(0), CHUNK_BYTES))
            if n:
                moved = np.flatnonzero((w != model.weights).any(1))
                steps = (w[moved] - model.weights[moved]).astype(float) * n
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[moved, -1]), *(pa.array(np.r_[steps[:, k], n]) for k in range(CLASSES))], ["bucket", *names])

        part = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(rounds)) == r).select("text")
        steps = part.mapInArrow(run, "bucket long, " + ", ".join(f"{x} double" for x in names))
        got = steps.groupBy("bucket").agg(*(F.sum(x).alias(x) for x in names)).toPandas().set_index("bucket")  # BUCKETS rows at most
        if len(got):
            n = got.loc[-1, "w0"]
            got = got.drop(index=-1)
            model.weights[got.index.to_numpy()] += (got[names].to_numpy() / n).astype(np.float32)
        shared.unpersist()
    return model, counts


def score(docs: DataFrame, model: MaxEnt, counts: DataFrame, folds: int = FOLDS) -> DataFrame:
    """docs(doc_id, text) -> one row per document with both scores."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "uid long, doc_id long, n_tokens long, n_hot long, base double, own double, rare long, h array<long>, n array<int>"

    def run(batches):
        model, uid = shared.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            for a, b in chunks(batch.column(1), CHUNK_BYTES):
                h, places = tokens(batch.column(1).slice(a, b - a))
                at, hot, target = model.place(h)
                p = model.class_probabilities(model.features(h, places), model.weights)
                own = np.log10(np.maximum(p[np.arange(len(h)), target], 1e-30).astype(float))
                base = np.zeros(len(h))
                base[hot] = model.base[at[hot]]
                own[hot] += model.within[at[hot]]
                starts = places[:-1]
                total = lambda x: np.add.reduceat(x, starts)  # noqa: E731  every text has an end, so none is empty
                rare = np.flatnonzero(~hot)
                doc = np.searchsorted(places, rare, "right") - 1
                order = np.lexsort((h[rare], doc))
                d, w = doc[order], h[rare][order]
                first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (w[1:] != w[:-1])]) if len(w) else np.zeros(0, np.int64)
                times = np.diff(np.r_[first, len(w)]).astype(np.int32)
                offsets = pa.array(np.searchsorted(d[first], np.arange(b - a + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (w[first].view(np.int64), times)]
                uids = pa.array(uid + np.arange(b - a))
                uid += b - a
                known = np.add.reduceat(hot.astype(np.int64), starts)
                size = np.diff(places)
                yield pa.RecordBatch.from_arrays([uids, batch.column(0).slice(a, b - a), pa.array(size), pa.array(known), pa.array(total(base)), pa.array(total(own)), pa.array(size - known), *lists], schema.replace(" array<long>", "").replace(" array<int>", "").replace(" long", "").replace(" double", "").split(", "))

    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema), "lm-documents")
    rare = rows.select("uid", F.explode(F.arrays_zip("h", "n")).alias("t")).select("uid", F.col("t.h").alias("h"), F.col("t.n").alias("n"))
    least = max(1, -(-model.total // HOT_SHARE))
    rare = rare.join(counts.where(F.col("c") < least), "h", "left")
    met = rare.groupBy("uid").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("logs"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("n_met"),
    )
    logs = F.coalesce("logs", F.lit(0.0))
    return rows.drop("h", "n").join(met, "uid", "left").select(
        "doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "n_tokens",
        (F.col("n_hot") + F.coalesce("n_met", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("rare") * math.log10(model.base_mass)).alias("base_score"),
        (F.col("own") + logs - F.col("rare") * math.log10(model.rare_mass)).alias("score"),
    )


def op8_lm_scoring(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    model, counts = train(docs.where(~held_out(F.col("doc_id"))))
    return score(docs, model, counts)
