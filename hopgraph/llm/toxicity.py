"""Toxicity by compression distance with trained zstandard dictionaries.

A text is cut into windows, its words and runs of signs, each with ``GAP`` around
it; every window of the whole text is compressed. Separate dictionaries are
trained (zstandard's own training) on the windows of toxic and of ordinary
documents, several of each on disjoint folds of the sample. A window gains the
bytes by which even the worst toxic dictionary beats even the best ordinary one,
so what one fold happened to hold doesn't count.

Training has two stages. The second trains each fold's dictionary again, only on
those of its windows that some toxic dictionary of the first compresses better
than all ordinary ones: hard cases, for both labels. What a document's windows
gain per hundred in either stage is its evidence; a threshold on it, calibrated
by logistic regression, gives the score. One in ``CALIBRATING`` rows of the
sample is kept for calibration and never trained on.

Fitting uses a bounded sample of labelled rows that are not held out: at most
``TOXIC_ROWS`` toxic and ``ORDINARY_ROWS`` ordinary ones, by a hash of their id.
All documents are scored whole.

Defined results: null and empty texts have no windows and get the score of no
evidence; rows with a null id are scored and never learnt from; where only one
label is known every score is the share of that label; ids labelled twice count
as toxic if any label says so; rows that repeat an id with other texts are all
candidates for the sample, and its bound holds for them too; labels without a
document are ignored; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopgraph.llm.common import read_table, written

TOXIC_ROWS, ORDINARY_ROWS = 2400, 4800
#: Folds of each label, if there are FOLD_ROWS rows for each of them; two at least.
TOXIC_FOLDS, ORDINARY_FOLDS, FOLD_ROWS = 4, 8, 80
CALIBRATING = 4
#: Characters of a toxic fold for a byte of a first-stage dictionary, window bytes for one of the second; bounds of both.
FIRST_SHARE, SECOND_SHARE = 50, 20
FIRST_BYTES, SECOND_BYTES = (4096, 16384), (1024, 16384)
SEGMENT, DMER = 24, 8
LEVEL = 3
CACHE = 1 << 16
#: What most windows gain in both stages.
NOTHING = (0, 0)
GAP = "    "
WINDOW = re.compile(r"\w+|[^\w\s]+")


def windows(text: str | None) -> list[bytes]:
    return [f"{GAP}{w}{GAP}".encode("utf-8", "replace") for w in WINDOW.findall((text or "").lower())]


def held_out(id_col: Column, folds: int) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on windows; too few to train on are the dictionary themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=DMER, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def within(size: int, bounds: tuple[int, int]) -> int:
    return max(bounds[0], min(bounds[1], size))


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0
    )
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content), compression_params=params)


def lengths(window: bytes, makers: list) -> list[int]:
    return [len(m.compress(window)) for m in makers]


def gained(window: bytes, toxic: list, ordinary: list) -> int:
    """Bytes by which the worst toxic dictionary beats the best ordinary one, or 0; ends as soon as it is 0."""
    most, least = 0, 1 << 62
    for k in range(max(len(toxic), len(ordinary))):
        if k < len(toxic):
            most = max(most, len(toxic[k].compress(window)))
        if k < len(ordinary):
            least = min(least, len(ordinary[k].compress(window)))
        if least <= most:
            return 0
    return least - most


@dataclass
class ToxicityModel:
    """(label, dictionary) pairs of both stages, and the weights of a constant, the evidence of each stage and the text's size."""

    first: list[tuple[int, bytes]] = field(default_factory=list)
    second: list[tuple[int, bytes]] = field(default_factory=list)
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    prior: float = 0.0

    def __post_init__(self):
        self._made = None

    def __getstate__(self):
        return {**self.__dict__, "_made": None}

    def compressors(self) -> tuple[list, list, list, list, dict]:
        """Toxic and ordinary ones of the first and the second stage, and the gains known so far."""
        if self._made is None:
            t1, o1, t2, o2 = ([compressor(c) for is_toxic, c in stage if is_toxic == label] for stage in (self.first, self.second) for label in (1, 0))
            self._made = t1, o1, t2, o2 + o1, {}
        return self._made

    def whole(self) -> bool:
        return {label for label, _ in self.first} == {0, 1}

    def hard(self, window: bytes) -> bool:
        """Whether some toxic dictionary of the first stage beats all ordinary ones."""
        toxic, ordinary, _, _, seen = self.compressors()
        if (found := seen.get(window)) is None:
            if len(seen) >= CACHE:
                seen.clear()
            found = seen[window] = min(lengths(window, toxic)) < min(lengths(window, ordinary))
        return found

    def evidence(self, text: str | None) -> tuple[float, float, float]:
        """Bytes gained per hundred windows in each stage, and the number of windows, on log scales."""
        t1, o1, t2, o2, seen = self.compressors()
        parts, one, two = windows(text), 0, 0
        for w in parts:
            if (gain := seen.get(w)) is None:
                if len(seen) >= CACHE:
                    seen.clear()
                gain = gained(w, t1, o1), gained(w, t2, o2) if t2 else 0
                gain = seen[w] = gain if any(gain) else NOTHING
            one, two = one + gain[0], two + gain[1]
        n = max(1, len(parts))
        return math.log1p(100.0 * one / n), math.log1p(100.0 * two / n), math.log1p(len(parts))

    def score(self, text: str | None) -> float:
        x = self.weights[0] + float(np.dot(self.weights[1:], self.evidence(text))) if self.whole() else self.prior
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, x))))


def calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Weighted logistic regression by Newton's method, a little shrunk."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + 0.1 * np.eye(len(w)), x.T @ (weight * (y - p)) - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def _least(df: DataFrame, toxic: int, rows: int) -> DataFrame:
    return df.where(F.col("toxic") == toxic).orderBy("place").limit(rows)


def sample_of(docs: DataFrame, labels: DataFrame, folds: int, rows: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """(toxic, place, text) of the bounded sample, and the labelled rows there are by label."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    known = known.where(~held_out(F.col("id"), folds)).withColumn("place", F.xxhash64("id"))
    total = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = written(_least(known, 1, rows[1]).unionByName(_least(known, 0, rows[0])).select("id", "toxic"), "toxic-labels")
    # At most ``rows`` rows of two small columns, so broadcast.
    texts = docs.select(F.col("doc_id").alias("of"), F.col("text").alias("text")).join(F.broadcast(chosen), F.col("of") == F.col("id"))
    texts = texts.groupBy("toxic", F.xxhash64("id", "text").alias("place")).agg(F.first("text").alias("text"))
    texts = written(texts, "toxic-texts")
    return written(_least(texts, 1, rows[1]).unionByName(_least(texts, 0, rows[0])), "toxic-sample"), total


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> ToxicityModel:
    sample, total = sample_of(docs, labels, folds, {1: toxic_rows, 0: ordinary_rows})
    seen = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = (total.get(1, 0) + 0.5) / (sum(total.values()) + 1.0)
    model = ToxicityModel(prior=math.log(share / (1 - share)))
    if len(seen) < 2:
        return model
    parts = {label: max(2, min(most, seen[label] // FOLD_ROWS)) for label, most in ((1, TOXIC_FOLDS), (0, ORDINARY_FOLDS))}
    fold = F.pmod(F.xxhash64("place"), F.when(F.col("toxic") == 1, parts[1]).otherwise(parts[0])).cast("int")
    apart = F.pmod("place", F.lit(CALIBRATING)) == 0
    rows = sample.where(~apart).select("toxic", fold.alias("fold"), "text")
    chars = rows.where("toxic = 1").agg(F.sum(F.char_length("text"))).first()[0] or 0
    size = within(chars // parts[1] // FIRST_SHARE, FIRST_BYTES)

    def learn(key, group: pd.DataFrame) -> pd.DataFrame:
        samples = [w for t in group["text"] for w in windows(t)]
        return pd.DataFrame({"toxic": [key[0]], "fold": [key[1]], "content": [trained(samples, size)]})

    def learn_hard(key, group: pd.DataFrame) -> pd.DataFrame:
        samples = [w for t in group["text"] for w in windows(t) if model.hard(w)]
        return pd.DataFrame({"toxic": [key[0]], "fold": [key[1]], "content": [trained(samples, within(sum(map(len, samples)) // SECOND_SHARE, SECOND_BYTES))]})

    def dictionaries(how) -> list[tuple[int, bytes]]:
        made = rows.groupBy("toxic", "fold").applyInPandas(how, "toxic int, fold int, content binary").collect()  # a row for each fold
        return [(r.toxic, bytes(r.content)) for r in sorted(made) if r.content]

    model.first = dictionaries(learn)
    if not model.whole():
        return model
    model.second = dictionaries(learn_hard)

    def facts(batches):
        for batch in batches:
            found = [model.evidence(text) for text in batch.column(1).to_pylist()]
            columns = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.float64()) for c in columns), batch.column(0)], ["a", "b", "c", "toxic"])

    known = sample.where(apart).select("toxic", "text").mapInArrow(facts, "a double, b double, c double, toxic int").toPandas().sort_values(["a", "b", "c", "toxic"])
    # The sample has more toxic rows than their share; weights restore it.
    seen = known["toxic"].value_counts()
    weight = known["toxic"].map({k: total[k] / n * len(known) / sum(total.values()) for k, n in seen.items()})
    model.weights = calibrated(known[["a", "b", "c"]].to_numpy(), known["toxic"].to_numpy(float), weight.to_numpy(float))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""

    def run(batches):
        for batch in batches:
            scores = [model.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted toxic."""
    model = train(docs, labels)
    score = F.pandas_udf(lambda texts: pd.Series([model.score(t) for t in texts], dtype=float), "double")
    return docs.where(score(F.col("text")) < 0.5)


def op9_toxicity(spark, sf_dir):
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return score_toxicity(docs, train(docs, labels))
