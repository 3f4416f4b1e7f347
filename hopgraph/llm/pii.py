"""Personal data by fixed patterns and a semi-Markov conditional random field.

Base spans follow fixed patterns with checks (``base_spans``). The random field
adds what they miss. It sees each run of neighbouring words that hold a digit or
an @ sign: outside such runs no segment can be an entity, so the best labelling
of a text falls apart into those of its runs. A segment is one to ``MAX_WORDS``
words with one kind; its score is a weighted sum of features of the whole span
(length, digit groups, checksums, shape, the words before). A dynamic programme
over segments picks boundaries and kinds jointly.

Weights are learnt by gradient ascent on the likelihood of the segmentations
that the base patterns and one seed pattern for secrets give, on a bounded
sample: at most ``SAMPLE`` documents that hold a digit or @, by a hash of id and
text, and of their runs, cut into pieces of at most ``PIECE`` words, at most
``MAX_RUNS``, by a hash of the piece. All documents are searched whole.

Defined results: null and empty texts have no spans; an added span never
overlaps a base span; null ids are kept as they are; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopgraph.llm.common import BLANKS, read_table, text_of, written

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
MAX_WORDS = 5
SAMPLE, MAX_RUNS, PIECE, EPOCHS = 2000, 1500, 40, 6
# The contract's patterns, written so that each takes time in proportion to the text.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SEED_SECRET = re.compile(r"(?i)\b(?:token|secret|key|password)\s{0,3}[=:]\s{0,3}[\"']?([0-9a-z]{16,})")
TRIGGER = re.compile(r"[0-9@]+")
BLANK = re.compile(f"[{BLANKS}]")
LEFT_JUNK, RIGHT_JUNK = "\"'[{<*#%&$!|=,;:.", "\"'.,;:!?*#%&$]}>|="
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    found = []
    if "@" in text:
        end = 0
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                found.append((start, m.end(), "email"))
                end = m.end()
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = _digits(m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def runs(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring words with a digit or @: lists of (start, end)."""
    out, last = [], -1
    for m in TRIGGER.finditer(text):
        if m.start() < last:
            continue
        start = m.start()
        floor = max(last, 0)
        while start > floor and text[start - 1] not in BLANKS:
            start -= 1
        stop = BLANK.search(text, m.end())
        end = stop.start() if stop else len(text)
        if out and text[last:start] == " ":
            out[-1].append((start, end))
        else:
            out.append([(start, end)])
        last = end
    return out


def trim(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in LEFT_JUNK:
        start += 1
    while end > start and text[end - 1] in RIGHT_JUNK:
        end -= 1
    return start, end


def features(text: str, start: int, end: int, words: int) -> list[str]:
    """Names of the features of a whole span."""
    s = text[start:end]
    before = text[max(0, start - 24):start].lower()
    d = _digits(s)
    n = len(d)
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", s[:64]))
    plain = bool(s) and all(c in "0123456789 -" for c in s)
    parts = s.split(".")
    out = [
        "bias", f"words={words}", f"digits={0 if n == 0 else 3 if n < 4 else 8 if n < 9 else 11 if n < 12 else 15 if n < 16 else 19 if n < 20 else 99}",
        f"ats={min(2, s.count('@'))}", f"dots={min(4, s.count('.'))}", f"length={min(6, len(s) // 8)}",
    ]
    out += [name for name, on in (
        ("plus", s.startswith("+")), ("parens", "(" in s and ")" in s), ("plain", plain), ("luhn", plain and 12 <= n <= 19 and luhn(d)),
        ("octets", len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)),
        ("address", bool(re.fullmatch(r"[\w.%+-]{1,64}@[\w-]{1,64}(\.[\w-]{1,64}){1,8}", s))),
        ("hex", len(s) >= 16 and bool(re.fullmatch(r"[0-9a-fA-F]{16,256}", s)) and not s.isdigit()), ("mixed", shape.count("9") > 2 and shape.count("a") > 2 and s.isalnum()),
        ("quoted", before.endswith(('"', "'"))), ("assigned", bool(re.search(r"[=:]\s*[\"']?$", before))), ("named", bool(re.search(r"(token|secret|key|password)\W*$", before))),
        ("called", bool(re.search(r"(phone|tel|call|mobile)\W*$", before))), (f"shape={shape[:16]}", len(shape) <= 16),
    ) if on]
    return out


def segments(text: str, run: list[tuple[int, int]]) -> list[tuple[int, int, int, int, list[str]]]:
    """(first word, word after, start, end, features) of every candidate segment of a run."""
    out = []
    for i in range(len(run)):
        for j in range(i + 1, min(len(run), i + MAX_WORDS) + 1):
            start, end = trim(text, run[i][0], run[j - 1][1])
            if start < end:
                out.append((i, j, start, end, features(text, start, end, j - i)))
    return out


class SemiCRF:
    """Weights by kind and feature; the score of a word outside entities is zero."""

    def __init__(self, weights: dict[str, list[float]] | None = None):
        self.weights = weights or {}

    def _scores(self, feats: list[str]) -> list[float]:
        rows = [w for f in feats if (w := self.weights.get(f))]
        return [sum(c) for c in zip(*rows)] if rows else [-9.0] * len(KINDS)

    def decode(self, text: str) -> list[tuple[int, int, str]]:
        """The spans of the best segmentation of every run of a text."""
        out = []
        for run in runs(text):
            best, back = [0.0] * (len(run) + 1), [None] * (len(run) + 1)
            ending = [[] for _ in range(len(run) + 1)]
            for seg in segments(text, run):
                ending[seg[1]].append(seg)
            for j in range(1, len(run) + 1):
                best[j] = best[j - 1]
                for i, _, start, end, feats in ending[j]:
                    scores = self._scores(feats)
                    k = max(range(len(KINDS)), key=scores.__getitem__)
                    if best[i] + scores[k] > best[j]:
                        best[j], back[j] = best[i] + scores[k], (i, start, end, KINDS[k])
            j = len(run)
            while j:
                if back[j]:
                    out.append(back[j][1:])
                    j = back[j][0]
                else:
                    j -= 1
        return sorted(out)

    def fit(self, examples, epochs: int = EPOCHS, rate: float = 0.5, shrink: float = 1e-3) -> "SemiCRF":
        """examples: (words in the run, segments, gold {(first, after): kind}); ascends the likelihood run by run."""
        names = sorted({f for _, segs, _ in examples for s in segs for f in s[4]})
        place = {f: k for k, f in enumerate(names)}
        w, seen = np.zeros((len(names), len(KINDS))), np.full((len(names), len(KINDS)), 1e-6)
        data = [(n, [(i, j, np.array([place[f] for f in fs])) for i, j, _, _, fs in segs], gold) for n, segs, gold in examples]
        for _ in range(epochs):
            for n, segs, gold in data:
                scores = [w[fs].sum(0) for _, _, fs in segs]
                totals = [float(np.logaddexp.reduce(s)) for s in scores]
                ahead, behind = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
                for j in range(1, n + 1):
                    ahead[j] = float(np.logaddexp.reduce([ahead[j - 1]] + [ahead[i] + t for (i, e, _), t in zip(segs, totals) if e == j]))
                for i in range(n - 1, -1, -1):
                    behind[i] = float(np.logaddexp.reduce([behind[i + 1]] + [behind[e] + t for (b, e, _), t in zip(segs, totals) if b == i]))
                for (i, j, fs), s in zip(segs, scores):
                    grad = -np.exp(ahead[i] + behind[j] - ahead[n] + s)
                    if (i, j) in gold:
                        grad[KINDS.index(gold[i, j])] += 1
                    grad = grad - shrink * w[fs]
                    seen[fs] += grad * grad
                    w[fs] += rate * grad / np.sqrt(seen[fs])
        return SemiCRF({f: [float(v) for v in w[k]] for f, k in place.items()})


def examples_of(text: str) -> list:
    """Runs of a text with the segmentation that the patterns give."""
    spans = base_spans(text) + [(*m.span(1), "secret") for m in SEED_SECRET.finditer(text)]
    out = []
    for run in runs(text):
        gold = {}
        for start, end, kind in spans:
            inside = [k for k, (a, b) in enumerate(run) if a < end and start < b]
            if inside and run[0][0] <= start and end <= run[-1][1]:
                gold[inside[0], inside[-1] + 1] = kind
        out.append((len(run), segments(text, run), gold))
    return out


def train(docs: DataFrame, sample: int = SAMPLE) -> SemiCRF:
    rows = docs.where(F.col("text").rlike("[0-9@]")).select("text", F.xxhash64("doc_id", "text").alias("place"))
    # The sample's last place is found on hashes alone, so texts aren't gathered to be sorted.
    last = rows.select("place").orderBy("place").limit(sample).agg(F.max("place")).first()[0]
    texts = written(rows.where(F.col("place") <= (last if last is not None else 0)), "pii-sample")

    def gather(batches):
        for batch in batches:
            parts = []
            for text in batch.column(0).to_pylist():
                for run in runs(text):
                    for k in range(0, len(run), PIECE):
                        # The words before a run tell what it is.
                        begin = run[k][0] if k else max(0, run[0][0] - 40)
                        parts.append(text[begin:run[min(k + PIECE, len(run)) - 1][1]])
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string())], ["part"])

    parts = texts.select("text").mapInArrow(gather, "part string").orderBy(F.xxhash64("part")).limit(MAX_RUNS)
    examples = [e for r in parts.collect() for e in examples_of(r.part)]
    return SemiCRF().fit(examples)


def find_spans(text: str | None, model: SemiCRF) -> tuple[list, list]:
    """(base spans, all spans) of a whole text."""
    text = text or ""
    if not TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    spans = list(base)
    # Both lists go by start; ``reach`` is where the base spans begun so far end.
    k = reach = 0
    for start, end, kind in model.decode(text):
        while k < len(base) and base[k][0] < end:
            reach, k = max(reach, base[k][1]), k + 1
        if reach <= start:
            spans.append((start, end, kind))
    return base, sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def personal_data(docs: DataFrame, model: SemiCRF) -> DataFrame:
    """doc_id, counts of base spans by kind, digest of the base spans, all spans."""

    def run(batches):
        for batch in batches:
            found = [find_spans(t, model) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[2] == kind for s in base) for base, _ in found], pa.int64()) for kind in BASE]
            shas = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string())
            spans = pa.array([joined(spans) for _, spans in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, shas, spans], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, schema)


def redact(docs: DataFrame, model: SemiCRF) -> DataFrame:
    """docs with every span of its text replaced by its kind in angle brackets."""

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for start, end, kind in find_spans(text, model)[1]:
            if start >= at:
                out += [text[at:start], f"<{kind}>"]
            at = max(at, end)
        return "".join(out) + text[at:]

    return docs.withColumn("text", F.pandas_udf(lambda texts: pd.Series([clean(t) for t in texts], dtype=object), "string")(F.col("text")))


def op6_personal_data(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return personal_data(docs, train(docs))
