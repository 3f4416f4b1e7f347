"""Language of words and texts by a linear-chain conditional random field.

A text's words are its runs of letters, in lower case. The field gives each a
language: what speaks for one are the weights of its affixes and inner n-grams
(two to four signs, the gap before and after a word being one, hashed to
``BUCKETS``) and of the word itself if the lexicon has it, and a learnt weight of
each language following another. Forward-backward gives every word's
probabilities, with all other words of the text in view, so a text may switch
between languages. A text's language is the one with the largest sum of its
words' probabilities; its score is the mean.

Forward-backward runs on many texts at once in NumPy: texts are cut into
``SEGMENT`` words, the product of each segment's matrices carries forward and
backward messages across, and inside all segments go in step. It is exact, and
time and memory grow with the words.

The classifier is fitted on a bounded sample: at most ``DOCS`` documents of a
language by a hash of id and text, and of the pieces of ``PIECE`` words of their
whole texts at most ``PIECES`` a language by a hash; the lexicon holds words
that these pieces have ``LEXICON_LEAST`` times. One in ``SPLICED`` training
sequences is half a piece of one language and half one of another, so that
switches are learnt. At most ``LANGUAGES`` languages, the commonest, are told
apart. All documents are labelled whole.

Defined results: texts that are null or have no letter are ``und`` with score 0,
and so are all where nothing can be learnt; where one language is learnt all
texts with letters have it, with score 1; rows with a null id or language are
labelled and never learnt from; repeated rows are rows of their own; languages
that are equally likely go by name; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopgraph.llm.common import read_table, text_of, written

UNKNOWN = "und"
LANGUAGES, DOCS, PIECES, PIECE = 64, 1000, 1500, 40
LEXICON_LEAST, SPLICED = 3, 3
BUCKETS, GRAMS = 1 << 16, (2, 3, 4)
SEGMENT = 64
#: Words that are labelled together, unless one text has more.
CHUNK = 200_000
EPOCHS, RATE, SHRINK, STEP = 4, 0.15, 1e-4, 64
LETTERS = re.compile(r"[^\W\d_]+")
GAP = ord("\n")
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    found = LETTERS.findall((text or "").lower())
    if not all(map(str.isalpha, found)):
        found = [w for w in ("".join(filter(str.isalpha, w)) for w in found) if w]
    return found


def held_out(id_col: Column, folds: int) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, of, hashes): the n-gram buckets of all words, the word that each is of, and a 64-bit hash of each word."""
    codes = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    gaps = np.flatnonzero(codes == GAP)
    c = codes.astype(np.uint64)
    word = np.cumsum(codes == GAP) - 1
    buckets, of = [], []
    hashed = c
    for n in range(2, max(GRAMS) + 1):
        hashed = hashed[:-1] * FACTOR + c[n - 1:]
        if n in GRAMS:
            # A gap may stand first or last, not inside.
            inner = word[n - 2:len(c) - 1] == word[:len(hashed)]
            at = np.flatnonzero(inner)
            buckets.append(((hashed[at] * MIX) >> np.uint64(48)).astype(np.int64) % BUCKETS)
            of.append(word[at])
    place = (np.arange(len(c)) - gaps[word]).astype(np.int64)
    powers = np.cumprod(np.full(int(place.max(initial=0)) + 1, FACTOR))
    hashes = np.add.reduceat(c * powers[place], gaps[:-1]) if words else np.zeros(0, np.uint64)
    return np.concatenate(buckets), np.concatenate(of), hashes


def marginals(emission: np.ndarray, change: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Probabilities of every word's languages.

    emission: log weights of the words of all texts, one text after another; change: log weights of language
    after language; lengths: words by text, none of them zero.
    """
    total, k = emission.shape
    e = np.exp(emission - emission.max(1, keepdims=True))
    step = np.exp(change - change.max())
    per_text = -(-lengths // SEGMENT)
    first = np.cumsum(per_text) - per_text
    text = np.repeat(np.arange(len(lengths)), per_text)
    number = np.arange(len(text)) - first[text]
    start = (np.cumsum(lengths) - lengths)[text] + number * SEGMENT
    size = np.minimum(SEGMENT, lengths[text] - number * SEGMENT)
    longest, rounds = int(size.max()), int(per_text.max())
    inside = [np.flatnonzero(size > t) for t in range(longest)]
    # What is known of a segment's first word from the left, and of its last word from the right.
    left, right = np.ones((len(text), k)), np.ones((len(text), k))
    if rounds > 1:
        matrix = np.broadcast_to(np.eye(k), (len(text), k, k)).copy()
        for t, on in enumerate(inside):
            m = (matrix[on] @ step if t else matrix[on]) * e[start[on] + t][:, None, :]
            matrix[on] = m / m.max((1, 2), keepdims=True)
        for r in range(1, rounds):
            at = first[per_text > r] + r
            m = np.einsum("si,sij->sj", left[at - 1], matrix[at - 1]) @ step
            left[at] = m / m.sum(1, keepdims=True)
        for r in range(rounds - 2, -1, -1):
            at = first[per_text > r + 1] + r
            m = np.einsum("sij,sj->si", matrix[at + 1], right[at + 1]) @ step.T
            right[at] = m / m.sum(1, keepdims=True)
    out = np.empty((total, k))
    for t, on in enumerate(inside):
        m = left[on] * e[start[on] + t]
        m /= m.sum(1, keepdims=True)
        out[start[on] + t] = m
        left[on] = m @ step
    for t, on in reversed(list(enumerate(inside))):
        rows = start[on] + t
        out[rows] *= right[on]
        m = (right[on] * e[rows]) @ step.T
        right[on] = m / m.sum(1, keepdims=True)
    return out / out.sum(1, keepdims=True)


@dataclass
class LanguageModel:
    """Languages by name, weights of n-gram buckets, of the lexicon's words (by hash; the last row is that of other words) and of changes."""

    languages: list[str]
    grams: np.ndarray
    lexicon: np.ndarray
    words: np.ndarray
    change: np.ndarray

    def word_rows(self, hashes: np.ndarray) -> np.ndarray:
        """Where the lexicon has a word; its length where it hasn't."""
        at = np.searchsorted(self.lexicon, hashes)
        hit = np.zeros(len(hashes), bool)
        if len(self.lexicon):
            hit = self.lexicon[np.minimum(at, len(self.lexicon) - 1)] == hashes
        return np.where(hit, at, len(self.lexicon))

    def emissions(self, words: list[str]) -> np.ndarray:
        buckets, of, hashes = word_features(words)
        out = self.words[self.word_rows(hashes)].astype(np.float64)
        for k in range(len(self.languages)):
            out[:, k] += np.bincount(of, self.grams[buckets, k], len(words))
        return out

    def label(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Probabilities of the languages of every word of texts that have words."""
        flat = pa.array([w for words in texts for w in words], pa.string()).dictionary_encode()
        lengths = np.array([len(words) for words in texts])
        emission = self.emissions(flat.dictionary.to_pylist())[flat.indices.to_numpy()]
        return np.split(marginals(emission, self.change, lengths), np.cumsum(lengths)[:-1])


def fit(pieces: list[tuple[str, list[str]]], epochs: int = EPOCHS, rate: float = RATE, shrink: float = SHRINK) -> LanguageModel:
    """pieces: (language, words); ascends the likelihood of the words' languages in steps of ``STEP`` sequences (Adagrad)."""
    languages = sorted({lang for lang, _ in pieces})
    k = len(languages)
    rng = np.random.default_rng(11)
    sequences = []
    for n, (lang, words) in enumerate(pieces):
        y = languages.index(lang)
        if n % SPLICED == 0 and k > 1:
            other, more = pieces[int(rng.integers(len(pieces)))]
            half = words[:max(1, len(words) // 2)]
            more = more[len(more) // 2:]
            sequences.append((half + more, [y] * len(half) + [languages.index(other)] * len(more)))
        else:
            sequences.append((words, [y] * len(words)))
    known = sorted({w for words, _ in sequences for w in words})
    place = {w: i for i, w in enumerate(known)}
    buckets, of, hashes = word_features(known)
    order = np.argsort(of, kind="stable")
    buckets, begin = buckets[order], np.searchsorted(of[order], np.arange(len(known) + 1))
    seen = np.bincount([place[w] for words, _ in sequences for w in words], minlength=len(known))
    lexicon = np.unique(hashes[seen >= LEXICON_LEAST])
    model = LanguageModel(languages, np.zeros((BUCKETS, k)), lexicon, np.zeros((len(lexicon) + 1, k)), np.zeros((k, k)))
    if k < 2:
        return model
    lex_row = model.word_rows(hashes)
    squares = [np.full_like(w, 1e-2) for w in (model.grams, model.words, model.change)]

    def ascend(weights, square, rows, grad):
        grad = grad - shrink * weights[rows]
        square[rows] += grad * grad
        weights[rows] += rate * grad / np.sqrt(square[rows])

    for _ in range(epochs):
        for chosen in np.array_split(rng.permutation(len(sequences)), max(1, len(sequences) // STEP)):
            part = [sequences[c] for c in chosen]
            ids = np.array([place[w] for words, _ in part for w in words])
            gold = np.array([y for _, labels in part for y in labels])
            lengths = np.array([len(words) for words, _ in part])
            used, inverse = np.unique(ids, return_inverse=True)
            counts = begin[used + 1] - begin[used]
            feature = buckets[np.concatenate([np.arange(begin[u], begin[u + 1]) for u in used])]
            owner = np.repeat(np.arange(len(used)), counts)
            emission = model.words[lex_row[used]] + np.stack([np.bincount(owner, model.grams[feature, j], len(used)) for j in range(k)], 1)
            p, pairs = _expected(emission[inverse], model.change, lengths)
            grad = -p
            grad[np.arange(len(gold)), gold] += 1
            by_word = np.stack([np.bincount(inverse, grad[:, j], len(used)) for j in range(k)], 1)
            rows, where = np.unique(feature, return_inverse=True)
            ascend(model.grams, squares[0], rows, np.stack([np.bincount(where, by_word[owner, j], len(rows)) for j in range(k)], 1))
            inside = lex_row[used] < len(lexicon)
            # Words of one hash share a row.
            rows, where = np.unique(lex_row[used][inside], return_inverse=True)
            if len(rows):
                ascend(model.words, squares[1], rows, np.stack([np.bincount(where, by_word[inside, j], len(rows)) for j in range(k)], 1))
            follows = np.ones(len(gold), bool)
            follows[np.cumsum(lengths) - lengths] = False
            at = np.flatnonzero(follows)
            np.add.at(pairs, (gold[at - 1], gold[at]), 1.0)
            ascend(model.change, squares[2], slice(None), pairs)
    model.grams, model.words = model.grams.astype(np.float32), model.words.astype(np.float32)
    return model


def _expected(emission: np.ndarray, change: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of all words, and minus the expected number of each language after each: plain forward-backward on padded rows."""
    n, longest, k = len(lengths), int(lengths.max()), emission.shape[1]
    start = np.cumsum(lengths) - lengths
    e = np.exp(emission - emission.max(1, keepdims=True))
    step = np.exp(change - change.max())
    ahead, out = np.empty_like(e), np.empty_like(e)
    a = np.ones((n, k))
    for t in range(longest):
        on = np.flatnonzero(lengths > t)
        moved = (a[on] @ step if t else a[on]) * e[start[on] + t]
        a[on] = moved / moved.sum(1, keepdims=True)
        ahead[start[on] + t] = a[on]
    pairs, b = np.zeros((k, k)), np.ones((n, k))
    for t in range(longest - 1, -1, -1):
        on = np.flatnonzero(lengths > t)
        rows = start[on] + t
        out[rows] = ahead[rows] * b[on]
        right = b[on] * e[rows]
        if t:
            both = ahead[rows - 1][:, :, None] * step * right[:, None, :]
            pairs -= (both / both.sum((1, 2), keepdims=True)).sum(0)
        moved = right @ step.T
        b[on] = moved / moved.sum(1, keepdims=True)
    return out / out.sum(1, keepdims=True), pairs


def train(docs: DataFrame, folds: int = 5, docs_each: int = DOCS, pieces_each: int = PIECES) -> LanguageModel:
    """A model from a bounded sample of the documents that aren't held out."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), F.col("lang").cast("string").alias("lang")).where("doc_id is not null and lang is not null and text is not null")
    rows = rows.where(~held_out(F.col("doc_id"), folds)).withColumn("place", F.xxhash64("doc_id", "text"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    # A row for each of at most LANGUAGES languages. Places are even, so four times too many rows are near the smallest ones.
    sizes = written(sizes, "language-sizes")
    share = 4.0 * docs_each / F.col("n")
    near = rows.join(F.broadcast(sizes), "lang").where((share >= 1) | ((F.col("place") / 2.0 ** 64 + 0.5) < share))
    last = near.select("lang", "place").withColumn("k", F.expr("row_number() OVER (PARTITION BY lang ORDER BY place)")).where(F.col("k") <= docs_each)
    last = written(last.groupBy("lang").agg(F.max("place").alias("last")), "language-places")
    texts = rows.join(F.broadcast(last), "lang").where("place <= last").select("lang", "text")

    def cut(batches):
        for batch in batches:
            langs, parts = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                for at in range(0, len(words), PIECE):
                    langs.append(lang)
                    parts.append(" ".join(words[at:at + PIECE]))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.string())], ["lang", "part"])

    pieces = written(texts.mapInArrow(cut, "lang string, part string").distinct(), "language-pieces")
    chosen = pieces.withColumn("k", F.expr("row_number() OVER (PARTITION BY lang ORDER BY xxhash64(part), part)")).where(F.col("k") <= pieces_each)
    found = sorted((r.lang, r.part) for r in chosen.select("lang", "part").collect())  # at most LANGUAGES * pieces_each short rows
    return fit([(lang, part.split(" ")) for lang, part in found])


def _chunks(texts: list[str | None]):
    """(places, words) of texts with words, about CHUNK words at a time."""
    places, found, held = [], [], 0
    for k, text in enumerate(texts):
        if words := words_of(text):
            places.append(k)
            found.append(words)
            held += len(words)
        if held >= CHUNK:
            yield places, found
            places, found, held = [], [], 0
    if found:
        yield places, found


def label_texts(texts: list[str | None], model: LanguageModel) -> list[tuple[str, float]]:
    """(language, score) of whole texts."""
    out = [(UNKNOWN, 0.0)] * len(texts)
    for places, found in _chunks(texts) if model.languages else ():
        for at, p in zip(places, model.label(found)):
            mean = p.mean(0)
            best = int(mean.argmax())
            out[at] = model.languages[best], min(1.0, float(mean[best]))
    return out


def identify(docs: DataFrame, model: LanguageModel, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""

    def run(batches):
        for batch in batches:
            found = label_texts(batch.column(1).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([lang for lang, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "lang_pred", "score")


def spans(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, first, words, lang, score: the stretches of words of one language in every text, words numbered from 0, with their mean probability."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                if not words or not model.languages:
                    continue
                p = model.label([words])[0]
                best = p.argmax(1)
                cuts = np.flatnonzero(np.diff(best)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(words)]):
                    rows.append((doc_id, a, b - a, model.languages[best[a]], float(p[a:b, best[a]].mean())))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()))], ["doc_id", "first", "words", "lang", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, first long, words long, lang string, score double")


def op11_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
