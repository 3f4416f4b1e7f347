"""The random field against enumeration of all labellings, odd rows, code-switched texts and held-out accuracy."""

import itertools
import math
import zlib

import numpy as np
import pytest

pytest.importorskip("hopgraph.llm.language_id")

from hopgraph.llm import language_id as L  # noqa: E402
from hopgraph.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return L.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(2)
    for _ in range(30):
        k, n = int(rng.integers(1, 4)), int(rng.integers(1, 6))
        emission, change = rng.normal(size=(n, k)) * 2, rng.normal(size=(k, k)) * 2
        mass = np.zeros((n, k))
        for labels in itertools.product(range(k), repeat=n):
            weight = math.exp(sum(emission[i, y] for i, y in enumerate(labels)) + sum(change[a, b] for a, b in zip(labels, labels[1:])))
            for i, y in enumerate(labels):
                mass[i, y] += weight
        assert np.allclose(L.marginals(emission, change, np.array([n])), mass / mass.sum(1, keepdims=True))


def test_segments_change_nothing():
    rng = np.random.default_rng(0)
    for _ in range(40):
        k = int(rng.integers(1, 5))
        lengths = rng.integers(1, 5 * L.SEGMENT, int(rng.integers(1, 6)))
        emission, change = rng.normal(size=(lengths.sum(), k)) * 3, rng.normal(size=(k, k)) * 2
        assert np.allclose(L.marginals(emission, change, lengths), L._expected(emission, change, lengths)[0], atol=1e-9)


def test_gradient_of_the_likelihood():
    """Expected pairs are the derivative of the normalising sum by the weights of changes."""
    rng = np.random.default_rng(4)
    emission, change = rng.normal(size=(4, 2)), rng.normal(size=(2, 2))

    def log_sum(c):
        return math.log(sum(math.exp(sum(emission[i, y] for i, y in enumerate(ys)) + sum(c[a, b] for a, b in zip(ys, ys[1:]))) for ys in itertools.product(range(2), repeat=4)))

    pairs = L._expected(emission, change, np.array([4]))[1]
    for a, b in itertools.product(range(2), repeat=2):
        more = change.copy()
        more[a, b] += 1e-6
        assert abs(-(log_sum(more) - log_sum(change)) / 1e-6 - pairs[a, b]) < 1e-4


def test_features():
    buckets, of, hashes = L.word_features(["ab", "a", "ab", "x" * 500])
    # Two words of n letters have n + 1 pairs, n threes and n - 1 fours with the gaps around.
    assert [int((of == k).sum()) for k in range(4)] == [3 + 2 + 1, 2 + 1, 6, 501 + 500 + 499]
    assert hashes[0] == hashes[2] != hashes[1] and sorted(buckets[of == 0]) == sorted(buckets[of == 2])
    assert L.words_of("It's 5² ÉTÉ_x\n\t—") == ["it", "s", "été", "x"] and L.words_of(None) == []


def test_code_switched_text(spark, model):
    """Stretches of two languages in one text are told apart, word by word."""
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang in ('en', 'fr')").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    take = lambda lang: [w for r in docs if r.lang == lang for w in L.words_of(r.text)][:60]
    parts = [("en", take("en")), ("fr", take("fr")), ("en", take("en")[::-1])]
    text = " ".join(w for _, words in parts for w in words)
    gold = [lang for lang, words in parts for _ in words]
    found = L.spans(spark.createDataFrame([(1, text), (2, "12 %"), (None, None)], "doc_id long, text string"), model).collect()
    said = [r.lang for r in sorted(found, key=lambda r: r.first) for _ in range(r.words)]
    assert len(said) == len(gold) and sum(a == b for a, b in zip(said, gold)) >= 0.9 * len(gold)
    assert {r.doc_id for r in found} == {1} and all(0 <= r.score <= 1 for r in found)


def test_held_out_accuracy_and_contract(spark):
    lang = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = QUERIES["op11_language_id"](spark, SF).collect()
    assert len(out) == len(lang)
    right = total = 0
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0.0 <= r.score <= 1.0
        if not L.words_of(lang[r.doc_id][1]):
            assert r.lang_pred == "und"
        elif r.held_out:
            total += 1
            right += r.lang_pred == lang[r.doc_id][0]
    assert total > 100 and right >= 0.97 * total


def test_odd_rows(spark):
    schema = "text string, lang string, doc_id long, score string, held_out string"
    rows = [("the cat and the dog " * 5 + str(k), "en", k, "x", "y") for k in range(30)] + [("le chat et le chien " * 5 + str(k), "fr", 100 + k, "x", "y") for k in range(30)]
    rows += [(None, "en", 500, None, None), ("", "fr", 501, None, None), ("123 !!", None, 502, None, None), ("the dog", None, None, None, None), ("le chien", "en", None, None, None)]
    rows += [("the dog", "fr", 5, None, None)] * 2 + [("the cat and " * 40_000, "en", 600, None, None), ("x" * 300_000, "en", 601, None, None)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    out = L.identify(docs, L.train(docs))
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    found = {}
    for r in out.collect():
        found.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert found[500] == found[501] == found[502] == [("und", 0.0)]
    assert found[600][0][0] == "en" and sorted(p for p, _ in found[None]) == ["en", "fr"] and len(found[5]) == 3
    assert all(p == "fr" for k in range(100, 130) for p, _ in found[k])
    nothing = L.train(docs.limit(0))
    assert L.identify(docs.limit(0), nothing).count() == 0
    assert {(r.lang_pred, r.score) for r in L.identify(docs, nothing).collect()} == {("und", 0.0)}
    one = L.train(docs.where("lang = 'en' and doc_id < 30"))
    assert {(r.lang_pred, round(r.score, 9)) for r in L.identify(docs, one).collect()} == {("und", 0.0), ("en", 1.0)}


def test_sample_is_bounded_and_order_free(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = (L.train(d, docs_each=20, pieces_each=50) for d in (docs, docs.repartition(7)))
    assert a.languages == b.languages and np.array_equal(a.grams, b.grams) and np.array_equal(a.lexicon, b.lexicon)
