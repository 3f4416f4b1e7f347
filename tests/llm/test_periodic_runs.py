"""Runs from suffix trees against brute force, on all small sequences, random ones and a table with odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

pytest.importorskip("hopgraph.llm.periodic_runs")

from hopgraph.llm import periodic_runs as P  # noqa: E402
from hopgraph.llm.queries import QUERIES  # noqa: E402
from hopgraph.llm.suffix_tree import Extensions  # noqa: E402


def brute(words, least=6, exponent=4):
    out, n = [], len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            seg = words[i:i + length]
            if length >= max(least, exponent * q) and all(seg[d:] != seg[:-d] for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    dropped = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for k, w in enumerate(words) if k not in dropped)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize(("exponent", "least"), [(4, 6), (2, 2), (3, 6)])
def test_runs_of_all_small_and_many_random_sequences(exponent, least):
    for words in itertools.product("ab", repeat=11):
        assert P.runs_of(list(words), least, exponent) == brute(words, least, exponent)
    rng = random.Random(3)
    for _ in range(400):
        letters = "abcd"[:rng.randint(1, 4)]
        words = rng.choices(letters, k=rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            words[at:at] = (rng.choices(letters, k=rng.randint(1, 5)) * 8)[:rng.randint(4, 30)]
        assert P.runs_of(words, least, exponent) == brute(words, least, exponent)


def test_extensions():
    rng = random.Random(1)
    for _ in range(50):
        seq = rng.choices((1, 2, 3), k=rng.randint(2, 60))
        ext = Extensions(seq, 4)
        for i, j in itertools.permutations(range(len(seq)), 2):
            common = next((k for k in range(len(seq)) if max(i, j) + k >= len(seq) or seq[i + k] != seq[j + k]), 0)
            assert int(ext([i], [j])[0]) == common


def test_a_tree_is_built_only_where_words_repeat():
    words = [f"w{k}" for k in range(5000)] + ["a", "b"] * 5 + [f"x{k}" for k in range(5000)]
    assert P.stretches(words, 4, 6) == [(5000, 5010)]
    assert P.runs_of(words) == [(5000, 10, 2)]


def test_long_texts():
    rng = random.Random(5)
    phrase = [str(rng.random()) for _ in range(9000)]
    assert P.runs_of(phrase * 4) == [(0, 36000, 9000)]
    assert P.runs_of(["a"] * 100_000) == [(0, 100_000, 1)]
    assert P.runs_of(phrase * 3) == []


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    loud = "buy now " * 40 + "or never " * 3 + "ha " * 7
    texts = [(1, loud), (2, None), (3, ""), (4, " \n\t"), (None, loud), (None, None), (5, "ha " * 6), (5, "ha " * 6), (6, "ha " * 5), (7, "Ha ha " * 4), (8, "é é " * 8)]
    texts += [(k, f"some {k} words " + "of a tale told twice " * (k % 9) + loud[:k]) for k in range(100, 220)]
    folder = str(tmp_path_factory.mktemp("runs"))
    rows = [(t, i, "en", "x", "y") for i, t in texts]
    spark.createDataFrame(rows, "text string, doc_id long, lang string, start string, period string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder, texts


def test_query_against_brute_force(spark, folder):
    got = QUERIES["op13_periodic_runs"](spark, folder[0])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((expected(i, t) for i, t in folder[1]), key=repr)


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    for r in docs:
        if len(r.text or "") < 20_000:
            assert got[r.doc_id] == expected(r.doc_id, r.text)
    assert len(got) == len(docs)


def test_rows_and_collapsed_texts(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    rows = P.periodic_runs(docs).where("doc_id = 5").collect()
    assert [tuple(r) for r in rows] == [(5, 0, 6, 1, "ha")] * 2
    out = P.collapse_runs(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[5] == "ha" and texts[6] == "ha " * 5 and texts[2] is None and texts[4] == " \n\t"
    assert texts[1] == "buy now or never or never or never ha"
    assert P.collapse_runs(docs.limit(0)).count() == 0 and P.periodic_runs(docs.limit(0)).count() == 0
