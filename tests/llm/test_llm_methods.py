"""The methods of the training-data operators against plain versions of themselves, and odd rows."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard

pytest.importorskip("hopgraph.llm")

from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from hopgraph.llm import chat, decontamination, exact_dedup, lm_scoring, mixing, pii, substring_dedup, toxicity  # noqa: E402
from hopgraph.llm.near_copies import drop_near_duplicates  # noqa: E402
from hopgraph.llm.word_hash import word_hashes  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_messages_with_one_sequence_number_are_all_kept(spark):
    e = [
        (1, 1, "message", "user", "first", None), (1, 1, "message", "user", "second", None), (1, 2, "delta", None, "!", None), (1, 3, "regenerate", "assistant", "new", 99), (1, 4, "message", "user", "later", None),
        (None, 1, "delta", None, "lost", None), (None, 1, "message", "user", "a", None), (None, 2, "regenerate", "user", "b", 1),
    ]
    df = spark.createDataFrame(e, "conv_id long, seq long, kind string, role string, text string, ref long")
    got = [(r.conv_id, r.text) for r in chat.fold_events(df).orderBy("conv_id", "seq").collect()]
    assert got == [(None, "b"), (1, "first"), (1, "second!"), (1, "new"), (1, "later")]


def test_wand_retrieves_what_brute_force_does():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(3, 25)))) for k in range(90)]
    frequency = {w: sum(w in t.split() for _, t in items) for w in words}
    mean = sum(len(t.split()) for _, t in items) / len(items)
    index = decontamination.ItemIndex(items, len(items), mean, frequency)
    met = 0
    for _ in range(400):
        passage = set(rng.sample(words, rng.randrange(1, 40)))
        want = {}
        for k, (n, _, own, _) in enumerate(index.items):
            norm = 1.2 * (0.25 + 0.75 * n / mean)
            weight = {w: math.log(1 + (len(items) - frequency[w] + 0.5) / (frequency[w] + 0.5)) * own.count(w) * 2.2 / (own.count(w) + norm) for w in set(own)}
            score = sum(weight[w] for w in passage & set(own)) / (decontamination.THRESHOLD * sum(weight.values()))
            if score >= 1 - 1e-6:
                want[k] = score
        got = dict(index.retrieve(passage))
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
        met += len(want)
    assert met > 300


def test_no_passage_is_passed_over(monkeypatch):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(5, 30)))) for k in range(80)]
    frequency = {w: sum(w in t.split() for _, t in items) for w in words}
    index = decontamination.ItemIndex(items, len(items), 15.0, frequency)
    monkeypatch.setattr(decontamination, "MIN_OVERLAP", 0.0)
    monkeypatch.setattr(decontamination, "MIN_ANSWER", 0.0)
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 400))) + " " + rng.choice(items)[1] for _ in range(60)] + ["", None]
    half = index.passage // 2
    for text, got in zip(texts, index.search(texts)):
        w = decontamination.tokens(text)
        want = {i for j in range((len(w) - 1) // half + 1 if w else 0) for i, _ in index.retrieve(set(w[j * half:(j + 2) * half]))}
        assert set(got) == want


def test_language_model_scores(spark):
    rng = random.Random(5)
    words = [f"Word{k}" for k in range(40)]
    data = [(k, " ".join(rng.choices(words, weights=range(1, 41), k=rng.randrange(0, 60)))) for k in range(80)] + [(900, None), (901, "never seen")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    model, counts = lm_scoring.train(df.where(~lm_scoring.held_out(F.col("doc_id"))))
    assert np.abs(model.weights).max() > 0
    known = {r.h: r.c for r in counts.collect()}
    got = {r.doc_id: r for r in lm_scoring.score(df, model, counts).collect()}
    mix = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]

    def bucket(x):
        return int(lm_scoring.mixed(np.array([x % 2**64], np.uint64))[0]) % lm_scoring.BUCKETS

    for i, text in data:
        h = [int(word_hashes(pa.array([w]), lower=True)[0][0]) for w in (text or "").split()] + [int(lm_scoring.END)]
        total = 0.0
        for k, x in enumerate(h):
            one = h[k - 1] if k > 0 else int(lm_scoring.BEGIN)
            two = h[k - 2] if k > 1 else int(lm_scoring.BEGIN)
            at = np.flatnonzero(model.hot == np.uint64(x))
            c = int(model.classes[at[0]]) if len(at) else lm_scoring.CLASSES - 1
            logits = model.bias + sum(model.weights[bucket(f)] for f in (one * mix[0], one * mix[1] + two * mix[2], two + mix[1]))
            total += math.log10(math.exp(logits[c]) / np.exp(logits.astype(float)).sum())
            count = known.get(int(np.array([x], np.uint64).view(np.int64)[0]), 0)
            total += float(model.within[at[0]]) if len(at) else math.log10((count + 0.1) / model.rare_mass)
        assert math.isclose(got[i].score, total, rel_tol=1e-4, abs_tol=1e-3), (i, got[i].score, total)


def toxic_tables(spark, n=600):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("aeiounrst"), 6)) for _ in range(300)]
    data, labels = [], []
    for k in range(n):
        text, bad = list(rng.choice(words, 40)), k % 6 == 0
        if bad:
            for at in rng.integers(0, 40, 4):
                text[at] = str(rng.choice(["horrid", "vilest", "scummy"]))
        data.append((k, " ".join(text), "extra", 7))
        labels.append((k, int(bad), k))
    return spark.createDataFrame(data, "doc_id long, text string, id string, toxic int"), spark.createDataFrame(labels, "doc_id long, toxic int, place int")


def test_compression_evidence(spark):
    docs, labels = toxic_tables(spark)
    model = toxicity.train(docs, labels)
    assert {x for x, _ in model.first} == {x for x, _ in model.second} == {0, 1}

    def size(window, content):
        params = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
        return len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content), compression_params=params).compress(window))

    for r in docs.limit(20).collect() + [None]:
        text = r.text + " -- Ünï" if r else None
        parts = toxicity.windows(text)
        assert b"".join(w.strip() for w in parts).decode() == "".join((text or "").lower().split())
        gains = []
        for stage, ordinary in ((model.first, model.first), (model.second, model.first + model.second)):
            gains.append(sum(max(0, min(size(w, c) for x, c in ordinary if not x) - max(size(w, c) for x, c in stage if x)) for w in parts))
        want = (*(math.log1p(100 * g / max(1, len(parts))) for g in gains), math.log1p(len(parts)))
        assert np.allclose(model.evidence(text), want)


def test_toxicity_on_held_out_rows_and_odd_tables(spark):
    docs, labels = toxic_tables(spark)
    got = toxicity.score_toxicity(docs, toxicity.train(docs, labels)).collect()
    test = [r for r in got if r.held_out]
    assert len(test) > 80 and sum((r.predicted == 1) == (r.doc_id % 6 == 0) for r in test) >= 0.97 * len(test)
    again = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" copy"))))
    sample, _ = toxicity.sample_of(again, labels, 5, {1: 30, 0: 50})
    assert {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()} == {1: 30, 0: 50}
    none = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score_toxicity(docs.limit(5), none).collect()} == {0.5}
    assert toxicity.score_toxicity(docs.limit(0), none).count() == 0 and toxicity.drop_toxic(docs.limit(0), labels).columns == docs.columns


def shard(rng, n=30):
    words = [b"w%d" % k for k in range(500)]
    shared = [rng.choices(words, k=40) for _ in range(4)]
    rows = []
    for d in range(n):
        at = rng.randrange(15)
        own = rng.choice(shared)[at:at + rng.randrange(20, 26)] if rng.random() < 0.8 else rng.choices(words, k=22)
        rows.append((b" ".join(own), rng.randrange(8), rng.randrange(90), 1))
    return rows


def test_automata_decide_what_comes_first(monkeypatch):
    rows = shard(random.Random(6))
    first = {}
    for words, d, p, _ in rows:
        own = words.split()
        for o in range(len(own) - 19):
            w = tuple(own[o:o + 20])
            first[w] = min(first.get(w, (99, 0)), (d, p + o))
    assert sorted(substring_dedup.first_places(rows)) == sorted(first.values())
    monkeypatch.setattr(substring_dedup, "located", lambda *_: [])
    assert sorted(substring_dedup.first_places(rows)) != sorted(first.values())


def test_equal_window_hashes_are_told_apart_by_words(monkeypatch):
    rows = shard(random.Random(7))
    want = sorted(substring_dedup.first_places(rows))
    monkeypatch.setattr(substring_dedup, "gram_hashes", lambda words, n: np.zeros(max(0, len(words) - n + 1), np.uint64))
    assert sorted(substring_dedup.first_places(rows)) == want


def test_rows_that_share_an_id_are_chosen_by_all_columns(spark):
    data = [(1, "same text", "a", f"x{k}") for k in range(9)] + [(2, "more words here", "a", "y")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, note string")
    for run in (exact_dedup.drop_exact_duplicates, mixing.mix):
        results = {tuple(sorted(map(tuple, run(df.orderBy(order).repartition(n)).collect()))) for n, order in ((1, "note"), (3, "doc_id"), (2, F.desc("note")))}
        assert len(results) == 1


def test_segmentation_is_the_best_of_all():
    rng = np.random.default_rng(9)
    texts = ["call +1 (017) 555-7701 or 4111 1111 1111 1111 now", 'key = "a9b8c7d6e5f4a3b2c1d0" 10.0.0.1 x 12 34', "1 2 3 4 5"]
    feats = {f for t in texts for run in pii.runs(t) for s in pii.segments(t, run) for f in s[4]}
    for _ in range(20):
        model = pii.SemiCRF({f: rng.normal(0, 1, len(pii.KINDS)).tolist() for f in feats})
        for text in texts:
            want = 0.0
            for run in pii.runs(text):
                segs = [(i, j, max(model._scores(f))) for i, j, _, _, f in pii.segments(text, run)]
                best = 0.0
                for n in range(len(run) + 1):
                    for chosen in itertools.combinations(segs, n):
                        if all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(chosen, 2)):
                            best = max(best, sum(s[2] for s in chosen))
                want += best
            spans = {(start, end): max(model._scores(f)) for run in pii.runs(text) for _, _, start, end, f in pii.segments(text, run)}
            assert math.isclose(sum(spans[s[0], s[1]] for s in model.decode(text)), want, abs_tol=1e-9)


def test_spans_never_overlap_base_spans():
    rng = random.Random(10)
    text = " ".join(rng.choice(["10.0.0.1", "a@b.cc", "4111 1111 1111 1111", "+1 555 555 7700", "a9b8c7d6e5f4a3b2c1d0", "x"]) for _ in range(400))
    model = pii.SemiCRF({"bias": [1.0] * 5})
    base, spans = pii.find_spans(text, model)
    added = [s for s in spans if s not in base]
    assert not any(a < e and s < b for s, e, _ in added for a, b, _ in base)
    assert {s for s in model.decode(text) if not any(a < s[1] and s[0] < b for a, b, _ in base)} == set(added)


def odd_documents(spark):
    long = " ".join(f"word{k}" for k in range(4000))
    rows = [(1, long, "a"), (2, long + " end", "a"), (3, None, None), (4, "", "b"), (None, "no id", "b"), (None, "no id", "b"), (5, "Same", "a"), (6, "same", "a"), (6, "other text of six", "a"), (7, "last words", None)]
    schema = "doc_id long, text string, source string, lang string, n_chars long, _node long, _of long, _id long, _gone int, row string, id int, toxic int, kept boolean, place string, n int"
    return spark.createDataFrame([(i, t, s, "en", 0, 1, 2, 3, 4, "r", 5, 6, True, "p", 8) for i, t, s in rows], schema)


def test_stages_on_odd_rows(spark):
    docs = odd_documents(spark)
    texts = lambda df: sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:20]) for r in df.collect())
    out = {name: stage(spark, docs, SF) for name, stage in corpus_pipeline.STAGES}
    assert all(df.columns == docs.columns for df in out.values())
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    model = toxicity.train(docs, labels)
    assert len(texts(out["toxicity"])) == sum(model.score(r.text) < 0.5 for r in docs.collect())
    best = {}
    for r in docs.collect():
        key = (r.text or "").lower()
        best[key] = max(best.get(key, -1), -1 if r.doc_id is None else r.doc_id)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in out["exact_dedup"].collect()) == sorted(best.values())
    assert [t for *_, t in texts(out["near_dedup"])] == ["word0 word1 word2 wo", "", "Same", "other text of six", "last words", "no id"]
    assert decontamination.contaminations(docs, bench).isEmpty() and texts(out["decontamination"]) == texts(docs)
    copies = {(r.doc_id, r.text or ""): r["count"] for r in out["source_mix"].groupBy("doc_id", "text").count().collect()}
    assert copies and set(copies) <= {(r.doc_id, r.text or "") for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs.limit(0), SF)
        assert got.columns == docs.columns and got.isEmpty()
    assert drop_near_duplicates(docs).columns == docs.columns


def test_benchmark_items_without_an_id_are_items_too(spark):
    from hopgraph.llm import decontamination

    passage = " ".join(f"question{k}" for k in range(30))
    other = " ".join(f"another{k}" for k in range(30))
    bench = spark.createDataFrame([(None, passage), (None, other), (1, "a third item of some other words " * 3)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"some words before {passage} and after"), (2, f"{other}"), (3, "clean words only, nothing else in here"), (None, other)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminations(docs, bench).collect()} == {(1, None), (2, None), (None, None)}
    assert [r.doc_id for r in decontamination.drop_contaminated(docs, bench).collect()] == [3]
