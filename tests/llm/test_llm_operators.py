"""The training-data operators against brute force on small tables with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hopgraph.llm import chat, decontamination, exact_dedup, line_dedup, lm_scoring, mixing, pii, simhash, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha string, row string"
LONG = " ".join(f"word{k}" for k in range(3000))
PASSAGE = " ".join(f"shared{k}" for k in range(60))
LINE = "This very line is found in many of the documents here."


def rows():
    texts = [
        (1, "Alpha beta gamma delta", "a"), (2, "ALPHA beta gamma delta", "a"), (3, None, "b"), (4, "", None), (5, "", "b"), (None, "lonely words", None), (6, LONG, "c"), (7, LONG + " end", "c"),
        (8, f"one {PASSAGE} two", "a"), (9, f"three {PASSAGE} four {PASSAGE}", "a"), (10, "Ünïcödé ÄÖ \x0b tab\ttab", "a"), (10, "Ünïcödé ÄÖ \x0b tab\ttab", "a"), (11, " \n \n", "d"), (12, "é" * 50, "d"),
    ]
    texts += [(20 + k, f"intro {k}\n{LINE if k % 2 else LINE.upper() + '  '}\nlast {k}", "a" if k < 6 else "e") for k in range(8)]
    return [(i, t, "en", s, len(t or ""), "x", "y") for i, t, s in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return (text or "").encode().lower().decode()


def test_exact_groups(docs):
    got = exact_dedup.exact_groups(docs).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows():
        groups[hashlib.sha256(lower(t).encode()).hexdigest()].append(i)
    assert len(got) == len(rows())
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and set(kept) == set(groups)


def test_exact_drop(docs, empty):
    out = exact_dedup.drop_exact_duplicates(docs)
    assert out.columns == docs.columns and out.count() == len({lower(t) for _, t, *_ in rows()})
    assert exact_dedup.drop_exact_duplicates(empty).count() == 0 and exact_dedup.exact_groups(empty).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    grams = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_groups(docs, empty):
    got = simhash.near_groups(docs).collect()
    fps = [(i, brute_fingerprint(t)) for i, t, *_ in rows()]
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), f"{f:016x}") for i, f in fps)
    label = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a][1] ^ fps[b][1]).count("1") <= 3 and label[a] != label[b]:
                label = [label[b] if x == label[a] else x for x in label]
    want = {}
    for (i, f), x in zip(fps, label):
        want[f"{f:016x}"] = min((j for (j, _), y in zip(fps, label) if y == x and j is not None), default=None)
    assert all(r.component_id == want[r.fingerprint] for r in got)
    assert simhash.near_groups(empty).count() == 0 and simhash.drop_near_duplicates(docs).columns == docs.columns


def test_close_links_of_a_crowded_cell(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(1 << 62))
    values = {base}
    for _ in range(300):
        v = base
        for b in rng.integers(0, 63, rng.integers(1, 4)):
            v ^= 1 << int(b)
        values.add(v)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    one = set(map(tuple, simhash.close_links(df, cell=1024).collect()))
    cut = set(map(tuple, simhash.close_links(df, cell=16).collect()))

    def groups(links):
        up = {v: v for v in values}

        def find(v):
            while up[v] != v:
                v = up[v]
            return v

        for a, b in links:
            up[find(a)] = find(b)
        return sorted(sorted(x for x in values if find(x) == r) for r in {find(v) for v in values})

    brute = [(a, b) for a in values for b in values if a < b and bin(a ^ b).count("1") <= 3]
    assert groups(one) == groups(cut) == groups(brute)


def test_mix(docs, empty):
    got = mixing.plan_mix(mixing.sized(docs)).select("row.doc_id", "source", "size", "source_size", "target", "copies", "taken").collect()
    sizes, names = Counter(), sorted({s for *_, s in [(r[0], r[3]) for r in rows()]}, key=lambda s: (s is None, s or ""))
    for _, t, _, s, *_ in rows():
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            break
        capped |= set(over)
    target = {s: 3 * sizes[s] if s in capped else level * weight[s] for s in names}
    assert len(got) == len(rows())
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source]) and 0 <= r.copies <= 3 and r.taken == r.copies * r.size
    for s in names:
        most = max(r.size for r in got if r.source == s)
        assert abs(sum(r.taken for r in got if r.source == s) - target[s]) <= most / 2 + 1e-9
    assert mixing.mix(empty).count() == 0 and mixing.mix(docs).columns == docs.columns


def test_line_dedup(docs, empty):
    blanks = " \t\n\x0b\x0c\r"
    data = [(i, (t or "").split("\n")) for i, t, *_ in rows()]
    holders = defaultdict(set)
    for i, lines in data:
        for x in lines:
            if len(k := lower(x.strip(blanks))) >= 40:
                holders[k].add(-math.inf if i is None else i)
    want = []
    for i, lines in data:
        kept = [x for x in lines if not (len(holders.get(k := lower(x.strip(blanks)), ())) >= 5 and i != max(holders[k]))]
        want.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    for batches, fanout in ((4, 2), (1, 2), (3, 5)):
        got = line_dedup.drop_repeated_lines(docs, batches=batches, fanout=fanout).select("row.doc_id", "n_lines", "n_dropped", "kept_text").collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    assert sum(w[2] for w in want) == 7
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "~1 ~0 <|im_end|>\n<|im_start|>user\nhi", "<~1|", "", None, "a<", "|><|>", "é\n\n~", "<<SYS>>x<</SYS>>"]
    data = [(c, k, "assistant" if k % 2 else "us\ner", t) for c in (1, None) for k, t in enumerate(texts)] + [(1, 3, None, "again")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    out = chat.format_events(chat.conversation_events(df)).withColumn("read", chat.parse(F.col("formatted"))).withColumn("learnt", chat.loss_text(F.col("formatted"), F.col("loss")))
    for r in out.collect():
        mine = sorted(((k, role or "", t or "") for c, k, role, t in data if c == r.conv_id))
        assert [(x.role, x.text) for x in r["read"]] == [(role, t) for _, role, t in mine]
        assert r.learnt == "".join(t for _, role, t in mine if role == "assistant")
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == len(mine)


def test_chat_events(spark):
    e = [
        (1, 0, "message", "user", "hello", None), (1, 1, "message", "assistant", "He", None), (1, 2, "delta", None, "llo!", None), (1, 3, "message", "user", "more", None),
        (1, 4, "message", "assistant", "old", None), (1, 5, "regenerate", "assistant", "n", 4), (1, 6, "delta", None, "ew", None), (1, 7, "edit", None, "HELLO", 0), (1, 8, "edit", None, "gone", 4), (1, 9, "edit", None, "nobody", 77),
    ]
    df = spark.createDataFrame(e, "conv_id long, seq long, kind string, role string, text string, ref long")
    got = [(r.role, r.text) for r in chat.fold_events(df).orderBy("seq").collect()]
    assert got == [("user", "HELLO"), ("assistant", "Hello!"), ("user", "more"), ("assistant", "new")]


ITEM = "What is the tallest of these seven hills beyond the river. It is the one with nine towers."


def test_decontamination(spark, docs, empty):
    items = [(1, ITEM), (2, "Name the color of an unusual tree that stands alone. Purple mostly."), (3, None), (4, ""), (5, ITEM)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    more = spark.createDataFrame([(100, f"{LONG} {ITEM.upper()}!! {LONG}"), (101, ITEM[:40]), (102, "tallest hills river towers nine seven"), (None, ITEM)], "doc_id long, text string")
    data = docs.select("doc_id", "text").unionByName(more)
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminations(data, bench).collect()}
    assert got == {(100, 1), (100, 5), (None, 1), (None, 5)}
    assert {r.doc_id for r in decontamination.drop_contaminated(data, bench).collect()} == {r[0] for r in rows() if r[0] is not None} | {None, 101, 102}
    assert decontamination.contaminations(docs, bench.limit(0)).count() == 0 and decontamination.contaminations(empty, bench).count() == 0


def test_index_shards_agree(spark):
    bench = spark.createDataFrame([(k, f"item{k} has words a{k} b{k} c{k} d{k} e{k}. Answer f{k} g{k} h{k}.") for k in range(40)], "item_id long, text string")
    texts = [f"before item{k} has words a{k} b{k} c{k} d{k} e{k}. Answer f{k} g{k} h{k}. after" for k in range(0, 40, 3)]
    for size in (8_000_000, 500):
        found = set()
        for index in decontamination.index_shards(bench, size):
            found |= {index.items[i][1] for f in index.search(texts) for i in f}
        assert found == set(range(0, 40, 3))


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")) or kind == "card" and not (12 <= len(d) <= 19 and pii.luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(PATTERNS).index(s[2])))


def test_base_spans():
    rng = np.random.default_rng(5)
    for alphabet in ("019.@+- (a)", "4111 -.@a", "25.6+()- "):
        for _ in range(4000):
            text = "".join(rng.choice(list(alphabet), rng.integers(0, 30)))
            assert pii.base_spans(text) == brute_spans(text), text


def test_personal_data(spark, docs, empty):
    secret = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    texts = [f"mail a.b{k}@mail{k}.example.com, call +1 (017) 555-77{k:02d} or {k}.2.3.4 with 4111 1111 1111 1111 {secret} end" for k in range(30)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    model = pii.train(df)
    got = {r.doc_id: r for r in pii.personal_data(df, model).collect()}
    for k, t in enumerate(texts):
        r = got[100 + k]
        base = brute_spans(t)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{c}:{a}:{b}" for a, b, c in base).encode()).hexdigest()
        at = t.index("04dbeb")
        assert f"secret:{at}:{at + 40}" in r.spans.split(",")
    assert got[3].spans == got[4].spans == "" and pii.personal_data(empty, model).count() == 0
    assert "@" not in pii.redact(df, model).where("doc_id = 100").first().text


def test_substring_dedup(docs, empty):
    seen, want = {}, []
    data = sorted(rows(), key=lambda r: (r[0] is None, r[0] or 0))
    tokens = [(i, (t or "").encode().split()) for i, t, *_ in data]
    for i, w in tokens:
        for k in range(len(w) - 19):
            seen.setdefault(tuple(w[k:k + 20]), (i, k))
    for i, w in tokens:
        gone = set()
        for k in range(len(w) - 19):
            if seen[tuple(w[k:k + 20])] != (i, k):
                gone |= set(range(k, k + 20))
        want.append((str(i), len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    got = substring_dedup.repeated_passages(docs).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want) and sum(w[2] for w in want) >= 3000
    assert substring_dedup.repeated_passages(empty).count() == 0


def test_lm_base_scores(spark, docs, empty):
    df = docs.select("doc_id", "text")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = {(str(i), t): lower(t).encode().split() + [None] for i, t, *_ in rows()}
    counts = Counter(w for i, t, *_ in rows() if not held(i) for w in tokens[str(i), t])
    n, v = sum(counts.values()), len(counts)
    model, words = lm_scoring.train(df.where(~lm_scoring.held_out(F.col("doc_id"))))
    got = lm_scoring.score(df, model, words).collect()
    assert len(got) == len(rows())
    want = sorted((str(i), len(x), sum(counts[w] > 0 for w in x), round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x), 6)) for i, t, *_ in rows() for x in (tokens[str(i), t],))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.held_out == held(r.doc_id) and r.score < 0 for r in got)
    assert lm_scoring.score(empty.select("doc_id", "text"), *lm_scoring.train(empty.select("doc_id", "text"))).count() == 0


def test_lm_probabilities_add_up():
    hot = np.arange(1, 200, dtype=np.uint64) * np.uint64(7919)
    counts = np.arange(200, 1, -1)
    model = lm_scoring.MaxEnt(hot, counts, int(counts.sum()) + 500, 400)
    feats = [np.array([3]), np.array([4]), np.array([5])]
    p = model.class_probabilities(feats, model.weights)[0]
    assert math.isclose(float(p.sum()), 1, rel_tol=1e-5)
    inside = np.bincount(model.classes, 10.0 ** model.within, minlength=lm_scoring.CLASSES)
    assert np.allclose(inside[:-1][np.bincount(model.classes, minlength=lm_scoring.CLASSES)[:-1] > 0], 1)


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("aeiounrst"), 6)) for _ in range(300)]
    data, labels = [], []
    for k in range(600):
        text, bad = list(rng.choice(words, 40)), k % 6 == 0
        if bad:
            for at in rng.integers(0, 40, 4):
                text[at] = str(rng.choice(["horrid", "vilest", "scummy"]))
        data.append((k, " ".join(text)))
        labels.append((k, int(bad)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(5000, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(df, toxicity.train(df, lab)).collect()
    test = [r for r in got if r.held_out]
    assert len(test) > 80 and all((r.predicted == 1) == (r.doc_id % 6 == 0) for r in test)
    odd = toxicity.score_toxicity(docs, toxicity.train(docs, lab.limit(0)))
    assert [r.score for r in odd.collect()] == [0.5] * len(rows())
    assert toxicity.score_toxicity(empty, toxicity.train(empty, lab)).count() == 0
