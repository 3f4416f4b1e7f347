"""Weighted evidence of ancestors: scores and propagation against plain Python."""

import math
import random

import pytest

from hopgraph.operators import candidates as K

CALL = "call_id string, client string, server string, start_us long, end_us long, req_tokens array<string>, res_tokens array<string>"


def weights(req, res, low):
    return {t: 1.0 if t in req else low for t in [*req, *res]}


def merged(*maps):
    out = {}
    for m in maps:
        for t, w in m.items():
            out[t] = max(out.get(t, 0.0), w)
    return out


def overlap(context, tokens, idf):
    mass = {t: w * idf.get(t, 1.0) for t, w in context.items()}
    return sum(m for t, m in mass.items() if t in tokens) / sum(mass.values()) if mass else 0.0


def ancestors_context(call, parent, label, tokens):
    out, seen, at = {}, {call}, parent.get(call)
    while at is not None:
        if at in seen or label.get(at) != label.get(call):
            return {}
        seen.add(at)
        out = merged(out, weights(*tokens[at], 0.9))
        at = parent.get(at)
    return out


def plain_propagate(cands, roots, tokens, idf, cfg, rounds=20):
    label, parent = {r: r for r in roots}, {}
    for done in range(1, rounds + 1):
        best = {}
        for c in cands:
            if c["p_id"] not in label or c["call_id"] in roots:
                continue
            ctx = ancestors_context(c["p_id"], parent, label, tokens)
            score = cfg.lineage_weight * c["lineage"] + cfg.context_weight * overlap(ctx, sum(tokens[c["call_id"]], []), idf) + c["temporal"]
            key = (round(score, 9), -abs(c["start_us"] - c["p_start"]), -(c["p_end"] - c["p_start"]), c["p_id"])
            if c["call_id"] not in best or key > best[c["call_id"]][0]:
                best[c["call_id"]] = key, c["p_id"], label[c["p_id"]]
        new_label, new_parent = {**{r: r for r in roots}, **{k: v[2] for k, v in best.items()}}, {k: v[1] for k, v in best.items()}
        if (new_label, new_parent) == (label, parent):
            return label, parent, done
        label, parent = new_label, new_parent
    return label, parent, None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_propagation_against_plain_python(spark, seed):
    """Late evidence revises calls that have a label, cycles included; no map of weights is out of date then."""
    rng = random.Random(seed)
    roots, others = [f"r{k}" for k in range(4)], [f"c{k:02d}" for k in range(24)]
    tokens = {i: (rng.sample("abcdefgh", rng.randint(0, 3)), rng.sample("abcdefgh", rng.randint(0, 2))) for i in roots + others}
    idf = {t: 1.0 + rng.random() * 3 for t in "abcdef"}
    cands = []
    for i, c in enumerate(others):
        for p in rng.sample(roots[: 1 + i % 4] + others, 5):
            if p != c:
                cands.append({"call_id": c, "p_id": p, "client": "a", "server": "b", "start_us": rng.randint(0, 9), "end_us": 9, "p_start": rng.randint(0, 9), "p_end": rng.randint(10, 20), "temporal": -rng.random(), "lineage": rng.choice([0.0, 0.0, rng.random()])})
    cfg = K.Config(lineage_weight=5.0, context_weight=40.0)
    df = spark.createDataFrame(cands, "call_id string, p_id string, client string, server string, start_us long, end_us long, p_start long, p_end long, temporal double, lineage double")
    t = K.with_tokens(spark.createDataFrame([(i, "a", "b", 0, 0, *tokens[i]) for i in roots + others], CALL))
    weighed = spark.createDataFrame([("a", "b", k, v) for k, v in idf.items()], "client string, server string, token string, idf double")
    label, parent, rounds = plain_propagate(cands, roots, tokens, idf, cfg)
    got, done, whole = K.propagate(df, spark.createDataFrame([(r, r) for r in roots], "call_id string, label string"), cfg, t, idf=weighed)
    assert whole == (rounds is not None) and (not whole or done == rounds)
    assert {r.call_id: (r.parent, r.label) for r in got.collect()} == {k: (parent.get(k), v) for k, v in label.items()}


def test_a_rare_token_of_the_ancestors_beats_a_common_one(spark):
    """By count both parents' ancestors share one token of three with the child."""
    calls = [("r1", "ext", "a", 0, 100_000, ["own1", "rare"], ["x1"]), ("r2", "ext", "a", 0, 100_000, ["own2", "often"], ["x2"])]
    calls += [(f"m{k}", "a", "b", 5_000 + k, 90_000, [f"own{k}"], [f"m{k}"]) for k in (1, 2)]
    calls += [("l1", "b", "c", 10_000, 20_000, ["rare", "often"], ["z"])] + [(f"n{k}", "b", "c", 30_000, 40_000, ["often"], [f"z{k}"]) for k in range(6)]
    got = {r.call_id: r.parent for r in K.infer(spark.createDataFrame(calls, CALL), "full")[0].collect()}
    assert got["l1"] == "m1"
    # m2 is nearer in time, and is chosen where ancestors aren't evidence.
    assert {r.call_id: r.parent for r in K.infer(spark.createDataFrame(calls, CALL), "no-context")[0].collect()}["l1"] == "m2"


def test_context_scores(spark):
    contexts = spark.createDataFrame([("p", {"a": 1.0, "b": 0.9, "u": 0.9}), ("q", {}), ("s", {"a": 0.9})], "call_id string, context map<string,double>")
    cands = spark.createDataFrame([("c", p, "x", "y", ["a", "u", "k"]) for p in "pqs"] + [("d", "p", "x", "y", []), ("e", "p", "x", "z", ["b"])], "call_id string, p_id string, client string, server string, all array<string>")
    idf = spark.createDataFrame([("x", "y", "a", 3.0), ("x", "y", "b", 2.0)], "client string, server string, token string, idf double")
    got = {(r.call_id, r.p_id): r.context for r in K.context_score(cands, contexts, idf).collect()}
    assert set(got) == {("c", "p"), ("c", "s"), ("e", "p")}
    assert math.isclose(got["c", "p"], (3.0 + 0.9) / (3.0 + 1.8 + 0.9)) and got["c", "s"] == 1.0 and math.isclose(got["e", "p"], 0.9 / 2.8)


def test_evidence_comes_along(spark):
    calls = [("r1", "ext", "a", 0, 100_000, ["k"], []), ("m1", "a", "b", 5_000, 90_000, ["k"], []), ("l1", "b", "c", 10_000, 20_000, ["k"], [])]
    t = K.with_tokens(c := spark.createDataFrame(calls, CALL))
    idf = K.edge_idf(t)
    cands = K.strict_candidates(c)
    cands = cands.join(K.lineage_score(cands, t, idf), ["call_id", "p_id"], "left")
    got = {r.call_id: (r.won_lineage, r.won_context) for r in K.propagate(cands, K.roots_of(c), K.Config(), t, idf=idf, evidence=True)[0].collect()}
    assert got == {"r1": (None, None), "m1": (1.0, 0.0), "l1": (1.0, 1.0)}


def test_owners_take_in_their_database_calls(spark):
    tokens = "call_id string, client string, server string, req array<string>, res array<string>, all array<string>"
    own = spark.createDataFrame([("o", "a", "b", ["q"], ["s"], ["q", "s"]), ("n", "a", "b", ["q"], [], ["q"])], tokens)
    db = spark.createDataFrame([("d1", "b", "db", ["s", "t"], ["u", "q"], []), ("d2", "b", "db", ["v"], ["t"], []), ("d3", "b", "db", ["w"], [], [])], tokens)
    owners = spark.createDataFrame([("d1", "o"), ("d2", "o")], "db_id string, owner string")
    got = {r.call_id: r for r in K.extend_owners(own, db, owners).collect()}
    assert got["o"].weights == {"q": 1.0, "s": 0.9, "t": 0.9, "u": 0.2, "v": 0.9} and set(got["o"].req) == {"q", "s", "t", "v"} and set(got["o"]["all"]) == {"q", "s", "t", "v"}
    assert got["n"].weights == {"q": 1.0} and got["n"].req == ["q"]
    child = spark.createDataFrame([("k", "b", "c", ["u"], [], ["u"])], tokens)
    extended = K.extend_owners(own.unionByName(child), db, owners)
    pairs = spark.createDataFrame([("k", "o", "b", "c"), ("k", "n", "b", "c")], "call_id string, p_id string, client string, server string")
    idf = spark.createDataFrame([("b", "c", "u", 2.0)], "client string, server string, token string, idf double")
    got = {r.p_id: r.lineage for r in K.lineage_score(pairs, extended, idf).collect()}
    assert set(got) == {"o"} and math.isclose(got["o"], 0.4 / (1.0 + 0.9 + 0.9 + 0.9 + 0.4))


def test_variants_share_what_is_equal(spark, monkeypatch):
    """Candidates, lineage and the propagation of full and fallback are made once; each variant says what it says alone."""
    rows = [("r1", None, 1, "ext", "a", 0, 90_000, "o1", "k1"), ("m1", "r1", 1, "a", "b", 1_000, 30_000, "o1", "p1"), ("l1", "m1", 1, "b", "c", 4_000, 5_000, "p1", "s1"),
            ("r2", None, 2, "ext", "a", 500, 90_500, "o2", "k2"), ("m2", "r2", 2, "a", "b", 1_500, 30_500, "o2", "p2"), ("l2", "m2", 2, "b", "c", 3_500, 4_500, "k2", "s2"), ("late", "m2", 2, "b", "c", 400_000, 500_000, "p2", "s3")]
    c = spark.createDataFrame(rows, "call_id string, parent_id string, trace_id long, client string, server string, start_us long, end_us long, value_a string, value_b string")
    alone = {v: {tuple(r) for r in K.infer(c, v)[0].collect()} for v in K.VARIANTS}
    made = {name: [] for name in ("strict_candidates", "propagate", "lineage_score")}
    for name, calls in made.items():
        plain = getattr(K, name)
        monkeypatch.setattr(K, name, lambda *a, plain=plain, calls=calls, **k: calls.append(1) or plain(*a, **k))
    together = {v: {tuple(r) for r in labels.collect()} for v, (labels, *_) in K.infer_variants(c, list(K.VARIANTS)).items()}
    assert together == alone and len(alone["time"]) > 5
    assert len(made["strict_candidates"]) == 1 and len(made["propagate"]) == 4 and len(made["lineage_score"]) <= 3
