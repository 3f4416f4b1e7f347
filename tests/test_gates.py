"""Evidence gates, causes of flow errors, allowed trace ids and payloads of any depth."""

import datetime
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from hopgraph.functions import tokens as T
from hopgraph.operators import assignment as G
from hopgraph.operators import candidates, evaluate, flowlog, matching, topology

STATS = "client string, server string, coverage double, p95_us double, span_us long, occurrences long, diversity double, signal double"
GOOD = {"client": "b", "server": "c", "coverage": 99.0, "p95_us": 1_000.0, "span_us": 20_000, "occurrences": 3, "diversity": 0.9, "signal": 0.5}


@pytest.mark.parametrize(("change", "reason"), [
    ({}, "ok"), ({"signal": 0.7, "diversity": 0.3}, "ok"), ({"signal": 0.7}, "payload-tells-calls-apart"), ({"occurrences": None}, "no-profile"), ({"occurrences": 1}, "called-once"), ({"coverage": 94.0}, "coverage-too-low"),
    ({"p95_us": 50_000.0}, "tail-error-too-high"), ({"p95_us": None}, "tail-error-too-high"), ({"span_us": 71_000}, "profile-reaches-the-next-entry"), ({"occurrences": 13}, "too-dense"),
])
def test_each_gate(spark, change, reason):
    row = GOOD | change
    stats = spark.createDataFrame([tuple(row[f.split()[0]] for f in STATS.split(", "))], STATS)
    gap = spark.createDataFrame([(100_000.0,)], "root_gap_us double")
    got = G.conservative_gates(stats, gap, "a").first()
    assert (got.reason, got.use_fallback) == (reason, reason == "ok")
    if reason == "ok":
        assert G.conservative_gates(stats, gap, "a", occurrences=2).first().reason == "too-many-occurrences"
        assert G.conservative_gates(stats, gap, "b", occurrences=2).first().reason == "ok"


def test_stats_of_slots(spark):
    rows = [(f"r{k}", None, k, "ext", "a", k * 100_000, k * 100_000 + 50_000, None, None) for k in range(4)]
    rows += [(f"m{k}{n}", f"r{k}", k, "a", "b", k * 100_000 + 5_000 + n * 20_000 + k * 100, k * 100_000 + 9_000 + n * 20_000, None, None) for k in range(4) for n in (0, 1)]
    rows += [("far", None, 9, "a", "b", 2_000_000, 2_000_001, None, None)]
    c = spark.createDataFrame(rows, "call_id string, parent_id string, trace_id long, client string, server string, start_us long, end_us long, value_a string, value_b string")
    calls = c.where("call_id <> 'far'")
    profile = matching.slot_profile(calls)
    state, _, _ = matching.assign_slots(c, profile, candidates.roots_of(calls))
    got = {(r.client, r.server): r for r in G.slot_stats(c, state, profile).collect()}["a", "b"]
    assert (got.coverage, got.p50_us, got.span_us, got.occurrences) == (88.888889, 150.0, 20_000, 2) and 200 < got.p95_us <= 300
    assert G.root_gap_us(calls.where("client = 'ext'")).first().root_gap_us == 100_000


def test_causes(spark):
    marks = spark.createDataFrame([("m1", "ok"), ("m2", "ok"), ("m3", "ok"), ("gone", "missing-mark")], "mark string, status string")
    captured = spark.createDataFrame([("m1", "a", "b")] * 2 + [("m1", "b", "c")] + [("m2", "a", "b")] * 2 + [("m3", "a", "b")] * 3 + [("m3", "b", "c")] * 2, "mark string, client string, server string")
    selected = [("m1", "a", "b", "m1")] * 2 + [("m1", "b", "c", None)] + [("m2", "a", "b", "m2"), ("m2", "a", "b", "m9"), ("m2", "x", "y", None)] + [("m3", "a", "b", "m3")] + [("m3", "b", "c", "m3")] * 3
    selected = spark.createDataFrame(selected, "mark string, client string, server string, row_mark string")
    want = spark.createDataFrame([("a", "b", 2), ("b", "c", 1)], "client string, server string, want int")
    out = evaluate.flow_trace_causes(marks, selected, captured, want)
    got = {r.mark: r.asDict() for r in out.collect()}
    pick = lambda m, *names: tuple(got[m][n] for n in names)
    assert pick("m1", "exact", "assigned", "capture_fault", "pairing_fault", "correct") == (True, True, False, False, 3)
    # One row is another mark's, and its second edge was never captured.
    assert pick("m2", "not_captured", "not_paired", "wrong_mark", "correct", "covered", "capture_fault", "pairing_fault", "exact") == (1, 0, 1, 1, 2, True, True, False)
    # Captured, but left out of the trace; two rows too many on another edge.
    assert pick("m3", "not_captured", "not_paired", "extra", "capture_fault", "pairing_fault") == (0, 1, 2, False, True)
    assert pick("gone", "want", "covered", "not_captured", "exact") == (3, 0, 0, False)
    s = evaluate.flow_cause_summary(out).first()
    assert (s.traces, s.built, s.exact, s.want, s.correct, s.not_captured, s.not_paired, s.extra, s.wrong_mark) == (4, 3, 1, 12, 6, 1, 1, 2, 1)


def expand(spark, rows, allow=False, **more):
    keys = spark.createDataFrame([(i, k) for i, ks, _ in rows for k in ks], "row_id string, key string")
    ids = spark.createDataFrame([(i, t) for i, _, t in rows], "row_id string, trace_ids array<string>")
    kept, out, whole = flowlog.expand_allowed(keys, ids, spark.createDataFrame([("m", "r0")], "mark string, row_id string"), allow, **more)
    return sorted(r.row_id for r in kept.collect()), sorted(r.row_id for r in out.collect()), whole


def test_rows_of_other_traces_are_kept_out(spark):
    rows = [("r0", ["k:1"], ["t"]), ("r1", ["k:1", "k:2"], []), ("r2", ["k:2", "k:3"], ["u"]), ("r3", ["k:3"], ["t"]), ("r4", ["k:2"], ["t", "u"]), ("r5", ["k:9"], ["v", "w"])]
    # A trace id finds the row with two, which makes the second one right as well.
    assert expand(spark, rows) == (["r0", "r1", "r2", "r3", "r4"], [], True)
    assert expand(spark, [r for r in rows if r[0] != "r4"]) == (["r0", "r1", "r3"], ["r2"], True)
    assert expand(spark, [r for r in rows if r[0] != "r4"], allow=True) == (["r0", "r1", "r2", "r3"], [], True)
    assert not expand(spark, rows, rounds=1)[2]


def test_a_mark_without_ids_takes_those_of_the_first_row(spark):
    rows = [("r0", ["k:1"], None), ("r1", ["k:1"], ["t"]), ("r2", ["k:1"], ["u"]), ("r3", ["k:1"], ["t"])]
    assert expand(spark, rows) == (["r0", "r1", "r3"], ["r2"], True)


def test_payloads_of_any_depth(spark):
    deep = "[" * 200_000 + "]" * 200_000
    data = json.dumps({"a": deep, "b": "x1", "traceId": "t"})
    assert {"kv:b=x1", "v:x1"} <= T.payload_tokens(data) and {"kv:b=x1"} <= T.db_tokens(data)
    typed = '{"type": ' + "[" * 3_000 + "]" * 3_000 + ', "b": "x1"}'
    assert {"kv:b=x1"} <= T.payload_tokens(typed) and {"kv:b=x1"} <= T.db_tokens(typed)
    # What is too deep to be looked into may hold identifiers.
    assert T.scrubbed_or_none(data) is None and T.scrubbed(data) == data
    df = spark.createDataFrame([(data,), (deep,), (typed,), (None,)], "d string")
    got = df.select(T.lineage_tokens(F.col("d")).alias("a"), T.db_lineage_tokens(F.col("d")).alias("b"), T.scrub_payload(F.col("d")).alias("c")).collect()
    assert len(got) == 4 and got[3] == ([], [], None)


def test_traces_that_were_never_captured_stay_in_the_denominator(spark):
    call = "call_id string, parent_id string, trace_id long, label long"
    s = evaluate.scored(spark.createDataFrame([("r1", None, 1), ("c1", "r1", 1), ("c2", "r2", 2)], "call_id string, parent_id string, trace_id long"), spark.createDataFrame([("r1", 1, None), ("c1", 1, "r1"), ("c2", 2, None)], "call_id string, label long, parent_pred string"))
    assert tuple(evaluate.trace_assignment_strict(s).first())[:2] == (2, 2)
    # Trace 2 lacks its entry call, 3 and 4 everything.
    asked = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], call.split(", ")[2])
    assert tuple(evaluate.trace_assignment_strict(s, asked).first()) == (4, 1, 25.0)


def test_a_truth_that_cannot_be_used(spark):
    from hopgraph.operators import quality

    truth = [("r1", "t1", None), ("c1", "t1", "r1"), ("c1", "t1", "r1"), ("r2", "t2", None), ("x2", "t2", None), ("c3", "t3", "r1"), ("c4", "t2", "c4"), ("c5", "t2", "zz")]
    captured = [("r1", "t1"), ("c1", "t9"), ("lost", "t1")]
    got = {r.problem: r.n for r in quality.validate_oracle(spark.createDataFrame(truth, "key string, trace_id string, parent_key string"), spark.createDataFrame(captured, "key string, trace_id string"), spark.createDataFrame([("t1",), ("t2",), ("t7",)], "trace_id string")).collect()}
    assert got == {"duplicate": 1, "no-trace": 0, "no-root": 1, "several-roots": 1, "bad-parent": 3, "captured-but-omitted": 1, "label-disagrees": 1, "request-without-trace": 1, "trace-without-request": 1}


def test_order_by_gaps_falls_back_to_loose_pairs(spark):
    pairs = [("p", "a", 100, True), ("p", "a", 5, False), ("p", "b", 40, False), ("p", "b", 60, False), ("q", "a", 7, True)]
    pairs = spark.createDataFrame(pairs, "client string, server string, gap_us long, inside boolean")
    edges = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "c"), ("q", "a")], "client string, server string")
    got = {(r.client, r.server): (r.p50, r.n, r.place) for r in topology.child_order_gap(pairs, edges).collect()}
    assert got == {("p", "b"): (50.0, 2, 1), ("p", "a"): (100.0, 1, 2), ("p", "c"): (None, 0, 3), ("q", "a"): (7.0, 1, 1)}


def test_pairs_of_gaps_reach_a_little_past_the_parent(spark):
    schema = "call_id string, client string, server string, start_us long, end_us long"
    calls = [("p", "x", "s", 1_000_000, 1_100_000), ("in", "s", "t", 1_000_000, 1_100_000), ("late", "s", "t", 1_150_000, 1_160_000), ("gone", "s", "t", 1_150_001, 1_160_000), ("soon", "s", "t", 999_999, 1_050_000)]
    calls = spark.createDataFrame(calls, schema)
    assert sorted(map(tuple, topology.gap_pairs(calls, calls).collect())) == [("s", "t", 0, True), ("s", "t", 150_000, False)]


def test_overhead_takes_the_baseline_of_the_same_repeat(spark):
    runs = [(1.0, "base", 1, 10.0), (1.0, "base", 2, 20.0), (1.0, "full", 1, 13.0), (1.0, "full", 2, 21.0), (1.0, "full", 3, 16.0), (2.0, "full", 1, 5.0)]
    runs = spark.createDataFrame(runs, "rate double, mode string, repeat int, value double")
    got = {(r.rate, r["mode"]): (r.repeats, r.delta, r.delta_std) for r in evaluate.overhead_by_repeat(runs, "base").collect()}
    assert got == {(1.0, "base"): (2, 0.0, 0.0), (1.0, "full"): (3, round(5 / 3, 6), round(math.sqrt(4 / 3), 6)), (2.0, "full"): (1, 5.0, 0.0)}


def test_load_timing_of_one_request_and_without_any(spark):
    schema = "mode string, index long, ts timestamp, latency_ms double, start_lag_ms double"
    one = spark.createDataFrame([("a", 1, datetime.datetime(2024, 1, 1), 500.0, 2.5), ("b", 1, datetime.datetime(2024, 1, 1), None, None)], schema)
    got = {r["mode"]: r for r in evaluate.load_timing(one, ["mode"]).collect()}
    assert (got["a"].rate_rps, got["a"].lag_p99, got["a"].gap_p50) == (2.0, 2.5, None)
    assert (got["b"].rate_rps, got["b"].elapsed_s, got["b"].lag_p50, got["b"].lag_max) == (0.0, 0.0, None, None)
    assert evaluate.load_timing(one.limit(0), ["mode"]).count() == 0


def test_marks_are_expanded_in_tasks_as_by_joins(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(f"r{k}", rng.sample([f"k{x}" for x in range(25)], rng.randrange(3)), rng.choice([None, [], [f"t{rng.randrange(9)}"], [f"t{rng.randrange(9)}", f"t{rng.randrange(9)}"]])) for k in range(60)]
    keys = spark.createDataFrame([(i, k) for i, ks, _ in rows for k in ks], "row_id string, key string")
    # The last rows have no line among the ids.
    ids = spark.createDataFrame([(i, t) for i, _, t in rows[:54]], "row_id string, trace_ids array<string>")
    marks = spark.createDataFrame([(f"m{k}", f"r{rng.randrange(70)}") for k in (0, 0, 1, 2, 3, 4, 5)], "mark string, row_id string")

    def got(allow, **more):
        kept, out, whole = flowlog.expand_allowed(keys, ids, marks, allow, **more)
        return sorted(map(tuple, kept.collect())), sorted(map(tuple, out.collect())), whole

    by_joins, calls = flowlog._expanded_by_joins, []
    monkeypatch.setattr(flowlog, "_expanded_by_joins", lambda *a: calls.append(1) or by_joins(*a))
    for how in ({"allow": False}, {"allow": True, "rounds": 2}):
        monkeypatch.setattr(flowlog, "TASK_STEPS", 10_000_000)
        before, mine = len(calls), got(**how)
        assert len(calls) == before and mine[0]
        monkeypatch.setattr(flowlog, "TASK_STEPS", 0)
        assert got(**how) == mine and len(calls) == before + 1
