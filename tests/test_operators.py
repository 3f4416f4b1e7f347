"""Trace operators on hand-built cases."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopgraph.functions import tokens as T
from hopgraph.functions.columns import endpoint_host, is_html_noise, normalize_value, trace_context
from hopgraph.operators import assignment, candidates, evaluate, flowlog, pairing, provenance, quality, reassembly
from hopgraph.operators.common import ranked
from hopgraph.operators.graphs import components
from hopgraph.sources import io

CALL = "call_id string, parent_id string, trace_id long, client string, server string, start_us long, end_us long, value_a string, value_b string"


def calls(spark, rows):
    return spark.createDataFrame(rows, CALL)


def infer(spark, rows, variant="full"):
    return {r.call_id: (r.parent, r.label) for r in candidates.infer(calls(spark, rows), variant)[0].collect()}


def test_assignment_against_brute_force():
    rng = np.random.default_rng(0)
    for bits in range(512):
        allowed = np.array([bits >> k & 1 for k in range(9)]).reshape(3, 3)
        cost = np.where(allowed, rng.integers(0, 9, (3, 3)), assignment.FORBIDDEN).astype(float)
        chosen, total = assignment.solve(cost)
        best = None
        for k in (3, 2, 1, 0):
            sums = [sum(cost[r, c] for r, c in zip(rows, cols)) for rows in itertools.combinations(range(3), k) for cols in itertools.permutations(range(3), k)]
            sums = [s for s in sums if s < assignment.FORBIDDEN]
            if sums:
                best = (k, min(sums))
                break
        assert ((chosen >= 0).sum(), total) == best


def test_matching_support_on_all_small_graphs():
    perfect = [set(enumerate(p)) for p in itertools.permutations(range(3))]
    for bits in range(512):
        edges = [(k // 3, k % 3) for k in range(9) if bits >> k & 1]
        if {c for c, _ in edges} != {0, 1, 2} or {p for _, p in edges} != {0, 1, 2}:
            continue
        whole = [m for m in perfect if m <= set(edges)]
        kept, status = provenance.support(edges, edges, [0, 1, 2], [0, 1, 2])
        assert status == ("matched" if whole else "infeasible")
        assert set(kept) == (set().union(*whole) if whole else set(edges))


def test_optional_and_repeated_calls(spark):
    rows = [
        ("r1", None, 1, "ext", "a", 0, 100_000, "x1", "y1"), ("r2", None, 2, "ext", "a", 200_000, 300_000, "x2", "y2"),
        ("c1", "r1", 1, "a", "b", 10_000, 20_000, "x1", "z"), ("c2", "r1", 1, "a", "b", 30_000, 40_000, "x1", "z"),
    ]
    got = infer(spark, rows)
    assert got["c1"] == got["c2"] == ("r1", "r1") and got["r2"] == (None, "r2")


def test_payload_tells_parallel_calls_apart_in_any_order(spark):
    rows = [(f"r{k}", None, k, "ext", "a", k * 1000, 90_000, f"order{k}", None) for k in range(4)] + [(f"c{k}", f"r{k}", k, "a", "b", 30_000 - k * 1000, 40_000, f"order{k}", None) for k in range(4)]
    want = {f"c{k}": (f"r{k}", f"r{k}") for k in range(4)}
    for order in (rows, rows[::-1]):
        got = infer(spark, order, "no-context")
        assert {k: got[k] for k in want} == want


def test_containing_parents_come_first_and_clocks_may_differ(spark):
    rows = [("r1", None, 1, "ext", "a", 0, 100_000, None, None), ("r2", None, 2, "ext", "a", 11_000, 100_000, None, None), ("c1", "r1", 1, "a", "b", 10_000, 50_000, None, None)]
    assert infer(spark, rows, "time")["c1"] == ("r1", "r1")
    late = [("r1", None, 1, "ext", "a", 20_000, 100_000, None, None), ("c1", "r1", 1, "a", "b", 10_000, 110_000, None, None)]
    assert infer(spark, late, "time")["c1"] == ("r1", "r1")


def test_ancestor_evidence(spark):
    rows = [("r1", None, 1, "ext", "a", 0, 100_000, "k1", None), ("r2", None, 2, "ext", "a", 0, 100_000, "k2", None)]
    rows += [(f"m{k}", f"r{k}", k, "a", "b", 5_000, 90_000, f"k{k}", f"m{k}") for k in (1, 2)] + [(f"l{k}", f"m{k}", k, "b", "c", 10_000, 20_000, f"k{k}", "same") for k in (1, 2)]
    got = infer(spark, rows)
    assert got["l1"] == ("m1", "r1") and got["l2"] == ("m2", "r2")


def test_ancestors_stop_at_cycles_and_foreign_labels(spark):
    p = [("a", None, "x"), ("b", "a", "x"), ("c", "b", "x"), ("d", "c", "x"), ("e", "f", "x"), ("f", "e", "x"), ("g", "a", "y"), ("h", "g", "y")]
    got = {}
    for r in candidates.ancestors(spark.createDataFrame(p, "call_id string, parent string, label string")).collect():
        got.setdefault(r.call_id, set()).add(r.ancestor)
    assert got == {"b": {"a"}, "c": {"a", "b"}, "d": {"a", "b", "c"}}


def test_renaming_labels_changes_nothing(spark):
    s = calls(spark, [("r1", None, 1, "ext", "gateway", 0, 9, None, None), ("c1", "r1", 1, "gateway", "b", 1, 2, None, None)])
    for label in (1, 77):
        pred = spark.createDataFrame([("r1", label, None), ("c1", label, "r1")], "call_id string, label long, parent_pred string")
        row = evaluate.full_trace_accuracy(evaluate.scored(s.withColumn("trace_id", F.lit(label).cast("long")), pred)).first()
        assert row.accuracy == 100.0


def test_missing_predictions_stay_in_the_denominator(spark):
    s = calls(spark, [("r1", None, 1, "ext", "gateway", 0, 9, None, None), ("c1", "r1", 1, "gateway", "b", 1, 2, None, None), ("c2", "r1", 1, "gateway", "b", 3, 4, None, None)])
    pred = spark.createDataFrame([("r1", 1, None), ("c1", 1, "r1")], "call_id string, label long, parent_pred string")
    m = evaluate.span_metrics(evaluate.scored(s, pred)).first()
    assert (m.total, m.correct, m.unpredicted, m.accuracy) == (2, 1, 1, 50.0)
    assert evaluate.trace_assignment_strict(evaluate.scored(s, pred)).first().exact == 0


def test_fifo_pairing(spark):
    rows = [("a", k, t) for k, t in enumerate(["Response", "Request", "Request", "Response", "Response", "Response", "Request"])]
    df = spark.createDataFrame(rows, "conn string, at int, msg_type string")
    assert {(r.req_at, r.res_at) for r in pairing.pair_fifo(df).collect()} == {(1, 3), (2, 4), (6, None)}


def test_session_merge_takes_the_latest_waiting_request(spark):
    rows = [("1", 0), ("2", 0), ("3", 1), ("4", 1), ("5", 1), ("6", 0)]
    df = spark.createDataFrame([("a", "f", 0, i, int(i), int(i), t) for i, t in rows], "agent string, flow string, request_id int, row_id string, start_us long, end_us long, type int")
    assert {tuple(r.rows) for r in flowlog.merge_sessions(df).collect()} == {("2", "3"), ("1", "4"), ("5",), ("6",)}


def test_session_rules(spark):
    # (flow, row, type, protocol, side, seq_0, seq_1, response_us, async)
    rows = [
        ("p", "1", 0, "HTTP", "c", 0, 0, 0, False), ("p", "2", 1, "TLS", "c", 0, 0, 5, False), ("p", "3", 1, "HTTP", "c", 0, 0, 5, False),
        ("s", "11", 0, "HTTP", "s-p", 7, 0, 0, False), ("s", "12", 0, "HTTP", "s-p", 9, 0, 0, False), ("s", "13", 1, "HTTP", "s-p", 0, 8, 5, False), ("s", "14", 1, "HTTP", "s-p", 0, 12, 5, False),
        ("d", "21", 0, "DNS", "c-p", 3, 0, 0, False), ("d", "22", 1, "DNS", "c-p", 0, 4, 5, False), ("d", "23", 1, "DNS", "c-p", 0, 5, 6, False), ("d", "24", 1, "DNS", "c-p", 0, 9, 6, False),
        ("g", "31", 0, "gRPC", "c", 0, 0, 9, False), ("g", "32", 1, "HTTP2", "c", 0, 0, 0, False), ("g", "33", 1, "HTTP2", "c", 0, 0, 0, False),
        ("a", "41", 0, "HTTP", "c", 0, 0, 0, True), ("a", "42", 1, "HTTP", "c", 0, 0, 5, False), ("a", "43", 0, "HTTP", "c", 0, 0, 0, False), ("a", "44", 1, "HTTP", "c", 0, 0, 5, True),
    ]
    schema = "agent string, flow string, request_id int, row_id string, start_us long, end_us long, type int, protocol string, tap_side string, seq_0 long, seq_1 long, response_us long, is_async boolean"
    df = spark.createDataFrame([("a", f, 0, i, int(i), int(i), *rest) for f, i, *rest in rows], schema)
    got = {tuple(r.rows) for r in flowlog.merge_sessions(df).collect()}
    assert got == {("1", "3"), ("2",), ("11", "13"), ("12",), ("14",), ("21", "22", "23"), ("24",), ("31", "32"), ("33",), ("41",), ("42",), ("43",), ("44",)}


def test_ranks_without_a_window_over_the_whole_group(spark):
    df = spark.createDataFrame([("a" if k % 3 else "b", (k * 37) % 100, k) for k in range(100)], "g string, t long, id long")
    got = {r.id: (r.k, r.n) for r in ranked(df, ["g"], F.expr("t div 7"), ["t", "id"]).collect()}
    for name, keep in (("a", lambda k: k % 3), ("b", lambda k: not k % 3)):
        ids = sorted((k for k in range(100) if keep(k)), key=lambda k: ((k * 37) % 100, k))
        assert {i: got[i] for i in ids} == {i: (n, len(ids)) for n, i in enumerate(ids)}, name


def test_reassembly_of_late_and_overlapping_segments(spark):
    data = b"noise" + b"GET / HTTP/1.1\r\nContent-Length: 3\r\n\r\nabc" + b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n2\r\nhi\r\n0\r\n\r\n"
    cut = [(0, 9), (40, len(data)), (5, 30), (25, 41)]
    rows = [(1, t, 100 + a, bytearray(data[a:b])) for t, (a, b) in enumerate(cut)]
    got = reassembly.reassemble_http1(spark.createDataFrame(rows, "flow long, time_us long, seq long, payload binary")).orderBy("n").collect()
    assert [r.body for r in got] == ["abc", "2\r\nhi\r\n0\r\n\r\n"]


def test_chunked_bodies_end_at_the_last_chunk(spark):
    body = b"18\r\nab0\r\n\r\ncdefghijklmnopqrs\r\n10\r\n0123456789abcdef\r\n0\r\n\r\n"
    data = b"POST /x HTTP/1.1\r\nTransfer-Encoding: chunked\r\n\r\n" + body
    assert reassembly.cut_message(data) == len(data) and reassembly.cut_message(data[:-1]) is None


def test_many_late_segments_lose_nothing():
    message = b"GET /a HTTP/1.1\r\nContent-Length: 2000\r\n\r\n" + b"x" * 2000
    data = message * 2
    late = [(k, 1000 + k, data[k:k + 5]) for k in range(5, len(data), 5)] + [(9000, 1000, data[:5])]
    assert [m for _, m in reassembly.messages_of(late)] == [message, message]
    gap = [s for s in late if s[1] != 1000 + 50]
    assert [m for _, m in reassembly.messages_of(gap)] == [message]


def test_order_of_a_deep_trace(spark):
    rows = [("t", f"s{k:03d}", f"s{k - 1:03d}" if k else None, k) for k in range(70)]
    got = flowlog.trace_order(spark.createDataFrame(rows, "trace string, row_id string, parent string, start_us long"))
    assert sorted((r.place, r.row_id) for r in got.collect()) == [(k + 1, f"s{k:03d}") for k in range(70)]


def test_expansion_over_a_key_of_very_many_rows(spark):
    keys = spark.range(10_001).select(F.concat(F.lit("r"), F.col("id")).alias("row_id"), F.lit("tcp:1").alias("key"))
    anchors = spark.createDataFrame([("m", "r5")], "mark string, row_id string")
    seen, whole = flowlog.expand(keys, anchors)
    assert seen.count() == 10_001 and whole


def test_no_call_is_shared_across_blocks(spark):
    rows = [("s", "a", 59_999_999, 1, ["c1"], 2.0), ("s", "b", 60_000_001, 1, ["c1"], 3.0), ("s", "b", 60_000_001, 2, ["c2"], 1.0), ("s", "d", 60_000_002, 1, ["c2"], 9.0)]
    topk = spark.createDataFrame(rows, "service string, span string, start_us long, rank int, picked array<string>, score double")
    got = {r.span: r.picked for r in assignment.resolve_conflicts(topk, batch=1, block=1).collect()}
    assert got == {"a": ["c1"], "d": ["c2"]}


def test_matching_leaves_no_child_with_a_free_parent(spark):
    # Every child is nearest to parent 0; parts hold two parents each.
    pairs = [(f"c{k}", f"p{j}", "a", "b", 1000 + k, 1001 + k, j, 10_000) for k in range(6) for j in range(6)]
    df = spark.createDataFrame(pairs, "call_id string, p_id string, client string, server string, start_us long, end_us long, p_start long, p_end long")
    parents = spark.createDataFrame([(f"p{j}", "a", j, 10_000) for j in range(6)], "call_id string, server string, start_us long, end_us long")
    got = assignment.match_windowed(df, parents, cap=2).collect()
    assert len({r.call_id for r in got}) == len({r.parent for r in got}) == 6


def test_late_children_fall_back_on_the_nearest_parent(spark):
    rows = [("r1", None, 1, "ext", "a", 0, 10_000, None, None), ("m1", "r1", 1, "a", "b", 150_000, 160_000, None, None), ("l1", "m1", 1, "b", "c", 152_000, 153_000, None, None)]
    got = infer(spark, rows)
    assert got["m1"] == ("r1", "r1") and got["l1"] == ("m1", "r1")


def test_trees_related_through_other_spans_stay(spark):
    rows = [("t", "main", 0, 10, ["a"]), ("t", "far", 100, 110, ["b"]), ("t", "link", 200, 210, ["a", "b"]), ("t", "other", 300, 310, ["z"]), ("t", "skewed", 50, 60, [])]
    df = spark.createDataFrame(rows, "trace string, tree string, start_us long, end_us long, trace_ids array<string>")
    ahead = F.when(F.col("tree") == "skewed", 45)
    assert {r.tree for r in flowlog.prune_trees(df, F.col("tree") == "main").collect()} == {"main", "far", "link"}
    assert {r.tree for r in flowlog.prune_trees(df, F.col("tree") == "main", ahead).collect()} == {"main", "far", "link", "skewed"}


def test_rules_with_prefixes_and_missing_fields(spark):
    e = [("p1", "x", "a", "get a", 0, 100, "1"), ("p2", "x", "a", "health", 0, 100, "1"), ("c1", "a", "b", "get b", 10, 20, "1"), ("c2", "a", "b", "get b", 10, 20, None), ("c3", "a", "b", "get b", 10, 20, "2")]
    events = spark.createDataFrame(e, "event_id string, caller string, callee string, operation string, start_ns long, end_ns long, value string")
    rules = spark.createDataFrame([("a", "b", "get ")], "parent_service string, child_service string, parent_operation_prefix string")
    edges = provenance.rule_edges(events, rules)
    assert {(r.child, r.parent, r.preserved, r.missing) for r in edges.collect()} == {("c1", "p1", True, False), ("c2", "p1", True, True), ("c3", "p1", False, False)}
    assert tuple(provenance.missing_pairs(edges).first()) == ("a", "b", 3, 1)
    # Three children and one parent: balance is looked at before the limits.
    assert {r.status for r in provenance.supported_edges(edges, max_nodes=0).collect()} == {"unbalanced"}


def test_tokens():
    got = T.payload_tokens(json.dumps({"url": "/user/42?name=Bob7777", "paras": "a=1&b=two", "n": 1.5, "day": "2024-01-02", "in": '{"deep": "value"}', "page": "<html><body>"}))
    assert {"kv:path=user", "v:42", "kv:name=bob7777", "n:7777", "kv:b=two", "v:two", "f2:1.50", "v:1.500", "d:2024-01-02", "kv:deep=value"} <= got
    assert not any("html" in t or t == "v:1" for t in got)
    db = T.db_tokens(json.dumps({"query": {"filter": {"hotelId": "7", "_id": "0123456789abcdef01234567"}, "$db": "x"}}))
    assert db == {"kv:hotelid=7", "v:7"}
    assert json.loads(T.scrubbed('{"a": {"traceId": 1, "b": "{\\"span_id\\": 2, \\"c\\": 3}"}, "url": "/x?rid=1&k=2"}')) == {"a": {"b": '{"c": 3}'}, "url": "/x?k=2"}
    assert T.payload_tokens(None) == T.payload_tokens("") == set() and T.scrubbed(None) is None and "d:2024-05-06" in T.payload_tokens("on 2024-05-06")


def test_columns(spark):
    df = spark.createDataFrame([(" NULL ", "a:1:80"), ("1.23456", "host"), (None, None), ("<HTML>x", "b:9")], "v string, e string")
    got = df.select(normalize_value(F.col("v")), endpoint_host(F.col("e")), is_html_noise(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [("", "a:1", False), ("1.235", "host", False), (None, None, False), ("<html>x", "b", True)]
    h = spark.createDataFrame([({"X-Trace-Id": "t", "x-request-id": "r"},), ({"Uber-Trace-ID": "a:b:0:1"},), ({},)], "h map<string,string>")
    assert [r.c.trace_id for r in h.select(trace_context(F.col("h")).alias("c")).collect()] == ["t", "a", None]


def test_truth_checks(spark):
    rpcs = [("q1", "a", None), ("q1", "b", "a"), ("q1", "b", "a"), ("q1", "c", "zz"), ("q2", "d", None), ("q2", "e", "b"), ("q3", "f", "g"), ("q3", "g", "f")]
    df = spark.createDataFrame(rpcs, "request_id string, span_id string, parent_span_id string")
    got = {(r.problem, r.request_id) for r in quality.validate_truth(df, df.select("request_id").distinct()).collect()}
    assert got == {("duplicate-span", "q1"), ("unknown-parent", "q1"), ("cross-request-parent", "q2"), ("not-one-root", "q3"), ("cycle-or-below-one", "q3")}


def test_blind_input_has_no_labels(spark):
    schema = "protocol_type string, msg_type string, time_us long, client string, server string, stream_id string, trace_id string, data string"
    rows = [
        ("HTTP/1.1", "Request", 1, "ext:9", "gateway:80", "s", "trace1", '{"note": "trace:trace1"}'), ("HTTP/1.1", "Response", 2, "ext:9", "gateway:80", "s", "trace1", None),
        ("grpc", "Request", 3, "ext:8", "gateway:80", "t", "trace2", '{"X-B3-TraceId": "trace2", "a": "{\\"headers\\": 1, \\"b\\": 2}"}'), ("grpc", "Response", 4, "ext:8", "gateway:80", "t", "trace2", "plain words"),
        ("grpc", "Request", 5, "gateway:1", "b:80", "u", "trace2", "[]"), ("SQL", "Response", 6, "gateway:1", "b:80", "u", "trace2", "[]"),
        ("grpc", "Request", 7, "ext:8", "gateway:80", "v", "trace2", "[]"), ("grpc", "Response", 8, "ext:8", "gateway:80", "v", "trace2", "[]"),
    ]
    blind, oracle, problems = quality.prepare_blind(spark.createDataFrame(rows, schema))
    assert "trace_id" not in blind.columns
    assert {tuple(r) for r in problems.collect()} == {("label-in-payload", "trace1"), ("unparsed-payload", "trace2"), ("protocol", "trace2"), ("several-entry-calls", "trace2")}
    data = {r.time_us: r.data for r in blind.collect()}
    assert data[2] == data[4] == "{}" and json.loads(data[3]) == {"a": '{"b": 2}'}
    assert tuple(quality.manifest(oracle).first()) == (4, 2, 4, 0, 2)


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(f"{k:03d}", f"{k + 1:03d}") for k in range(60)] + [("x", "y")], "a string, b string")
    assert {(r.component) for r in components(df).collect()} == {"000", "x"}


def test_jaeger_and_load_readers(spark, tmp_path):
    span = lambda i, p, op: {"traceID": "t", "spanID": i, "operationName": op, "startTime": 1, "duration": 2, "processID": "p1", "references": [{"refType": "CHILD_OF", "traceID": "t", "spanID": p}] if p else [], "tags": [{"key": "span.kind", "value": "server"}]}
    trace = {"traceID": "t", "processes": {"p1": {"serviceName": "svc"}}, "spans": [span("a", None, "root"), span("b", "a", "sub")]}
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "one.json").write_text(json.dumps({"data": [trace]}))
    (tmp_path / "j" / "two.json").write_text(json.dumps({"data": [trace, trace]}))
    assert io.read_jaeger(spark, str(tmp_path / "j")).count() == 2
    assert io.read_jaeger(spark, str(tmp_path / "j"), "root").count() == 2 and io.read_jaeger(spark, str(tmp_path / "j"), "other").count() == 0
    (tmp_path / "load.json").write_text(json.dumps({"rate": 5, "requests": [{"index": 1, "latency_ms": 2.5, "status": 200}, {"index": 2}]}))
    assert io.read_load_report(spark, str(tmp_path / "load.json")).count() == 2


@pytest.mark.parametrize("text", ['say "hi"\nthere, you', "", "é|ü"])
def test_message_csv_round_trip(spark, tmp_path, text):
    row = {c: None for c in io.MESSAGE_COLUMNS} | {"protocol_type": "HTTP/2", "data": text or None, "headers": '{"a": "b,c"}'}
    df = spark.createDataFrame([row], io.MESSAGE_SCHEMA)
    back = io.read_messages(spark, io.write_messages(df, str(tmp_path / "m"))).first()
    assert back["data"] == (text or None) and back["headers"] == '{"a": "b,c"}'
