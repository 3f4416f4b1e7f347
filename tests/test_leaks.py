"""Labels within payloads: against plain Python, and how few parts are sent to the labels."""

import random

from hopgraph.functions.substrings import possible_parts
from hopgraph.operators import quality


def test_labels_anywhere_in_payloads(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("ab-é𝄞") for _ in range(n))
    labels = sorted({word(r.choice((1, 4, 5, 9))) for _ in range(40)} - set("ab-é𝄞")) + ["trace-𝄞1"]
    data = ["", None, "trace-𝄞1", "x trace-𝄞1", "trace-𝄞1 y", "trace-𝄞", *labels, *[word(r.randrange(30)) for _ in range(300)]]
    payloads = spark.createDataFrame(list(enumerate(data)), "row long, data string").repartition(3)
    got = [x.row for x in quality.leaked_labels(payloads, spark.createDataFrame([(w,) for w in labels + labels[:3] + ["", None]], "label string")).collect()]
    assert sorted(got) == [k for k, t in enumerate(data) if t and any(w in t for w in labels)]
    assert quality.leaked_labels(payloads, spark.createDataFrame([], "label string")).count() == 0


def test_few_parts_are_sent_to_the_labels(spark):
    words = spark.createDataFrame([(f"trace-{k:09}",) for k in range(2000)], "word string")
    texts = spark.createDataFrame([(k, f'{{"k": "ord-{k}", "url": "/x?k={k}", "note": "{"trace-%09d" % k if k % 97 == 0 else "none"}"}}') for k in range(5000)], "row long, data string")
    found = possible_parts(texts, words, [15]).collect()
    held = {(k, "trace-%09d" % k) for k in range(0, 2000, 97)}
    assert held <= {tuple(x) for x in found} and len(found) < 5000  # of some 200,000 parts


def test_the_oracle_of_calls_is_made_without_payloads(spark, monkeypatch):
    rows = [("HTTP", "ext:1", "a:1", "s1", "Request", 1, "t1", "{}"), ("HTTP", "ext:1", "a:1", "s1", "Response", 2, "t1", "done"), ("HTTP", "a:2", "b:1", "s2", "Request", 1, "t1", '{"k": "t2"}'), ("HTTP", "ext:1", "a:1", "s3", "Request", 5, "t2", "{}")]
    messages = spark.createDataFrame(rows, "protocol_type string, client string, server string, stream_id string, msg_type string, time_us long, trace_id string, data string")
    plain = lambda df: sorted(map(repr, df.collect()))
    blind, oracle, problems = quality.prepare_blind(messages)
    assert sorted(tuple(r) for r in problems.collect()) == [("label-in-payload", "t1"), ("unparsed-payload", "t1")]
    assert plain(quality.blind_messages(messages)) == plain(blind)
    monkeypatch.setattr(quality.T, "scrub_json_payload", None)
    assert plain(quality.blind_oracle(messages)) == plain(oracle)
