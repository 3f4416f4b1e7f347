"""Blind preparation, truth inventories and validation of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopgraph.functions import tokens as T
from hopgraph.functions.substrings import possible_parts
from hopgraph.operators.candidates import labels_from_parents
from hopgraph.operators.common import written

BLIND_COLUMNS = ["protocol_type", "client", "server", "stream_id", "msg_type", "time_us", "data"]


PROTOCOLS = ["http", "http1", "http2", "http/1.1", "http/2", "grpc"]


def leaked_labels(payloads: DataFrame, labels: DataFrame) -> DataFrame:
    """payloads(row, data), labels(label) -> row of every payload that holds some label anywhere.

    Parts of a payload that are as long as some label are looked up in a bitmap of the labels' hashes of bounded size, and
    only those that can be labels meet the labels in an equi-join, which decides. There are few lengths of labels.
    """
    labels = written(labels.select(F.col("label").alias("word")).where("word <> ''").distinct(), "labels")
    sizes = [r.size for r in labels.select(F.length("word").alias("size")).distinct().collect()]
    return possible_parts(payloads, labels, sizes).join(labels, "word", "left_semi").select("row").distinct()


CALL = ["client", "server", "stream_id"]


def blind_oracle(messages: DataFrame) -> DataFrame:
    """The oracle of calls of ``prepare_blind``; payloads aren't read for it."""
    return _oracle(_by_call(messages))[0]


def _by_call(m: DataFrame) -> DataFrame:
    by_call = m.groupBy(*CALL).agg(
        F.countDistinct("trace_id").alias("labels"), F.array_sort(F.collect_set("msg_type")).alias("kinds"), F.count("*").alias("rows"), F.min("trace_id").alias("trace_id")
    )
    return written(by_call, "blind-calls")


def _oracle(by_call: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls with their label and whether they are entries, entry calls by label)."""
    host = lambda c: F.substring_index(c, ":", 1)
    paired = by_call.where(F.size("kinds") == 2)
    entries = paired.join(paired.select(host("server").alias("host")).distinct(), host("client") == F.col("host"), "left_anti")
    roots = entries.groupBy("trace_id").agg(F.count("*").alias("roots"), F.min(F.struct(*CALL)).alias("root"))
    oracle = by_call.join(roots.select("trace_id", "root"), "trace_id", "left").select(*CALL, "trace_id", "kinds", F.coalesce(F.struct(*CALL) == F.col("root"), F.lit(False)).alias("entry"))
    return oracle, roots


def blind_messages(messages: DataFrame) -> DataFrame:
    """The messages of ``prepare_blind``."""
    return messages.withColumn("data", F.coalesce(T.scrub_json_payload("data"), F.lit("{}"))).select(*BLIND_COLUMNS)


def prepare_blind(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages without labels and with scrubbed payloads, oracle of calls, problems (problem, trace_id)).

    A payload that isn't JSON is reported and not passed on. Entry calls are found: paired calls from clients
    that serve nothing. Problems are protocols and rows that don't belong here, labels that conflict, directions
    seen twice, unparsed payloads, labels anywhere in a scrubbed payload, and traces with several entry calls.
    """
    m = messages.withColumn("clean", T.scrub_json_payload("data")).withColumn("row", F.xxhash64(*CALL, "msg_type", "time_us", "trace_id", "data"))
    m = written(m, "blind-messages")
    by_call = _by_call(m)
    oracle, roots = _oracle(by_call)
    problem = lambda df, name: df.select(F.lit(name).alias("problem"), "trace_id").distinct()
    labels = m.where("trace_id <> ''").select(F.col("trace_id").alias("label")).distinct()
    leaks = leaked_labels(m.where("clean is not null").select("row", F.col("clean").alias("data")), labels)
    bad = F.coalesce(~F.col("msg_type").isin("Request", "Response"), F.lit(True)) | F.coalesce(F.col("trace_id") == "", F.lit(True))
    problems = (
        problem(m.where(~F.coalesce(F.lower(F.trim("protocol_type")).isin(PROTOCOLS), F.lit(False))), "protocol").unionByName(problem(m.where(bad), "direction-or-label-missing"))
        .unionByName(problem(by_call.where("labels > 1"), "label-conflict")).unionByName(problem(by_call.where("rows > size(kinds)"), "direction-twice"))
        .unionByName(problem(m.where("clean is null"), "unparsed-payload")).unionByName(problem(m.join(leaks, "row", "left_semi"), "label-in-payload"))
        .unionByName(problem(roots.where("roots > 1"), "several-entry-calls"))
    )
    return m.drop("data").withColumn("data", F.coalesce("clean", F.lit("{}"))).select(*BLIND_COLUMNS), oracle, problems


def manifest(oracle: DataFrame) -> DataFrame:
    n = lambda c: F.sum(c.cast("long"))
    return oracle.agg(
        F.count("*").alias("calls"), F.countDistinct("trace_id").alias("traces"), n(F.size("kinds") == 2).alias("complete"), n(F.size("kinds") < 2).alias("unpaired"),
        F.countDistinct(F.when(F.col("entry"), F.col("trace_id"))).alias("entry_traces"),
    )


def validate_truth(rpcs: DataFrame, requests: DataFrame) -> DataFrame:
    """rpcs(request_id, span_id, parent_span_id), requests(request_id) -> (problem, request_id, span_id)."""
    out = lambda df, name: df.select(F.lit(name).alias("problem"), "request_id", "span_id")
    twice = rpcs.groupBy("request_id", "span_id").agg(F.count("*").alias("n")).where("n > 1")
    p = rpcs.select(F.col("span_id").alias("parent_span_id"), F.col("request_id").alias("p_request"))
    child = rpcs.where("parent_span_id is not null").join(p, "parent_span_id", "left")
    roots = rpcs.where("parent_span_id is null").groupBy("request_id").agg(F.count("*").alias("n"), F.min("span_id").alias("span_id"))
    bad_roots = requests.select("request_id").join(roots, "request_id", "left").where("n is null or n > 1")
    tree = rpcs.select(F.col("span_id").alias("call_id"), F.col("parent_span_id").alias("parent"))
    reached = labels_from_parents(tree, tree.where("parent is null").select("call_id", F.lit("r").alias("label")))
    cyclic = rpcs.join(reached.select(F.col("call_id").alias("span_id")), "span_id", "left_anti").join(p.select("parent_span_id"), "parent_span_id", "left_semi")
    return (
        out(twice, "duplicate-span").unionByName(out(child.where("p_request is null"), "unknown-parent")).unionByName(out(child.where("p_request <> request_id"), "cross-request-parent"))
        .unionByName(out(bad_roots, "not-one-root")).unionByName(out(cyclic, "cycle-or-below-one"))
    )


def build_oracle(truth: DataFrame, calls: DataFrame) -> DataFrame:
    """truth(observation_id, trace_id, parent_observation) with the captured call of each; unobserved ones are placeholders."""
    j = truth.join(calls.select("observation_id", "call_id"), "observation_id", "left")
    key = F.coalesce("call_id", F.concat(F.lit("missing:"), "observation_id"))
    j = j.select("observation_id", key.alias("key"), "trace_id", "parent_observation", F.col("call_id").isNotNull().alias("observed"))
    p = j.select(F.col("observation_id").alias("parent_observation"), F.col("key").alias("parent_key"))
    return j.join(p, "parent_observation", "left").select("key", "trace_id", "parent_key", "observed")


def validate_oracle(independent: DataFrame, captured: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """What is wrong with a truth of all calls, against what was captured: counts by problem, all of them zero if it can be used.

    independent(key, trace_id, parent_key), captured(key, trace_id) and, if known, requests(trace_id): the traces that
    were asked for, each of which the truth must have and no other.
    """
    twice = independent.groupBy("key").agg(F.count("*").alias("n")).where("n > 1 or key is null")
    roots = independent.groupBy("trace_id").agg(F.sum(F.col("parent_key").isNull().cast("int")).alias("roots"))
    known = independent.select(F.col("key").alias("parent_key"), F.col("trace_id").alias("p_trace")).distinct()
    up = independent.where("parent_key is not null").join(known, "parent_key", "left")
    seen = captured.join(independent.select("key", F.col("trace_id").alias("said")).distinct(), "key", "left")
    rows = [
        ("duplicate", twice), ("no-trace", independent.where("trace_id is null")), ("no-root", roots.where("roots = 0")), ("several-roots", roots.where("roots > 1")),
        ("bad-parent", up.where("p_trace is null or p_trace <> trace_id or parent_key = key")), ("captured-but-omitted", seen.where("said is null")), ("label-disagrees", seen.where("said <> trace_id")),
    ]
    if requests is not None:
        traces = independent.select("trace_id").distinct()
        rows += [("request-without-trace", requests.select("trace_id").distinct().join(traces, "trace_id", "left_anti")), ("trace-without-request", traces.join(requests, "trace_id", "left_anti"))]
    out = None
    for name, df in rows:
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def validate_predictions(pred: DataFrame, oracle: DataFrame) -> DataFrame:
    """pred(key, root_key, parent_key), oracle(key, trace_id) -> counts by problem."""
    roots = oracle.where("parent_key is null").select(F.col("key").alias("root_key"))
    rows = [
        ("duplicate", pred.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")),
        ("unknown", pred.select("key").join(oracle, "key", "left_anti")),
        ("omitted", oracle.select("key").join(pred, "key", "left_anti")),
        ("unknown-root", pred.where("root_key is not null").join(roots, "root_key", "left_anti").select("key")),
    ]
    out = None
    for name, df in rows:
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
        out = n if out is None else out.unionByName(n)
    return out
