"""Pairs of rows and candidates of calls are made once and not shuffled again; their results against SQL."""

import pytest
from pyspark.sql import functions as F

from hopgraph import plans
from hopgraph.operators import candidates as K
from hopgraph.operators import flowlog as H
from tests.test_queries import SF, con, plain  # noqa: F401


def shuffles_after_join(df):
    """Exchanges above the first join of a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    joins = [k for k, line in enumerate(plan) if "Join" in line]
    assert joins
    return sum("Exchange" in line for line in plan[:joins[0]])


@pytest.mark.parametrize("name", ["h04_rel_network", "h05_rel_network_weak", "h06_rel_syscall", "h07_rel_x_request", "h09_rel_dns", "h09_rel_dns_fields", "h21_related_ids"])
def test_relations_against_sql(spark, con, name):  # noqa: F811
    df = plans.QUERIES[name](spark, SF)
    order = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*order).collect()), key=repr)
    assert got == sorted((tuple(map(plain, r)) for r in con.sql(plans.ORACLES[name]).project(",".join(order)).fetchall()), key=repr)


@pytest.mark.parametrize("relation", [H.rel_network, H.rel_network_weak, H.rel_syscall, H.rel_x_request, H.rel_dns])
def test_pairs_are_not_shuffled(spark, relation):
    columns = "row_id string, agent string, tap_side string, type int, start_us long, end_us long, req_tcp_seq long, resp_tcp_seq long, syscall_req string, syscall_resp string, x_request_id_0 string, x_request_id_1 string, request_id long"
    assert shuffles_after_join(relation(spark.createDataFrame([], columns))) == 0


def test_rows_that_share_more_than_one_id_are_paired_once(spark):
    rows = [("a", "m", "c-p", 0, 5, 1, 2, "p", "q", "u", "v", 7), ("b", "m", "c", 109_000, 5, 1, 2, "q", "p", "v", "u", 7), ("c", "m", "c", 500_000, 5, 1, 3, "q", "", "v", "", 7)]
    rows += [("d", "n", "s", 610_000, 5, 1, 9, "", None, None, "", 7)]
    columns = "row_id string, agent string, tap_side string, start_us long, end_us long, req_tcp_seq long, resp_tcp_seq long, syscall_req string, syscall_resp string, x_request_id_0 string, x_request_id_1 string, request_id long"
    flow = spark.createDataFrame(rows, columns).withColumn("type", F.lit(H.SESSION))
    pairs = lambda df: sorted(r.a + r.b for r in df.collect())
    assert pairs(H.rel_syscall(flow)) == ["ab", "ac", "ba", "bc", "ca", "cb"]
    assert pairs(H.rel_x_request(flow)) == ["ab", "ac", "ba", "ca"]
    assert pairs(H.rel_network_weak(flow)) == ["ab", "ba", "cd", "dc"]
    assert pairs(H.rel_dns(flow)) == ["cd", "dc"]


@pytest.mark.parametrize("name", ["f2_fallback_candidates", "f3_prefer_strict", "f4_best_parent", "f5_propagate_time"])
def test_candidates_against_sql(spark, con, name):  # noqa: F811
    test_relations_against_sql(spark, con, name)


def test_candidates_of_a_call_are_ranked_where_they_were_joined(spark):
    calls = spark.createDataFrame([], "call_id string, client string, server string, start_us long, end_us long")
    for cands in (K.temporal_candidates(calls), K.fallback_candidates(calls), K.prefer_strict(K.temporal_candidates(calls))):
        assert shuffles_after_join(cands) == 0


def test_a_round_looks_only_at_edges_whose_parents_changed(spark, monkeypatch):
    rows = [("r", "ext", "s0", 0, 100)] + [(f"c{k}", f"s{k}", f"s{k + 1}", k + 1, 99 - k) for k in range(4)]
    calls = spark.createDataFrame(rows, "call_id string, client string, server string, start_us long, end_us long").withColumns({"value_a": F.lit("a"), "value_b": F.lit("b")})
    asked = []
    plain_best = K.best_parent
    monkeypatch.setattr(K, "best_parent", lambda cands, *rest: asked.append(sorted({r.client for r in cands.select("client").collect()})) or plain_best(cands, *rest))
    labels, _, whole = K.infer(calls, "time")
    assert whole and {(r.call_id, r.parent, r.label) for r in labels.collect()} == {("r", None, "r"), ("c0", "r", "r")} | {(f"c{k}", f"c{k - 1}", "r") for k in range(1, 4)}
    assert asked[:5] == [["s0"], ["s1"], ["s2"], ["s3"], []]


def test_owners_are_ranked_where_they_were_joined(spark, con):  # noqa: F811
    calls = spark.createDataFrame([], "call_id string, client string, server string, start_us long, end_us long, strong array<string>")
    assert shuffles_after_join(K.attach_db_lineage(calls, calls)) == 0
    test_relations_against_sql(spark, con, "c12_attach_db")


def test_pairs_are_not_written_and_bring_their_parents_labels(spark, monkeypatch):
    """Of seven calls two aren't contained: only these (one is the entry call) are written, and pairs don't meet the labels in a join of their own."""
    rows = [("r", "ext", "a", 0, 100)] + [(f"c{k}", "a", "b", 10 * k, 10 * k + 5) for k in range(5)] + [("late", "a", "b", 90, 200)]
    calls = spark.createDataFrame(rows, "call_id string, client string, server string, start_us long, end_us long")
    kept = []
    plain_written = K.written
    monkeypatch.setattr(K, "written", lambda df, name: kept.append(df.count()) or plain_written(df, name))
    labels = K.roots_of(calls)
    pairs = K.strict_candidates(calls, labels=labels)
    assert kept == [2]
    want = K.prefer_strict(K.temporal_candidates(calls))
    assert {(r.call_id, r.p_id) for r in pairs.collect()} == {(r.call_id, r.p_id) for r in want.collect()} == {(x[0], "r") for x in rows[1:]}
    pairs = pairs.withColumn("lineage", F.lit(0.0))
    apart = K.best_parent(pairs.drop("p_label"), labels)
    assert sorted(map(tuple, K.best_parent(pairs, None).collect())) == sorted(map(tuple, apart.collect()))
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert joins(K.best_parent(pairs, None)) == joins(pairs)
