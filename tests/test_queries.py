"""Registered queries of the trace operators against their SQL on the smallest tables."""

import math

import pytest

from hopgraph import plans
from hopgraph.plans.fixtures import VIEWS  # noqa: F401

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
QUICK = ["a1_messages_csv", "a4_jaeger_spans", "a6_load_reports", "b07_pair_fifo", "b10_pair_messages", "b16_complete_traces", "c07_edge_idf", "c12_extend_owners", "e7_child_order_fallback", "e8_temporal_profile", "e9_delay_chain", "f1_temporal_candidates", "f8_causal_parent", "g6_topk", "h02_merge_sessions", "h10_relations", "h12_hop_chains", "h14_process_parents", "h15_connect_by_rules", "h17_self_time", "h18_service_uids", "p2_value_time_edges", "q3_build_oracle", "v04_parent_edges", "v10_flow_causes", "v11_load_summary", "v11_load_timing", "v12_max_concurrency", "v14_overhead_by_repeat", "v16_ablation"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else None
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    rel = con.sql(plans.ORACLES[name])
    order = sorted(df.columns)
    assert sorted(rel.columns) == order
    quoted = ",".join(f'"{c}"' for c in order)
    got = sorted((tuple(map(plain, r)) for r in df.select(*order).collect()), key=repr)
    assert got == sorted((tuple(map(plain, r)) for r in rel.project(quoted).fetchall()), key=repr)


def test_every_query_has_a_name_of_its_own():
    assert len(plans.QUERIES) > 100 and set(plans.ORACLES) <= set(plans.QUERIES)
