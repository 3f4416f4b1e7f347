"""Call-shaped views of the driver tables (FIXTURES.md §2), as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_US = 1_700_000_000_000_000

CALLS = f"""
SELECT 'r-' || o_orderkey AS call_id, CAST(NULL AS STRING) AS parent_id, o_orderkey AS trace_id, 'ext' AS client, 'gateway' AS server,
  {BASE_US} + o_orderkey * 2500 AS start_us, {BASE_US} + o_orderkey * 2500 + 20000 + (o_custkey * 37) % 30000 AS end_us,
  'ord-' || o_orderkey AS value_a, 'cus-' || o_custkey AS value_b
FROM {{orders}}
UNION ALL
SELECT 'c-' || o.o_orderkey || '-' || l.n, 'r-' || o.o_orderkey, o.o_orderkey, 'gateway', 'svc' || (l.n % 3),
  {BASE_US} + o.o_orderkey * 2500 + 1000 + l.n * 1500, {BASE_US} + o.o_orderkey * 2500 + 1000 + l.n * 1500 + 2000 + (l.p * 13) % 3000,
  'ord-' || o.o_orderkey, 'prt-' || l.p
FROM (SELECT l_orderkey, l_linenumber AS n, min(l_partkey) AS p FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber) l JOIN {{orders}} o ON o.o_orderkey = l.l_orderkey
UNION ALL
SELECT 'g-' || o.o_orderkey || '-' || l.n, 'c-' || o.o_orderkey || '-' || l.n, o.o_orderkey, 'svc' || (l.n % 3), 'store',
  {BASE_US} + o.o_orderkey * 2500 + 1300 + l.n * 1500, {BASE_US} + o.o_orderkey * 2500 + 1300 + l.n * 1500 + 500 + (l.k * 11) % 1000,
  'prt-' || l.p, 'sup-' || l.k
FROM (SELECT l_orderkey, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS k FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber) l JOIN {{orders}} o ON o.o_orderkey = l.l_orderkey
WHERE l.n % 2 = 0
"""

#: The same calls with another payload: a store call knows its trace's customer, which its parent's request doesn't say,
#: and a tier that is as often another trace's as its own. Parents last longer and store calls come later, so that the
#: nearest parent is often another trace's: its parent's ancestors decide, and rare tokens among theirs.
DEEP_CALLS = f"""
SELECT c.call_id, c.parent_id, c.trace_id, c.client, c.server, c.start_us + CASE WHEN c.server = 'store' THEN o.o_orderkey * 7919 % 3000 ELSE 0 END AS start_us,
  c.end_us + CASE WHEN c.server = 'store' THEN o.o_orderkey * 7919 % 3000 WHEN c.client = 'gateway' THEN 3000 ELSE 0 END AS end_us,
  CASE WHEN c.server = 'store' THEN 'cus-' || o.o_custkey ELSE c.value_a END AS value_a, c.value_b,
  CASE WHEN c.server = 'store' THEN 'tier-' || (o.o_orderkey % 2) WHEN c.client = 'ext' THEN 'tier-' || (o.o_custkey % 2) END AS value_c
FROM ({CALLS}) c JOIN {{orders}} o ON o.o_orderkey = c.trace_id
"""

#: Calls one after another: an entry call of an order with lines 1 to 3 calls three services in turn, each once.
CHAIN_CALLS = f"""
SELECT 'r-' || o_orderkey AS call_id, CAST(NULL AS STRING) AS parent_id, 'ext' AS client, 'gateway' AS server,
  {BASE_US} + o_orderkey * 2500 AS start_us, {BASE_US} + o_orderkey * 2500 + 20000 + (o_custkey * 37) % 30000 AS end_us
FROM {{orders}} JOIN (SELECT l_orderkey FROM {{lineitem}} WHERE l_linenumber <= 3 GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) = 3) l3 ON l_orderkey = o_orderkey
UNION ALL
SELECT 'c-' || o.o_orderkey || '-' || l.n, 'r-' || o.o_orderkey, 'gateway', 'svc' || l.n,
  {BASE_US} + o.o_orderkey * 2500 + l.n * 6000 - 5000 + l.p % 700, {BASE_US} + o.o_orderkey * 2500 + l.n * 6000 - 5000 + l.p % 700 + 2000 + (l.p * 13) % 3000
FROM (SELECT l_orderkey, l_linenumber AS n, min(l_partkey) AS p FROM {{lineitem}} WHERE l_linenumber <= 3 GROUP BY l_orderkey, l_linenumber) l
  JOIN {{orders}} o ON o.o_orderkey = l.l_orderkey JOIN (SELECT l_orderkey FROM {{lineitem}} WHERE l_linenumber <= 3 GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) = 3) l3 ON l3.l_orderkey = o.o_orderkey
"""

#: Two rows a call; the response's payload is the second value.
MESSAGES = f"""
SELECT 'HTTP/1.1' AS protocol_type, k.msg_type, CASE WHEN k.msg_type = 'Request' THEN c.start_us ELSE c.end_us END AS time_us,
  c.client, c.server, c.call_id AS stream_id, CAST(c.trace_id AS STRING) AS trace_id, CASE WHEN k.msg_type = 'Request' THEN c.value_a ELSE c.value_b END AS data
FROM ({CALLS}) c CROSS JOIN (SELECT 'Request' AS msg_type UNION ALL SELECT 'Response') k
"""

#: Every 11th root position errs to the next trace, every 17th is not predicted.
PREDICTIONS = f"""
SELECT call_id, CASE WHEN (trace_id * 7 + start_us) % 17 = 0 THEN NULL WHEN (trace_id * 7 + start_us) % 11 = 0 THEN trace_id + 1 ELSE trace_id END AS label,
  CASE WHEN (trace_id * 7 + start_us) % 17 = 0 THEN NULL WHEN (trace_id * 5 + start_us) % 13 = 0 THEN 'r-' || trace_id ELSE parent_id END AS parent_pred
FROM ({CALLS}) p
"""

CONVERSATION_MESSAGES = """
SELECT conv_id AS conn, turn AS at, CASE WHEN role = 'assistant' THEN 'Response' ELSE 'Request' END AS msg_type
FROM {conversations} WHERE role IN ('user', 'assistant')
"""

LOAD_REQUESTS = """
SELECT event_id AS index, event_type AS mode, user_id % 4 AS rate, value AS latency_ms, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, ts
FROM {events}
"""

#: Each call seen from four sides, with a request and a response sequence number of its own.
FLOW_ROWS = f"""
SELECT s.k AS side_no, s.tap_side, c.call_id, c.trace_id, c.client, c.server, c.start_us + s.k * 10 AS start_us, c.end_us - s.k * 10 AS end_us,
  c.call_id || '/' || s.tap_side AS row_id,
  c.start_us % 1000003 * 8 + length(c.call_id) AS req_tcp_seq, c.end_us % 1000003 * 8 + length(c.call_id) AS resp_tcp_seq,
  CASE WHEN s.tap_side = 's-p' THEN c.call_id WHEN s.tap_side = 'c-p' THEN c.parent_id END AS syscall_id,
  CAST(c.trace_id AS STRING) AS mark
FROM ({CALLS}) c CROSS JOIN (SELECT 0 AS k, 'c-p' AS tap_side UNION ALL SELECT 1, 'c' UNION ALL SELECT 2, 's' UNION ALL SELECT 3, 's-p') s
"""

#: Rows of calls as a trace's spans, twelve kinds of trace by what connects them: system calls, x-request ids or trace ids
#: within a process; span ids from a process to a hop (3) or a hop to a process (4); x-request ids (5) or a stream (6) between hops; a
#: queue (7); trace ids alone between hops (8) or processes of a host (9); spans of applications, without (10) and with others below them (11).
SPAN_ROWS = f"""
SELECT x.call_id || '/' || x.side AS row_id, x.call_id, x.parent_id, x.trace_id AS trace, x.m, x.side, x.k AS side_no,
  CASE WHEN x.side IN ('app', 'inner') THEN 's-app' ELSE x.side END AS tap_side, CASE WHEN x.k < 2 THEN x.client ELSE x.server END AS agent,
  CASE WHEN x.side IN ('c-p', 's-p') THEN 'ebpf' WHEN x.side IN ('c', 's') THEN 'packet' ELSE 'otel' END AS source, 2 AS type,
  CASE WHEN x.m = 6 THEN 'gRPC' WHEN x.m = 7 THEN 'WebSphereMQ' ELSE 'HTTP' END AS protocol,
  x.start_us + x.k * 10 AS start_us, x.end_us - x.k * 10 AS end_us, x.end_us - x.start_us - x.k * 20 AS duration_us,
  CASE WHEN x.k < 4 THEN x.trace_id * 1000 + CAST(floor((x.start_us - {BASE_US} - x.trace_id * 2500) / 100) AS BIGINT) + 1 END AS req_tcp_seq,
  CASE WHEN x.k < 4 THEN x.trace_id * 1000 + CAST(floor((x.start_us - {BASE_US} - x.trace_id * 2500) / 100) AS BIGINT) + 1 END AS resp_tcp_seq,
  CASE WHEN x.m = 3 AND x.side = 's-p' THEN x.call_id WHEN x.m = 3 AND x.side = 'c' THEN x.parent_id WHEN x.m = 4 AND x.side = 's' THEN x.call_id WHEN x.side = 'app' THEN x.call_id WHEN x.side = 'inner' THEN x.call_id || '/in' END AS span_id,
  CASE WHEN x.m = 4 AND x.side = 'c-p' THEN x.parent_id WHEN x.side = 'app' THEN x.parent_id WHEN x.side = 'inner' THEN x.call_id END AS parent_span_id,
  CASE WHEN x.m = 1 AND x.side = 'c-p' OR x.m = 5 AND x.side = 'c' THEN x.parent_id END AS x_request_id_0, CASE WHEN x.m = 1 AND x.side = 's-p' OR x.m = 5 AND x.side = 's' THEN x.call_id END AS x_request_id_1,
  CASE WHEN x.m = 0 AND x.side = 's-p' THEN x.call_id WHEN x.m = 0 AND x.side = 'c-p' THEN x.parent_id END AS syscall_req, CAST(NULL AS STRING) AS syscall_resp,
  CASE WHEN x.m = 6 THEN x.trace_id + 1 END AS request_id, x.m = 7 AS is_async, CASE WHEN x.k < 2 AND x.m = 9 THEN x.client || '#q' WHEN x.k < 2 THEN x.client || '#p' ELSE x.server || '#p' END AS process,
  CASE WHEN x.m = 9 AND x.k < 2 THEN x.client WHEN x.m = 9 THEN x.server END AS auto_instance, CASE WHEN x.m = 9 THEN 'chost' END AS auto_instance_type, false AS local_socket
FROM (SELECT c.*, c.trace_id % 12 AS m, s.k, s.side FROM ({CALLS}) c CROSS JOIN (SELECT 0 AS k, 'c-p' AS side UNION ALL SELECT 1, 'c' UNION ALL SELECT 2, 's' UNION ALL SELECT 3, 's-p' UNION ALL SELECT 4, 'app' UNION ALL SELECT 5, 'inner') s) x
WHERE CASE WHEN x.m IN (0, 1, 2, 9) THEN x.k < 4 WHEN x.m = 3 THEN x.k BETWEEN 1 AND 3 WHEN x.m = 4 THEN x.k < 3 WHEN x.m IN (5, 6) THEN x.k BETWEEN 1 AND 2
  WHEN x.m IN (7, 8) THEN x.k = CASE WHEN x.client = 'ext' THEN 1 ELSE 2 END WHEN x.m = 10 THEN x.k = 4 ELSE x.k > 3 END
"""

#: Calls as provenance observations. Two traces overlap, the next two come 200 ms later, so that components are small.
#: The response's field is the customer modulo 50, missing in some traces; some entry calls have another operation.
OBSERVATIONS = f"""
SELECT x.event_id, x.parent_id, x.trace_id, x.caller, x.callee, (x.start_us + x.shift) * 1000 AS start_ns, (x.end_us + x.shift) * 1000 AS end_ns, x.value, x.operation
FROM (SELECT c.call_id AS event_id, c.parent_id, c.trace_id, c.client AS caller, c.server AS callee, c.start_us, c.end_us,
  CAST(floor(c.trace_id / 2) AS BIGINT) * 200000 + c.trace_id % 2 * 3000 - c.trace_id * 2500 AS shift,
  CASE WHEN c.trace_id % 23 <> 0 THEN CAST(o.o_custkey % 50 AS STRING) END AS value,
  CASE WHEN c.server = 'gateway' AND c.trace_id % 10 = 0 THEN 'health' ELSE 'get ' || c.server END AS operation
FROM ({CALLS}) c JOIN {{orders}} o ON o.o_orderkey = c.trace_id) x
"""

#: Messages with JSON payloads that hold identifiers: all have a trace id field, some entry requests speak of their label, some responses aren't JSON.
LABELLED = f"""
SELECT m.protocol_type, m.msg_type, m.time_us, m.client, m.server, m.stream_id, m.label AS trace_id, m.data AS bare,
  CASE WHEN m.n % 97 = 0 AND m.client = 'ext' AND m.msg_type = 'Request' THEN chr(123) || '"note": "for ' || m.label || '"' || chr(125) WHEN m.n % 89 = 0 AND m.client = 'ext' AND m.msg_type = 'Response' THEN 'done ' || m.label
    ELSE chr(123) || '"Trace-Id": "' || m.label || '", "k": "' || m.data || '", "url": "/x?span_id=' || m.label || '&k=1"' || chr(125) END AS data
FROM (SELECT x.*, CAST(x.trace_id AS BIGINT) AS n, 'trace-' || lpad(x.trace_id, 9, '0') AS label FROM ({MESSAGES}) x) m
"""

VIEWS = {
    "calls": CALLS, "deep_calls": DEEP_CALLS, "chain_calls": CHAIN_CALLS, "messages": MESSAGES, "predictions": PREDICTIONS, "conversation_messages": CONVERSATION_MESSAGES,
    "load_requests": LOAD_REQUESTS, "flow_rows": FLOW_ROWS, "span_rows": SPAN_ROWS, "observations": OBSERVATIONS, "labelled": LABELLED,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    sql = VIEWS[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", sql))})


def duck(*names: str) -> str:
    """The views as a WITH prefix of DuckDB SQL."""
    return "WITH " + ", ".join(f"{n} AS (" + re.sub(r"\{(\w+)\}", r"\1", VIEWS[n]) + ")" for n in names) + " "
