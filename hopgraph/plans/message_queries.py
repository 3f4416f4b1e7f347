"""Queries of sources, message and token operators (A, B, C)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hopgraph.functions import columns as N
from hopgraph.functions import tokens as T
from hopgraph.operators import pairing as B
from hopgraph.operators.reassembly import reassemble_http1
from hopgraph.plans.fixtures import duck, table, view
from hopgraph.plans.registry import ORACLES, query
from hopgraph.sources import io

M = duck("messages")
C = duck("calls")


@query("a1_messages_csv", M + "SELECT protocol_type, msg_type, time_us, client, server, stream_id, trace_id, data FROM messages")
def a1(spark, d):
    path = io.write_messages(io.from_fixture(view(spark, d, "messages")))
    m = io.read_messages(spark, path)
    return m.select("protocol_type", "msg_type", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("time_us"), "client", "server", "stream_id", "trace_id", "data")


@query("a2_write_messages", M + "SELECT stream_id, count(*) AS n, min(time_us) AS first_us, string_agg(data, '|' ORDER BY time_us, msg_type) AS data FROM messages GROUP BY 1")
def a2(spark, d):
    """The written files, read as plain CSV."""
    path = io.write_messages(io.from_fixture(view(spark, d, "messages")))
    rows = spark.read.option("header", True).csv(path).withColumn("time_us", F.unix_micros(F.to_timestamp("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    parts = F.array_sort(F.collect_list(F.struct("time_us", "msg_type", "data")))
    return rows.groupBy("stream_id").agg(F.count("*").alias("n"), F.min("time_us").alias("first_us"), F.array_join(F.transform(parts, lambda x: x["data"]), "|").alias("data"))


@query("a3_observations_jsonl", duck("observations") + "SELECT event_id, caller, callee, start_ns, end_ns, value FROM observations")
def a3(spark, d):
    path = io.write_observations(view(spark, d, "observations"))
    return io.read_observations(spark, path).select("event_id", "caller", "callee", "start_ns", "end_ns", F.col("response")["value"].alias("value"))


@query("a4_jaeger_spans", C + "SELECT CAST(trace_id AS VARCHAR) AS trace_id, call_id AS sid, parent_id AS parent_sid, start_us, end_us - start_us AS duration_us, client || '>' || server AS op_name, server AS process FROM calls")
def a4(spark, d):
    calls = view(spark, d, "calls")
    spans = calls.select(
        F.col("trace_id").cast("string").alias("trace_id"), F.col("call_id").alias("sid"), F.col("parent_id").alias("parent_sid"), "start_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"),
        F.concat_ws(">", "client", "server").alias("op_name"), F.col("server").alias("process"),
    )
    read = io.read_jaeger(spark, io.write_jaeger(spans), lines=True)
    return read.select("trace_id", "sid", F.get("references", F.lit(0))["sid"].alias("parent_sid"), "start_us", "duration_us", "op_name", "process")


@query("a6_load_reports", duck("load_requests") + "SELECT CAST(rate AS DOUBLE) AS rate, index, mode AS mark, latency_ms, status FROM load_requests")
def a6(spark, d):
    requests = view(spark, d, "load_requests").withColumnRenamed("mode", "mark")
    return io.read_load_report(spark, io.write_load_report(requests), lines=True).select("rate", "index", "mark", "latency_ms", "status")


@query("a5_flow_window", duck("flow_rows") + "SELECT row_id, start_us FROM flow_rows WHERE start_us BETWEEN 1700000002500000 AND 1700000009000000 AND mark LIKE '1%' ORDER BY start_us, row_id LIMIT 500")
def a5(spark, d):
    return io.read_flow_log(view(spark, d, "flow_rows"), 1700000002500000, 1700000009000000, "1", 500).select("row_id", "start_us")


@query("a7_paired_calls", C + "SELECT call_id, trace_id, client, server, start_us, end_us, value_a AS req_data, value_b AS res_data FROM calls")
def a7(spark, d):
    calls = view(spark, d, "calls").withColumnsRenamed({"value_a": "req_data", "value_b": "res_data"})
    return spark.read.parquet(io.write_paired(calls.select("call_id", "trace_id", "client", "server", "start_us", "end_us", "req_data", "res_data")))


H = """WITH h AS (SELECT user_id, event_id, event_type FROM events)
"""


@query("b01_trace_context", H + """SELECT event_id, CASE event_type WHEN 'click' THEN 't' || user_id WHEN 'view' THEN 'm' || event_id WHEN 'error' THEN 'b' || user_id ELSE 'r' || event_id END AS trace_id,
  CASE event_type WHEN 'click' THEN 's' || event_id WHEN 'error' THEN 'bs' END AS span_id, CASE WHEN event_type = 'click' AND event_id % 2 = 1 THEN 'p' || event_id END AS parent_span_id FROM h""")
def b01(spark, d):
    e = table(spark, d, "events")
    u, i = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    parent = F.when(F.col("event_id") % 2 == 1, F.concat(F.lit("p"), i)).otherwise("0")
    headers = (
        F.when(F.col("event_type") == "click", F.create_map(F.lit("Uber-Trace-Id"), F.concat(F.lit("t"), u, F.lit(":s"), i, F.lit(":"), parent, F.lit(":1\r\n")), F.lit("x-mark"), F.lit("no")))
        .when(F.col("event_type") == "view", F.create_map(F.lit("X-Mark"), F.concat(F.lit("m"), i, F.lit("\\r\\n")), F.lit("X-Request-Id"), F.lit("no")))
        .when(F.col("event_type") == "error", F.create_map(F.lit("X-B3-TraceId"), F.concat(F.lit("b"), u), F.lit("X-B3-SpanId"), F.lit("bs")))
        .otherwise(F.create_map(F.lit("uber-trace-id"), F.lit("a:b"), F.lit("X-Request-ID"), F.concat(F.lit("r"), i)))
    )
    return e.select("event_id", N.trace_context(headers).alias("c")).select("event_id", "c.*")


@query("b02_endpoints", C + "SELECT call_id, client AS host, least(client, server) || ':80|' || greatest(client, server) || ':80' AS conn FROM calls")
def b02(spark, d):
    c = view(spark, d, "calls").withColumn("a", F.concat("client", F.lit(":80"))).withColumn("b", F.concat("server", F.lit(":80")))
    return c.select("call_id", N.endpoint_host(F.col("a")).alias("host"), N.conn_key(F.col("a"), F.col("b")).alias("conn"))


@query("b03_drop_hosts", C + "SELECT call_id FROM calls WHERE client <> 'ext' AND server <> 'svc0' AND client <> 'svc0'")
def b03(spark, d):
    return B.drop_hosts(B.drop_loopback(view(spark, d, "calls")), ["ext", "svc0"]).select("call_id")


SEG = """WITH s AS (SELECT event_type AS msg_type, user_id AS src, user_id % 7 AS dst, event_id % 997 AS tcp_seq, props AS payload, event_id % 5 AS n_headers, event_id AS "at", CASE WHEN event_id % 2 = 0 THEN 'OUT' ELSE 'IN' END AS direction, event_id * 1000 AS time_us FROM events)
"""


def segments(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select(
        F.col("event_type").alias("msg_type"), F.col("user_id").alias("src"), (F.col("user_id") % 7).alias("dst"), (i % 997).alias("tcp_seq"), F.col("props").alias("payload"),
        (i % 5).alias("n_headers"), i.alias("at"), F.when(i % 2 == 0, "OUT").otherwise("IN").alias("direction"), (i * 1000).alias("time_us"),
    )


@query("b04_dedupe_observations", SEG + """, r AS (SELECT *, row_number() OVER (PARTITION BY msg_type, src, dst, tcp_seq ORDER BY length(payload) DESC, n_headers DESC, "at") AS k FROM s)
SELECT msg_type, src, dst, tcp_seq, max(payload) FILTER (k = 1) AS payload, min(time_us) FILTER (direction = 'OUT') AS out_us, min(time_us) FILTER (direction = 'IN') AS in_us, min(time_us) AS time_us, count(*) AS "rows" FROM r GROUP BY 1, 2, 3, 4""")
def b04(spark, d):
    return B.dedupe_observations(segments(spark, d))


@query("b05_dedupe_segments", SEG + "SELECT DISTINCT src, dst, tcp_seq, payload FROM s")
def b05(spark, d):
    return B.dedupe_segments(segments(spark, d)).select("src", "dst", "tcp_seq", "payload")


@query("b06_reassemble_http1", "SELECT conv_id AS flow, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, text AS body FROM conversations")
def b06(spark, d):
    c = table(spark, d, "conversations")
    body = F.encode("text", "UTF-8")
    message = F.concat(F.encode(F.concat(F.lit("POST /x HTTP/1.1\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n")), "UTF-8"), body)
    m = c.select("conv_id", "turn", message.alias("m")).withColumn("size", F.octet_length("m").cast("long"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    half = F.expr("cast(size div 2 as int)")
    piece = lambda i, at, payload: F.struct(i.alias("late"), at.alias("seq"), payload.alias("payload"))
    # The second half comes first and reaches into the first one; the very first segment tells where the flow begins.
    m = m.withColumn("seq0", before + 1)
    seq = F.col("seq0")
    pieces = F.array(piece(F.lit(2), seq + half - 5, F.substring("m", half - 4, F.col("size").cast("int"))), piece(F.when(F.col("turn") == 0, 1).otherwise(3), seq, F.substring("m", F.lit(1), half)))
    s = m.withColumn("p", F.explode(pieces)).select(F.col("conv_id").alias("flow"), (F.col("turn") * 10 + F.col("p.late")).alias("time_us"), "p.seq", "p.payload")
    return reassemble_http1(s).select("flow", "n", "body")


@query("b07_pair_fifo", duck("conversation_messages") + """, b AS (SELECT *, sum(CASE WHEN msg_type = 'Request' THEN 1 ELSE -1 END) OVER (PARTITION BY conn ORDER BY "at") AS bal FROM conversation_messages),
l AS (SELECT *, least(min(bal) OVER (PARTITION BY conn ORDER BY "at"), 0) AS low FROM b), p AS (SELECT *, coalesce(lag(low) OVER (PARTITION BY conn ORDER BY "at"), 0) AS prev FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY conn, msg_type ORDER BY "at") AS n FROM p WHERE msg_type = 'Request' OR low = prev)
SELECT q.conn, q."at" AS req_at, r."at" AS res_at FROM n q LEFT JOIN n r ON r.conn = q.conn AND r.n = q.n AND r.msg_type = 'Response' WHERE q.msg_type = 'Request'""")
def b07(spark, d):
    return B.pair_fifo(view(spark, d, "conversation_messages"))


@query("b08_pair_by_stream", M + """SELECT client, server, stream_id, min(time_us) FILTER (msg_type = 'Request') AS start_us, min(time_us) FILTER (msg_type = 'Response') AS end_us,
  list_sort(list(DISTINCT data) FILTER (msg_type = 'Request')) AS req_data, list_sort(list(DISTINCT data) FILTER (msg_type = 'Response')) AS res_data FROM messages GROUP BY 1, 2, 3""")
def b08(spark, d):
    return B.pair_by_stream(view(spark, d, "messages"))


@query("b09_pair_by_request_id", """SELECT q.conn, q.request_id, q.start_us, r.end_us, r.results FROM (SELECT user_id AS conn, event_id // 2 AS request_id, min(event_id) AS start_us FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2) q
LEFT JOIN (SELECT user_id AS conn, event_id // 2 AS request_id, min(event_id) AS end_us, list_sort(list(DISTINCT event_type)) AS results FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2) r USING (conn, request_id)""")
def b09(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("conn"), F.expr("event_id div 2").alias("k"), F.col("event_id").alias("time_us"), F.col("event_type").alias("result"))
    return B.pair_by_request_id(e.where("time_us % 3 <> 0").withColumnRenamed("k", "request_id"), e.where("time_us % 3 = 0").withColumnRenamed("k", "response_to"))


@query("b10_pair_messages", C + "SELECT client, server, call_id AS stream_id, CAST(trace_id AS STRING) AS trace_id, start_us, end_us, value_a AS req_data, value_b AS res_data FROM calls")
def b10(spark, d):
    return B.pair_messages(view(spark, d, "messages"))


@query("b10_pair_messages_strict", C + "SELECT client, server, call_id AS stream_id, CAST(trace_id AS STRING) AS trace_id, start_us, greatest(end_us, start_us + 1) AS end_us, value_a AS req_data, value_b AS res_data FROM calls WHERE end_us >= start_us")
def b10s(spark, d):
    return B.pair_messages(view(spark, d, "messages"), strict=True)


@query("b11_unique_items", "WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents) SELECT doc_id, len(list_distinct(w)) AS n, w[1] AS head FROM w")
def b11(spark, d):
    w = table(spark, d, "documents").select("doc_id", N.unique_keep_order(F.split("text", " ")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n"), F.get("w", F.lit(0)).alias("head"))


@query("b12_network_duration", C + "SELECT call_id, abs(start_us - end_us) AS network_us FROM calls")
def b12(spark, d):
    return view(spark, d, "calls").select("call_id", N.network_duration_us(F.col("start_us"), F.col("end_us")).alias("network_us"))


@query("b13_rpc_spans", C + """SELECT trace_id, call_id AS span_id, parent_id AS parent_span_id, CASE WHEN parent_id IS NULL THEN 'server' ELSE 'client' END AS kind,
  CASE WHEN parent_id IS NULL THEN server ELSE client END AS endpoint, CASE WHEN parent_id IS NULL THEN client ELSE server END AS peer FROM calls""")
def b13(spark, d):
    return B.to_span_rows(view(spark, d, "calls"))


@query("b14_client_server_spans", C + """SELECT trace_id, call_id AS span_id, parent_id AS parent_span_id, CASE WHEN parent_id IS NULL THEN 'server' ELSE 'client' END AS kind, CASE WHEN parent_id IS NULL THEN server ELSE client END AS endpoint, CASE WHEN parent_id IS NULL THEN client ELSE server END AS peer FROM calls
UNION ALL SELECT trace_id, substr(sha256(trace_id || '|' || call_id || '|server'), 1, 16), call_id, 'server', server, client FROM calls WHERE parent_id IS NOT NULL""")
def b14(spark, d):
    return B.to_span_rows(view(spark, d, "calls"), "client-server")


@query("b15_message_rows", M + "SELECT client, server, stream_id AS call_id, msg_type, time_us, data FROM messages")
def b15(spark, d):
    return B.to_message_rows(view(spark, d, "calls"))


SIZES = C + """, n AS (SELECT trace_id, count(*) AS n FROM calls GROUP BY 1), m AS (SELECT list_sort(list(n))[count(*) // 2 + 1] AS med FROM n), bad AS (SELECT trace_id, n FROM n, m WHERE n < floor(0.75 * med))
"""


@query("b16_complete_traces", SIZES + "SELECT call_id FROM calls WHERE trace_id NOT IN (SELECT trace_id FROM bad)")
def b16(spark, d):
    return B.filter_complete_traces(view(spark, d, "calls"))[0].select("call_id")


@query("b16_removed_traces", SIZES + "SELECT trace_id, n FROM bad")
def b16b(spark, d):
    return B.filter_complete_traces(view(spark, d, "calls"))[1]


@query("b16_expected_traces", C + ", n AS (SELECT trace_id FROM calls GROUP BY 1 HAVING count(*) = 4) SELECT call_id FROM calls WHERE trace_id IN (SELECT trace_id FROM n) OR server = 'store'")
def b16c(spark, d):
    return B.filter_complete_traces(view(spark, d, "calls"), 4, F.col("server") == "store")[0].select("call_id")


@query("b17_client_spans", C + """SELECT trace_id, call_id AS sid, server AS process, 'server' AS kind, CASE WHEN parent_id IS NOT NULL THEN call_id || '_client' END AS parent FROM calls
UNION ALL SELECT c.trace_id, c.call_id || '_client', p.server, 'client', c.parent_id FROM calls c JOIN calls p ON p.call_id = c.parent_id""")
def b17(spark, d):
    spans = view(spark, d, "calls").select("trace_id", F.col("call_id").alias("sid"), F.col("server").alias("process"), F.lit("server").alias("kind"), F.col("parent_id").alias("parent"))
    return B.synthesize_clients(spans)


@query("b18_restrict_complete", C + """, k AS (SELECT trace_id FROM calls WHERE client = 'gateway' GROUP BY 1 HAVING count(DISTINCT server) = 3) SELECT call_id FROM calls WHERE trace_id IN (SELECT trace_id FROM k)""")
def b18(spark, d):
    edges = spark.createDataFrame([("gateway", f"svc{k}") for k in range(3)], "client string, server string")
    return B.restrict_complete(view(spark, d, "calls"), edges).select("call_id")


@query("b19_infer_ports", """WITH s AS (SELECT DISTINCT CASE event_type WHEN 'click' THEN 8000 + user_id % 5 WHEN 'view' THEN 8003 + user_id % 5 END AS port, CASE event_type WHEN 'click' THEN 'HTTP/2' WHEN 'view' THEN 'HTTP/1' END AS protocol FROM events WHERE event_type IN ('click', 'view'))
SELECT * FROM s WHERE protocol = 'HTTP/2' OR port NOT IN (SELECT port FROM s WHERE protocol = 'HTTP/2')""")
def b19(spark, d):
    k = F.col("event_type")
    low = F.when(k == "click", 8000 + F.col("user_id") % 5).otherwise(8003 + F.col("user_id") % 5)
    high = F.lit(40000).cast("long") + F.col("user_id")
    payload = F.when(k == "click", "PRI * HTTP/2.0").when(k == "view", F.when(F.col("event_id") % 2 == 0, "GET / HTTP/1.1").otherwise("HTTP/1.1 200 OK")).otherwise("x")
    answer = (k == "view") & (F.col("event_id") % 2 == 1)
    e = table(spark, d, "events").select(F.when(answer, low).otherwise(high).alias("src_port"), F.when(answer, high).otherwise(low).alias("dst_port"), payload.alias("payload"))
    return B.infer_ports(e)


@query("c01_normalize", """SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE printf('%.3f', value) END AS v, lower(event_type) || 'x' AS w FROM events""")
def c01(spark, d):
    raw = F.when(F.col("event_type") == "error", " NULL ").otherwise(F.concat(F.lit("  "), F.format_string("%.2f", "value"), F.lit(" ")))
    return table(spark, d, "events").select("event_id", N.normalize_value(raw).alias("v"), N.normalize_value(F.concat(F.lit(" "), F.upper("event_type"), F.lit("X"))).alias("w"))


@query("c02_html_noise", """SELECT page_id, true AS html, length(url) > 1000 AS link FROM pages""")
def c02(spark, d):
    return table(spark, d, "pages").select("page_id", N.is_html_noise(F.col("html")).alias("html"), N.is_html_noise(F.col("url")).alias("link"))


@query("c03_derived_tokens", """WITH p AS (SELECT page_id, list_filter(regexp_split_to_array(lower(url), '[^a-z0-9]+'), lambda x: length(x) >= 2 AND x NOT IN ('http', 'https', 'json', 'true', 'false')) AS p FROM pages)
SELECT page_id, list_sort(list_distinct(list_concat(list_transform(p, lambda x: 'p:' || x), list_transform(list_filter(p, lambda x: regexp_full_match(x, '[a-z]*[0-9]{3,8}')), lambda x: 'n:' || regexp_extract(x, '([0-9]{3,8})$', 1))))) AS tokens FROM p""")
def c03(spark, d):
    return table(spark, d, "pages").select("page_id", N.derived_tokens(F.lower("url")).alias("tokens"))


@query("c04_payload_tokens", """SELECT event_id, CASE WHEN CAST(props->>'k' AS INT) IN (0, 1) THEN [] WHEN CAST(props->>'k' AS INT) < 10 THEN ['kv:k=' || (props->>'k'), 'v:' || (props->>'k')]
  ELSE ['kv:k=' || (props->>'k'), 'p:' || (props->>'k'), 'v:' || (props->>'k')] END AS tokens FROM events""")
def c04(spark, d):
    return table(spark, d, "events").select("event_id", T.lineage_tokens("props").alias("tokens"))


PAYLOAD_TOKENS = ORACLES["c04_payload_tokens"]


@query("c04_nested_tokens", PAYLOAD_TOKENS)
def c04b(spark, d):
    """The same payload as a string inside JSON inside a list: what it holds counts alike."""
    inner = F.concat(F.lit("["), F.to_json(F.struct(F.col("props").alias("body"))), F.lit("]"))
    return table(spark, d, "events").select("event_id", T.lineage_tokens(F.to_json(F.struct(inner.alias("outer")))).alias("tokens"))


@query("c05_db_tokens", """SELECT event_id, list_sort(list_filter(['kv:k=' || (props->>'k'), 'v:' || (props->>'k'), 'p:' || (props->>'k')], lambda x: CASE WHEN CAST(props->>'k' AS INT) IN (0, 1) THEN x LIKE 'kv:%' WHEN CAST(props->>'k' AS INT) < 10 THEN x NOT LIKE 'p:%' ELSE true END)) AS tokens FROM events""")
def c05(spark, d):
    wrapped = F.concat(F.lit('{"query": {"filter": '), F.col("props"), F.lit(', "$db": "shop"}}'))
    return table(spark, d, "events").select("event_id", T.db_lineage_tokens(wrapped).alias("tokens"))


@query("c05_nested_db_tokens", ORACLES["c05_db_tokens"])
def c05b(spark, d):
    inner = F.to_json(F.struct(F.array(F.col("props")).alias("documents")))
    return table(spark, d, "events").select("event_id", T.db_lineage_tokens(F.to_json(F.struct(F.struct(inner.alias("filter")).alias("query")))).alias("tokens"))


@query("c06_db_result_filter", """SELECT event_id, list_sort(list_filter(['kv:k=' || (event_id % 9), 'kv:hotelid=x', 'kv:note=z', 'v:q'], lambda x: x LIKE 'kv:hotelid%' OR (x LIKE 'kv:k=%' AND event_id % 9 = user_id % 9))) AS tokens FROM events""")
def c06(spark, d):
    req = F.array(F.concat(F.lit("v:"), (F.col("user_id") % 9).cast("string")))
    res = F.array(F.concat(F.lit("kv:k="), (F.col("event_id") % 9).cast("string")), F.lit("kv:hotelid=x"), F.lit("kv:note=z"), F.lit("v:q"))
    return table(spark, d, "events").select("event_id", N.filter_db_result_tokens(req, res).alias("tokens"))


@query("c08_token_weights", """SELECT event_id, round(greatest(value, 0.5), 6) AS a, round(0.9 * greatest(value, 0.5), 6) AS decayed FROM events""")
def c08(spark, d):
    one, two = F.create_map(F.lit("a"), F.col("value")), F.create_map(F.lit("a"), F.lit(0.5))
    m = N.merge_weights(one, two)
    return table(spark, d, "events").select("event_id", F.round(m["a"], 6).alias("a"), F.round(N.decay_weights(m, 0.9)["a"], 6).alias("decayed"))


@query("c13_scrub", """SELECT event_id, '{"k": ' || (props->>'k') || '}' AS data FROM events""")
def c13(spark, d):
    dirty = F.concat(F.lit('{"trace_id": "t", "headers": {"a": 1}, '), F.expr("substring(props, 2)"))
    return table(spark, d, "events").select("event_id", T.scrub_payload(dirty).alias("data"))


@query("c14_marks", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'm ' || event_id ELSE 'k' || user_id END AS mark FROM events""")
def c14(spark, d):
    i = F.col("event_id").cast("string")
    attributes = F.when(F.col("event_id") % 2 == 1, F.concat(F.lit('{"x_mark": "k'), F.col("user_id").cast("string"), F.lit('"}')))
    return table(spark, d, "events").select("event_id", N.mark_of(attributes, F.concat(F.lit("/a?b=1&rid=m%20"), i)).alias("mark"))


@query("c15_first_url", """SELECT page_id, url FROM pages""")
def c15(spark, d):
    p = table(spark, d, "pages")
    data = F.when(F.col("page_id") % 2 == 0, F.to_json(F.struct(F.lit(1).alias("a"), "url"))).otherwise(F.concat(F.lit('[{"u": 2}, '), F.to_json(F.struct("url")), F.lit("]")))
    return p.select("page_id", N.first_url(data).alias("url"))
