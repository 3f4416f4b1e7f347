"""Queries of the flow-log operators (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hopgraph.operators import flowlog as H
from hopgraph.operators import span_sets as S
from hopgraph.operators.common import written
from hopgraph.plans.fixtures import duck, table, view
from hopgraph.plans.registry import query

W = duck("flow_rows")
C = duck("calls")


def flow(spark, d):
    """Flow rows as sessions; the two process sides of a call are on its server's or client's agent."""
    f = view(spark, d, "flow_rows")
    agent = F.when(F.col("tap_side").isin("c-p", "c"), F.col("client")).otherwise(F.col("server"))
    return f.withColumns({
        "agent": agent, "type": F.lit(H.SESSION), "syscall_req": F.col("syscall_id"), "syscall_resp": F.lit("").cast("string"), "trace_ids": F.array(F.col("trace_id").cast("string")),
        "x_request_id_0": F.when(F.col("tap_side") == "c", F.col("call_id")), "x_request_id_1": F.when(F.col("tap_side") == "s", F.col("call_id")),
        "span_id": F.when(F.col("tap_side") == "s-p", F.col("call_id")), "parent_span_id": F.when(F.col("tap_side") == "c-p", F.col("syscall_id")), "request_id": F.when(F.col("tap_side").isin("c", "s"), F.col("trace_id") + 1).otherwise(0),
    })


NEAR = "abs(a.start_us - b.start_us) <= CASE WHEN a.agent = b.agent THEN 100000 ELSE 110000 END"
FLOW = W + """, f AS (SELECT *, CASE WHEN tap_side IN ('c-p', 'c') THEN client ELSE server END AS agent FROM flow_rows)
"""
NETWORK = FLOW + f""", n AS (SELECT a.row_id AS a, b.row_id AS b FROM f a JOIN f b ON a.req_tcp_seq = b.req_tcp_seq AND a.resp_tcp_seq = b.resp_tcp_seq AND a.row_id <> b.row_id WHERE {NEAR} AND {NEAR.replace('start_us', 'end_us')} AND a.req_tcp_seq <> 0)
"""
SYS = ", y AS (SELECT a.row_id AS a, b.row_id AS b FROM f a JOIN f b ON a.syscall_id = b.syscall_id AND a.agent = b.agent AND a.row_id <> b.row_id WHERE NOT (a.tap_side = 's-p' AND b.tap_side = 's-p'))"


@query("h01_anchors", W + "SELECT mark, row_id FROM flow_rows WHERE client = 'ext' AND server = 'gateway' QUALIFY row_number() OVER (PARTITION BY mark ORDER BY start_us, row_id) = 1")
def h01(spark, d):
    return H.anchors(view(spark, d, "flow_rows"), "ext", "gateway").select("mark", "row_id")


@query("h02_merge_sessions", """WITH f AS (SELECT user_id, event_type, event_id, CASE WHEN event_id % 3 = 2 THEN 1 ELSE 0 END AS type FROM events),
b AS (SELECT *, sum(CASE type WHEN 0 THEN 1 ELSE -1 END) OVER w AS bal FROM f WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)), l AS (SELECT *, least(min(bal) OVER (PARTITION BY user_id, event_type ORDER BY event_id), 0) AS low FROM b),
o AS (SELECT *, type = 1 AND low < coalesce(lag(low) OVER (PARTITION BY user_id, event_type ORDER BY event_id), 0) AS orphan FROM l),
m AS (SELECT r.event_id AS res, max(q.event_id) AS req FROM o r JOIN o q ON q.user_id = r.user_id AND q.event_type = r.event_type AND q.type = 0 AND q.event_id < r.event_id AND q.bal - q.low = r.bal - r.low + 1 WHERE r.type = 1 AND NOT r.orphan GROUP BY 1)
SELECT CAST(coalesce(m.req, f.event_id) AS STRING) AS session, list_sort(list(CAST(f.event_id AS STRING))) AS "rows", count(*) AS n FROM f LEFT JOIN m ON m.res = f.event_id GROUP BY 1""")
def h02(spark, d):
    e = table(spark, d, "events")
    f = e.select(F.col("user_id").alias("agent"), F.col("event_type").alias("flow"), F.lit(0).alias("request_id"), F.col("event_id").cast("string").alias("row_id"), F.col("event_id").alias("start_us"), F.col("event_id").alias("end_us"), F.when(F.col("event_id") % 3 == 2, 1).otherwise(0).alias("type"))
    return H.merge_sessions(f).select("session", "rows", F.size("rows").cast("long").alias("n"))


@query("h03_merge_async", C + "SELECT call_id || '/s' AS response, call_id || '/c' AS request FROM calls")
def h03(spark, d):
    f = view(spark, d, "flow_rows").where("tap_side in ('c', 's')")
    rows = f.select("row_id", F.when(F.col("tap_side") == "c", 0).otherwise(1).alias("type"), F.lit("Kafka").alias("protocol"), F.lit("c").alias("tap_side"), F.col("call_id").alias("span_id"), "start_us", F.array("mark").alias("trace_ids"))
    return H.merge_async(rows)


@query("h04_rel_network", NETWORK + "SELECT a, b FROM n")
def h04(spark, d):
    return H.rel_network(flow(spark, d)).select("a", "b")


@query("h05_rel_network_weak", FLOW + f"SELECT a.row_id AS a, b.row_id AS b FROM f a JOIN f b ON a.req_tcp_seq = b.req_tcp_seq AND a.row_id <> b.row_id WHERE {NEAR} AND a.req_tcp_seq <> 0 UNION SELECT a.row_id, b.row_id FROM f a JOIN f b ON a.resp_tcp_seq = b.resp_tcp_seq AND a.row_id <> b.row_id WHERE {NEAR.replace('start_us', 'end_us')} AND a.resp_tcp_seq <> 0")
def h05(spark, d):
    return H.rel_network_weak(flow(spark, d)).select("a", "b")


@query("h06_rel_syscall", FLOW + SYS + " SELECT a, b FROM y")
def h06(spark, d):
    return H.rel_syscall(flow(spark, d)).select("a", "b")


@query("h07_rel_x_request", W + ", x AS (SELECT a.row_id AS a, b.row_id AS b FROM flow_rows a JOIN flow_rows b ON a.call_id = b.call_id WHERE a.tap_side = 'c' AND b.tap_side = 's' AND a.row_id <> b.row_id) SELECT a, b FROM x UNION SELECT b, a FROM x")
def h07(spark, d):
    return H.rel_x_request(flow(spark, d)).select("a", "b")


@query("h08_rel_app", W + ", x AS (SELECT a.row_id AS a, b.row_id AS b FROM flow_rows a JOIN flow_rows b ON a.call_id = b.syscall_id AND a.trace_id = b.trace_id WHERE a.tap_side = 's-p' AND b.tap_side = 'c-p') SELECT a, b FROM x UNION SELECT b, a FROM x")
def h08(spark, d):
    return H.rel_app(flow(spark, d)).select("a", "b")


@query("h09_rel_dns", FLOW + f"SELECT a.row_id AS a, b.row_id AS b FROM f a JOIN f b ON a.trace_id = b.trace_id WHERE a.row_id <> b.row_id AND a.tap_side IN ('c', 's') AND b.tap_side IN ('c', 's') AND {NEAR}")
def h09(spark, d):
    return H.rel_dns(flow(spark, d)).select("a", "b")


@query("h09_rel_dns_fields", FLOW + f"SELECT a.row_id AS a, b.row_id AS b FROM f a JOIN f b ON a.trace_id = b.trace_id WHERE a.row_id <> b.row_id AND a.tap_side IN ('c', 's') AND b.tap_side IN ('c', 's') AND {NEAR} AND a.server = b.server AND (a.side_no = 1 OR b.side_no = 1 OR a.client = b.client)")
def h09b(spark, d):
    """Rows of one server only; the client counts where both rows name it."""
    f = flow(spark, d).withColumn("named", F.when(F.col("tap_side") == "s", F.col("client")))
    return H.rel_dns(f, same=("server", "named")).select("a", "b")


@query("h10_relations", NETWORK + SYS + """, r AS (SELECT a, b, bit_or(relation)::INT AS relation FROM (SELECT a, b, 1 AS relation FROM n UNION ALL SELECT a, b, 4 FROM y) GROUP BY 1, 2)
SELECT a, b, relation, CASE relation WHEN 1 THEN 'network' WHEN 4 THEN 'syscall' ELSE 'network,syscall' END AS label FROM r""")
def h10(spark, d):
    f = flow(spark, d)
    return H.relations(H.rel_network(f), H.rel_syscall(f))


@query("h11_expand", W + "SELECT mark, row_id FROM flow_rows")
def h11(spark, d):
    f = view(spark, d, "flow_rows")
    key = lambda kind, c: f.where(F.col(c).isNotNull()).select("row_id", F.concat_ws(":", F.lit(kind), F.col(c)).alias("key"))
    return H.expand(key("call", "call_id").unionByName(key("syscall", "syscall_id")), H.anchors(f, "ext", "gateway"))[0]


# Entry rows are linked in twos over traces; of traces divisible by seven the server rows of inner calls carry a second id, which is all that store rows have.
ALLOWED = """SELECT mark, row_id, true AS kept, true AS whole FROM flow_rows UNION ALL SELECT CAST(a.trace_id AS STRING), b.row_id, false, true FROM flow_rows a JOIN flow_rows b ON a.trace_id // 2 = b.trace_id // 2 AND a.trace_id <> b.trace_id WHERE a.client = 'ext' AND b.client = 'ext' AND a.tap_side = 's' AND b.tap_side = 's'"""


@query("h11_expand_allowed", W + ALLOWED)
def h11b(spark, d):
    """Rows of each mark's trace and, kept out, those of others that a key leads to."""
    f = written(view(spark, d, "flow_rows").select("row_id", "call_id", "trace_id", "client", "server", "tap_side", "start_us", "mark"), "flow-rows")
    own, second = F.col("trace_id").cast("string"), F.concat(F.lit("x"), F.col("trace_id").cast("string"))
    twice = (F.col("trace_id") % 7 == 0) & (F.col("client") != "ext")
    ids = f.select("row_id", F.when(twice & (F.col("server") == "store"), F.array(second)).when(twice & (F.col("tap_side") == "s-p"), F.array(own, second)).when(F.col("tap_side") == "c-p", F.array().cast("array<string>")).otherwise(F.array(own)).alias("trace_ids"))
    call = f.select("row_id", F.concat(F.lit("call:"), "call_id").alias("key"))
    pair = f.where("client = 'ext' and tap_side = 's'").select("row_id", F.concat(F.lit("pair:"), F.floor(F.col("trace_id") / 2).cast("string")).alias("key"))
    kept, out, whole = H.expand_allowed(call.unionByName(pair), ids, H.anchors(f, "ext", "gateway"))
    return kept.withColumn("kept", F.lit(True)).unionByName(out.withColumn("kept", F.lit(False))).withColumn("whole", F.lit(whole))


@query("h12_network_sets", W + """SELECT row_id, row_number() OVER w AS place, lag(row_id) OVER w AS parent FROM flow_rows WINDOW w AS (PARTITION BY call_id ORDER BY CASE tap_side WHEN 'c-p' THEN 2 WHEN 'c' THEN 3 WHEN 's' THEN 6 ELSE 7 END)""")
def h12(spark, d):
    f = view(spark, d, "flow_rows")
    first = F.concat(F.col("call_id"), F.lit("/c-p"))
    related = f.where(F.col("row_id") != first).select(first.alias("a"), F.col("row_id").alias("b"))
    return H.network_sets(f, related).select("row_id", "place", "parent")


@query("h13_app_trees", C + "SELECT call_id AS span_id, 'r-' || trace_id AS tree, CASE WHEN client = 'ext' THEN 0 WHEN client = 'gateway' THEN 1 ELSE 2 END AS depth FROM calls")
def h13(spark, d):
    return H.app_trees(view(spark, d, "calls").select(F.col("call_id").alias("span_id"), F.col("parent_id").alias("parent_span_id")))


#: Traces take turns in the ids that tell a client span's server span: span id, x-request id, system call; every 11th has its trace id only.
PS = W + """, q AS (SELECT *, CASE WHEN tap_side = 'c-p' THEN client ELSE server END AS process FROM flow_rows WHERE tap_side IN ('c-p', 's-p')),
ps AS (SELECT row_id, syscall_id || '/s-p' AS parent, CASE trace_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 2 END AS rule FROM q WHERE tap_side = 'c-p' AND syscall_id IS NOT NULL AND trace_id % 11 <> 0
UNION ALL SELECT c.row_id, s.row_id, 4 FROM q c JOIN q s ON s.process = c.process AND s.trace_id = c.trace_id WHERE s.tap_side = 's-p' AND s.start_us <= c.start_us AND s.end_us >= c.end_us AND c.tap_side = 'c-p' AND c.trace_id % 11 = 0
  QUALIFY row_number() OVER (PARTITION BY c.row_id ORDER BY c.start_us - s.start_us, s.row_id) = 1)
"""


@query("h14_process_sets", PS + "SELECT row_id, parent, rule FROM ps")
def h14(spark, d):
    return H.process_sets(processes(spark, d))


def processes(spark, d):
    f = flow(spark, d).where("tap_side in ('c-p', 's-p')")
    turn = lambda k: (F.col("trace_id") % 3 == k) & (F.col("trace_id") % 11 != 0)
    side = lambda name: F.when(turn(0) & (F.col("tap_side") == name), F.col("syscall_id"))
    return f.select(
        "row_id", F.col("agent").alias("process"), F.col("tap_side").alias("side"), side("s-p").alias("span_id"), side("c-p").alias("parent_span_id"), F.when(turn(2), F.col("syscall_id")).alias("syscall"),
        F.when(turn(1), F.col("syscall_id")).alias("x_request"), F.col("mark").alias("trace_id"), "start_us", "end_us",
    )


def whole_trees(spark, d):
    f = view(spark, d, "flow_rows")
    first = F.concat(F.col("call_id"), F.lit("/c-p"))
    nets = H.network_sets(f, f.where(F.col("row_id") != first).select(first.alias("a"), F.col("row_id").alias("b")))
    return H.connect_sets(nets, H.process_sets(processes(spark, d)))


@query("h15_connect_sets", PS + """SELECT f.row_id, coalesce(lag(f.row_id) OVER (PARTITION BY call_id ORDER BY CASE tap_side WHEN 'c-p' THEN 2 WHEN 'c' THEN 3 WHEN 's' THEN 6 ELSE 7 END), ps.parent) AS parent FROM flow_rows f LEFT JOIN ps USING (row_id)""")
def h15(spark, d):
    return whole_trees(spark, d)


@query("h16_prune_trees", C + ", r AS (SELECT trace_id, start_us AS lo, end_us AS hi FROM calls WHERE client = 'ext') SELECT call_id FROM calls JOIN r USING (trace_id) WHERE client <> 'svc2' OR (start_us <= hi AND end_us >= lo)")
def h16(spark, d):
    c = view(spark, d, "calls")
    spans = c.select("call_id", F.col("trace_id").alias("trace"), F.when(F.col("client") == "svc2", F.col("call_id")).otherwise("main").alias("tree"), "start_us", "end_us", F.when(F.col("client") == "svc2", F.array("call_id")).otherwise(F.array(F.lit("t"))).alias("trace_ids"))
    return H.prune_trees(spans, F.col("tree") == "main").select("call_id")


SELF = C + """, k AS (SELECT p.call_id, c.start_us, c.end_us, max(c.end_us) OVER (PARTITION BY p.call_id ORDER BY c.start_us, c.end_us, c.call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto, p.end_us AS p_end FROM calls c JOIN calls p ON p.call_id = c.parent_id),
v AS (SELECT call_id, sum(greatest(least(end_us, p_end) - greatest(start_us, coalesce(upto, 0)), 0)) AS cov FROM k GROUP BY 1), s AS (SELECT calls.call_id, server AS service, greatest(end_us - start_us - coalesce(cov, 0), 0)::BIGINT AS self_us FROM calls LEFT JOIN v USING (call_id))
"""


def spans_of(spark, d):
    return view(spark, d, "calls").select(F.col("call_id").alias("row_id"), F.col("parent_id").alias("parent"), "start_us", "end_us", F.col("server").alias("service"), F.col("trace_id").alias("trace"))


@query("h17_self_time", SELF + "SELECT call_id AS row_id, self_us FROM s")
def h17(spark, d):
    return H.self_time(spans_of(spark, d)).select("row_id", "self_us")


@query("h18_service_latency", SELF + "SELECT service, sum(self_us)::BIGINT AS self_us, count(*) AS spans, round(100.0 * sum(self_us) / sum(sum(self_us)) OVER (), 6) AS share FROM s GROUP BY 1")
def h18(spark, d):
    return H.service_latency(H.self_time(spans_of(spark, d)))


def nested(spark, d):
    c = view(spark, d, "calls")
    skew = F.when(F.col("server") == "svc1", 4_000).when(F.col("server") == "store", -9_000).otherwise(0)
    c = c.select("call_id", "parent_id", F.col("server").alias("host"), (F.col("start_us") + skew).alias("start_us"), (F.col("end_us") + skew).alias("end_us"))
    p = c.select(F.col("call_id").alias("parent_id"), F.col("host").alias("outer_host"), F.col("start_us").alias("o_start"), F.col("end_us").alias("o_end"))
    return c, c.join(p, "parent_id").select("outer_host", F.col("host").alias("inner_host"), "o_start", "o_end", F.col("start_us").alias("i_start"), F.col("end_us").alias("i_end"))


CLOCK = C + """, w AS (SELECT call_id, parent_id, server AS host, CASE server WHEN 'svc1' THEN 4000 WHEN 'store' THEN -9000 ELSE 0 END AS skew, start_us, end_us FROM calls), k AS (SELECT call_id, parent_id, host, start_us + skew AS start_us, end_us + skew AS end_us FROM w),
a AS (SELECT p.host AS outer_host, c.host AS inner_host, max(p.start_us - c.start_us) AS lo, min(p.end_us - c.end_us) AS hi FROM k c JOIN k p ON p.call_id = c.parent_id GROUP BY 1, 2),
s AS (SELECT outer_host, inner_host, CASE WHEN lo > hi THEN 0 WHEN lo > 0 THEN lo WHEN hi < 0 THEN hi ELSE 0 END AS step FROM a),
f AS (SELECT inner_host AS host, min(step) AS shift_us FROM s WHERE outer_host = 'gateway' GROUP BY 1), d AS (SELECT 'gateway' AS host, 0 AS shift_us UNION ALL SELECT * FROM f UNION ALL SELECT inner_host, min(shift_us + step) FROM s JOIN f ON f.host = s.outer_host GROUP BY 1)
"""


@query("h19_clock_correction", CLOCK + "SELECT host, shift_us::BIGINT AS shift_us FROM d")
def h19(spark, d):
    return H.clock_correction(nested(spark, d)[1], "gateway")


@query("h19_apply_clock", CLOCK + "SELECT call_id, (start_us + coalesce(shift_us, 0))::BIGINT AS start_us, (end_us + coalesce(shift_us, 0))::BIGINT AS end_us FROM k LEFT JOIN d USING (host)")
def h19b(spark, d):
    spans, pairs = nested(spark, d)
    return H.apply_clock(spans, H.clock_correction(pairs, "gateway")).select("call_id", "start_us", "end_us")


@query("h20_trace_order", C + """, p AS (SELECT c.trace_id AS trace, c.call_id AS row_id, CASE WHEN c.client = 'ext' THEN [c.start_us] WHEN c.client = 'gateway' THEN [0, c.start_us] ELSE [0, p.start_us, c.start_us] END AS path FROM calls c LEFT JOIN calls p ON p.call_id = c.parent_id)
SELECT trace, row_id, row_number() OVER (PARTITION BY trace ORDER BY len(path) > 1, path[2], len(path), path[3])::INT AS place FROM p""")
def h20(spark, d):
    return H.trace_order(spans_of(spark, d))


@query("h21_related_ids", W + SYS.replace(", y AS", ", f AS (SELECT *, CASE WHEN tap_side IN ('c-p', 'c') THEN client ELSE server END AS agent FROM flow_rows), y AS") + " SELECT f.row_id, coalesce(list_sort(list(y.b || ':syscall') FILTER (y.b IS NOT NULL)), []) AS related FROM f LEFT JOIN y ON y.a = f.row_id GROUP BY 1")
def h21(spark, d):
    f = flow(spark, d)
    return H.related_ids(f, H.relations(H.rel_syscall(f)))


def span_rows(spark, d):
    return view(spark, d, "span_rows").withColumn("trace_ids", F.array(F.col("trace").cast("string")))


R = duck("span_rows")


@query("h12_star_sets", R + "SELECT row_id, first(row_id) OVER (PARTITION BY call_id ORDER BY start_us, row_id) AS set_id FROM span_rows WHERE source <> 'otel'")
def h12b(spark, d):
    r = span_rows(spark, d).where("source <> 'otel'")
    return S.star_sets(r, S.hop_pairs(r)).select("row_id", F.col("set").alias("set_id"))


@query("h12_hop_chains", R + "SELECT row_id, row_number() OVER w::INT AS place, lag(row_id) OVER w AS parent, row_number() OVER w = 1 AS root, lead(row_id) OVER w IS NULL AS leaf FROM span_rows WHERE source <> 'otel' WINDOW w AS (PARTITION BY call_id ORDER BY side_no)")
def h12c(spark, d):
    r = span_rows(spark, d).where("source <> 'otel'")
    return S.hop_chains(r, S.star_sets(r, S.hop_pairs(r))).select("row_id", "place", "parent", "root", "leaf")


# Server rows of a client row's service that cover it.
COVERED = R + """, cov AS (SELECT c.row_id, c.m, s.row_id AS up, s.start_us, s.duration_us, s.call_id = c.parent_id AS own FROM span_rows c JOIN span_rows s ON s.trace = c.trace AND s.agent = c.agent AND s.side = 's-p' AND c.side = 'c-p' AND s.start_us <= c.start_us AND s.end_us >= c.end_us)
"""
NESTED = "SELECT row_id, call_id || '/app' AS parent, 10 AS rule FROM span_rows WHERE side = 'inner'"
# A trace id in common is evidence too, so the server row begun last of all that cover is the parent; the rule says what it shares with it.
LATEST = COVERED + f""", best AS (SELECT row_id, m, up, own FROM cov WHERE m < 3 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY start_us DESC, up DESC) = 1), ps AS (SELECT row_id, up AS parent, CASE WHEN own AND m = 0 THEN 2 WHEN own AND m = 1 THEN 3 ELSE 4 END AS rule FROM best UNION ALL {NESTED})
"""


@query("h14_process_parents", LATEST + "SELECT * FROM ps")
def h14b(spark, d):
    return S.process_parents(span_rows(spark, d))


NEAREST = "p.start_us <= c.start_us DESC, CASE WHEN p.start_us <= c.start_us THEN p.start_us ELSE -p.start_us END DESC, p.row_id DESC"


def _ruled(rule: int, where: str, order: str = "p.row_id") -> str:
    return f"(SELECT c.row_id, p.row_id AS parent, {rule} AS rule FROM span_rows c JOIN span_rows p ON p.trace = c.trace AND p.call_id <> c.call_id WHERE {where} QUALIFY row_number() OVER (PARTITION BY c.row_id ORDER BY {order}) = 1)"


LONGER = "(p.duration_us, -p.start_us, p.row_id) > (c.duration_us, -c.start_us, c.row_id)"
QUEUED = "c.m = {m} AND c.side = 's' AND p.side = 'c'"


@query("h15_connect_by_rules", LATEST + f""", hop AS (SELECT row_id, lag(row_id) OVER (PARTITION BY call_id ORDER BY side_no) AS parent FROM span_rows WHERE source <> 'otel'),
r7 AS (SELECT c.row_id, p.row_id AS parent, 7 AS rule FROM span_rows c JOIN span_rows p ON p.trace = c.trace WHERE {QUEUED.replace("{m}", "8")} AND {LONGER} QUALIFY row_number() OVER (PARTITION BY p.row_id ORDER BY c.duration_us DESC, c.row_id DESC) = 1)
SELECT row_id, parent, 0 AS rule FROM hop WHERE parent IS NOT NULL UNION ALL SELECT row_id, parent, 0 FROM ps
UNION ALL SELECT * FROM {_ruled(1, "c.m = 3 AND c.side = 'c' AND p.side = 's-p' AND p.call_id = c.parent_id")} UNION ALL SELECT * FROM {_ruled(2, "c.m = 4 AND c.side = 'c-p' AND p.side = 's' AND p.call_id = c.parent_id")}
UNION ALL SELECT * FROM {_ruled(3, "c.m = 10 AND p.call_id = c.parent_id")} UNION ALL SELECT * FROM {_ruled(4, "c.m = 11 AND c.side = 'app' AND p.side = 'app' AND p.call_id = c.parent_id")}
UNION ALL SELECT * FROM {_ruled(5, "c.m = 5 AND c.side = 'c' AND p.side = 's' AND p.call_id = c.parent_id")} UNION ALL SELECT * FROM {_ruled(5, f"c.m = 6 AND c.side = 'c' AND p.side = 's' AND {LONGER}", f"p.duration_us, {NEAREST}")}
UNION ALL SELECT * FROM {_ruled(6, QUEUED.replace("{m}", "7"))} UNION ALL SELECT * FROM r7
UNION ALL SELECT * FROM {_ruled(8, "c.m = 9 AND c.side = 'c-p' AND p.side = 's-p' AND p.agent = c.agent AND p.start_us <= c.start_us AND p.end_us >= c.end_us", f"p.duration_us, {NEAREST}")}""")
def h15b(spark, d):
    """All rules, the weak ones too; each decides some kind of trace."""
    r = written(span_rows(spark, d), "span-rows")
    hops = r.where("source <> 'otel'")
    chains = written(S.hop_chains(hops, S.star_sets(hops, S.hop_pairs(hops))), "hop-chains")
    inside = written(S.process_parents(r), "process-parents")
    related = H.relations(H.rel_app(r), H.rel_x_request(r))
    return S.connect_sets(r, related, chains, S.process_sets(r, inside), inside, S.WEAK)


UIDS = C + """, s AS (SELECT call_id AS st, CASE WHEN trace_id % 4 < 2 THEN length(server) END AS sid, CASE WHEN trace_id % 4 = 0 THEN server END AS sname, CASE WHEN trace_id % 4 = 2 THEN 'app-' || server END AS app, CASE WHEN trace_id % 8 <> 3 THEN 'ip-' || server END AS ip,
  CASE WHEN trace_id % 3 = 0 AND server <> 'gateway' THEN 'g-' || server END AS gp, CASE WHEN server <> 'gateway' THEN 'k-' || (trace_id % 2) END AS kn, CASE WHEN server = 'store' THEN 'chost' WHEN server = 'gateway' THEN 'chost' ELSE 'ip' END AS kind, end_us - start_us AS self_us FROM calls),
n AS (SELECT sid, count(DISTINCT coalesce(gp, kn)) AS n FROM s WHERE sid IS NOT NULL GROUP BY 1),
u AS (SELECT s.*, CASE WHEN s.sid IS NOT NULL THEN s.sid || '-' WHEN app IS NOT NULL THEN '-' || app WHEN ip IS NOT NULL THEN ip || '-' ELSE 'unknown-' END AS base, CASE WHEN s.sid IS NOT NULL THEN coalesce(sname, ip) WHEN app IS NOT NULL THEN app WHEN ip IS NOT NULL THEN ip ELSE 'unknown service' END AS name, coalesce(n, 0) > 1 AND kind = 'chost' AS split FROM s LEFT JOIN n USING (sid))
"""


@query("h18_service_uids", UIDS + """SELECT CASE WHEN split THEN base || coalesce(gp, kn, '') ELSE base END AS service_uid, min(CASE WHEN split THEN name || ':' || coalesce(gp, kn, '') ELSE name END) AS service_uname, sum(self_us)::BIGINT AS self_us, count(*) AS spans, round(100.0 * sum(self_us) / sum(sum(self_us)) OVER (), 6) AS share FROM u GROUP BY 1""")
def h18b(spark, d):
    c, t = view(spark, d, "calls"), F.col("trace_id")
    name = lambda x: F.concat(F.lit(x), "server")
    sets = c.select(
        F.col("call_id").alias("set"), F.when(t % 4 < 2, F.length("server")).alias("auto_service_id"), F.when(t % 4 == 0, F.col("server")).alias("auto_service"), F.when(t % 4 == 2, name("app-")).alias("app_service"), F.when(t % 8 != 3, name("ip-")).alias("ip"),
        F.when((t % 3 == 0) & (F.col("server") != "gateway"), name("g-")).alias("gprocess"), F.when(F.col("server") != "gateway", F.concat(F.lit("k-"), (t % 2).cast("string"))).alias("process_kname"), F.when(F.col("server").isin("store", "gateway"), "chost").otherwise("ip").alias("auto_instance_type"),
    )
    return S.uid_latency(c.select(F.col("call_id").alias("set"), (F.col("end_us") - F.col("start_us")).alias("self_us")), sets)
