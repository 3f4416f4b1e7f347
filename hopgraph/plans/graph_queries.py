"""Queries of topology (E), token evidence (C7-C12) and candidate operators (F, Q5, W1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hopgraph.operators import assignment as G
from hopgraph.operators import candidates as K
from hopgraph.operators import evaluate as V
from hopgraph.operators import pairing as B
from hopgraph.operators import topology as E
from hopgraph.operators.common import written
from hopgraph.plans.fixtures import duck, table, view
from hopgraph.plans.registry import query

C = duck("calls")


def calls(spark, d):
    return view(spark, d, "calls")


@query("e1_root", C + "SELECT server, count(*) AS calls FROM calls WHERE client NOT IN (SELECT server FROM calls) GROUP BY 1 ORDER BY calls DESC, server LIMIT 1")
def e1(spark, d):
    return E.find_root(calls(spark, d))


@query("e2_service_edges", C + "SELECT client, server, count(*) AS calls, client NOT IN (SELECT server FROM calls) AS root_edge FROM calls GROUP BY 1, 2")
def e2(spark, d):
    return E.service_edges(calls(spark, d))


@query("e3_message_graph", duck("messages") + """, g AS (SELECT CASE WHEN msg_type = 'Response' THEN server ELSE client END AS src, CASE WHEN msg_type = 'Response' THEN client ELSE server END AS dst, count(*) AS n, string_agg(DISTINCT protocol_type, ',') AS protocols, min(time_us) AS first_us FROM messages GROUP BY 1, 2)
SELECT *, row_number() OVER (ORDER BY first_us, src, dst)::INT AS seq FROM g""")
def e3(spark, d):
    return E.message_graph(view(spark, d, "messages"))


@query("e4_service_tree", C + """, e AS (SELECT DISTINCT client, server FROM calls), one AS (SELECT server AS service, min(client) AS parent FROM e WHERE client = 'gateway' AND server <> 'gateway' GROUP BY 1),
two AS (SELECT server AS service, min(client) AS parent FROM e WHERE client IN (SELECT service FROM one) AND server <> 'gateway' AND server NOT IN (SELECT service FROM one) GROUP BY 1),
three AS (SELECT server AS service, min(client) AS parent FROM e WHERE client IN (SELECT service FROM two) AND server <> 'gateway' AND server NOT IN (SELECT service FROM one UNION ALL SELECT service FROM two) GROUP BY 1)
SELECT 'gateway' AS service, NULL::VARCHAR AS parent, 0 AS depth UNION ALL SELECT *, 1 FROM one UNION ALL SELECT *, 2 FROM two UNION ALL SELECT *, 3 FROM three""")
def e4(spark, d):
    return E.service_tree(E.service_edges(calls(spark, d)).select("client", "server"), "gateway")


@query("e5_jaeger_tree", C + """, x AS (SELECT client, server, min(start_us) AS first_us, count(*) AS calls FROM calls WHERE parent_id IS NOT NULL GROUP BY 1, 2)
SELECT client AS process, server AS callee, first_us, calls, row_number() OVER (ORDER BY first_us, client, server)::INT AS seq FROM x""")
def e5(spark, d):
    s = B.to_span_rows(calls(spark, d), "client-server").join(calls(spark, d).select("call_id", "start_us"), F.coalesce(F.when(F.col("kind") == "server", F.col("parent_span_id")), F.col("span_id")) == F.col("call_id"), "left")
    return E.jaeger_tree(s.select(F.col("span_id").alias("sid"), F.col("parent_span_id").alias("parent"), F.col("endpoint").alias("process"), "kind", "start_us"))


@query("e6_child_order_first_trace", C + """, f AS (SELECT trace_id FROM calls WHERE parent_id IS NULL ORDER BY start_us, trace_id LIMIT 1), s AS (SELECT client, server, min(start_us) AS first_us FROM calls JOIN f USING (trace_id) GROUP BY 1, 2), e AS (SELECT DISTINCT client, server FROM calls)
SELECT e.client, e.server, first_us, row_number() OVER (PARTITION BY e.client ORDER BY first_us ASC NULLS LAST, e.server)::INT AS place FROM e LEFT JOIN s USING (client, server)""")
def e6(spark, d):
    c = calls(spark, d)
    return E.child_order_first_trace(c, E.service_edges(c))


@query("e7_child_order_gap", C + """, g AS (SELECT c.client, c.server, c.start_us - p.start_us AS gap FROM calls c JOIN calls p ON p.call_id = c.parent_id WHERE p.start_us <= c.start_us AND p.end_us >= c.end_us),
a AS (SELECT client, server, quantile_cont(gap, 0.1) AS p10, quantile_cont(gap, 0.5) AS p50, count(*) AS n FROM g GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY client ORDER BY p10, p50, n DESC, server)::INT AS place FROM a""")
def e7(spark, d):
    c = calls(spark, d)
    p = c.select(F.col("call_id").alias("parent_id"), F.col("start_us").alias("p_start"), F.col("end_us").alias("p_end"))
    j = c.join(p, "parent_id").where("p_start <= start_us and p_end >= end_us").select("client", "server", (F.col("start_us") - F.col("p_start")).alias("gap_us"))
    return E.child_order_gap(j)


#: svc1 answers too late to be contained, svc2 a day later than any parent.
SHIFTED = ("CASE server WHEN 'svc2' THEN 86400000000 ELSE 0 END", "CASE server WHEN 'svc1' THEN 10000000 WHEN 'svc2' THEN 86400000000 ELSE 0 END")


@query("e7_child_order_fallback", C + f""", s AS (SELECT client, server, start_us + {SHIFTED[0]} AS start_us, end_us + {SHIFTED[1]} AS end_us FROM calls),
p AS (SELECT server AS client, start_us AS p_start, end_us AS p_end, unnest(range(start_us // 100000, (end_us + 50000) // 100000 + 1)) AS b FROM calls),
j AS (SELECT s.client, s.server, start_us - p_start AS gap, p_end >= end_us AS inside FROM s JOIN p ON p.client = s.client AND p.b = start_us // 100000 WHERE p_start <= start_us AND start_us <= p_end + 50000),
k AS (SELECT *, bool_or(inside) OVER (PARTITION BY client, server) AS any_inside FROM j),
a AS (SELECT client, server, quantile_cont(gap, 0.1) AS p10, quantile_cont(gap, 0.5) AS p50, count(*) AS n FROM k WHERE inside OR NOT any_inside GROUP BY 1, 2)
SELECT client, server, p10, p50, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY client ORDER BY p10 NULLS LAST, p50 NULLS LAST, coalesce(n, 0) DESC, server)::INT AS place FROM (SELECT DISTINCT client, server FROM calls) e LEFT JOIN a USING (client, server)""")
def e7b(spark, d):
    """Without known parents: svc1 is placed by its loose pairs, svc2 has none and comes last."""
    c = calls(spark, d)
    shifted = c.withColumn("end_us", F.col("end_us") + F.expr(SHIFTED[1])).withColumn("start_us", F.col("start_us") + F.expr(SHIFTED[0]))
    return E.child_order_gap(E.gap_pairs(shifted, c), c)


@query("e8_temporal_profile", C + """, n AS (SELECT server AS client, count(*) AS parents, avg(start_us - 1700000000000000) AS p_mean FROM calls GROUP BY 1), e AS (SELECT client, server, count(*) AS children, avg(start_us - 1700000000000000) AS c_mean, any_value(parents) AS parents, any_value(p_mean) AS p_mean FROM calls JOIN n USING (client) GROUP BY 1, 2),
r AS (SELECT *, c_mean - p_mean AS mu, CASE WHEN parents < 8 OR children < 8 THEN 'too-few-spans' WHEN greatest(parents, children)::DOUBLE / least(parents, children) > 1.5 THEN 'count-ratio-too-high' WHEN c_mean - p_mean < -50000 THEN 'negative-offset' ELSE 'ok' END AS reason FROM e),
c AS (SELECT client, server, greatest(0, floor((k + 0.5) * 10 / n)) AS b, avg(start_us - 1700000000000000) AS m FROM (SELECT *, row_number() OVER (PARTITION BY client, server ORDER BY start_us, call_id) - 1 AS k, count(*) OVER (PARTITION BY client, server) AS n FROM calls) GROUP BY 1, 2, 3),
p AS (SELECT server AS client, greatest(0, floor((k + 0.5) * 10 / n)) AS b, avg(start_us - 1700000000000000) AS m FROM (SELECT *, row_number() OVER (PARTITION BY server ORDER BY start_us, call_id) - 1 AS k, count(*) OVER (PARTITION BY server) AS n FROM calls) GROUP BY 1, 2),
s AS (SELECT c.client, c.server, stddev_samp(c.m - p.m) AS spread FROM c JOIN p USING (client, b) GROUP BY 1, 2)
SELECT r.client, r.server, parents, children, reason, CASE WHEN reason = 'ok' THEN round(mu, 3) END AS mu_us, CASE WHEN reason = 'ok' THEN round(greatest(coalesce(spread, 0), 50000), 3) END AS sigma_us FROM r LEFT JOIN s USING (client, server)""")
def e8(spark, d):
    return E.temporal_profile(calls(spark, d))


@query("e9_delay_model", C + """, i AS (SELECT server AS service, start_us, row_number() OVER (PARTITION BY server ORDER BY start_us, call_id) AS k FROM calls), o AS (SELECT client AS service, server AS endpoint, start_us AS o_us, row_number() OVER (PARTITION BY client, server ORDER BY start_us, call_id) AS k FROM calls WHERE parent_id IS NOT NULL),
b AS (SELECT service, endpoint, (k - 1) // 100 AS b, avg(o_us - start_us) AS gap, count(*) AS n FROM o JOIN i USING (service, k) GROUP BY 1, 2, 3)
SELECT service, endpoint, round(sum(gap * n) / sum(n) / 1e6, 6) AS mean_s, round(greatest(coalesce(sqrt(100.0) * stddev_samp(gap) / 1e6, 0.001), 0.001), 6) AS std_s FROM b GROUP BY 1, 2""")
def e9(spark, d):
    c = calls(spark, d)
    return E.delay_model(c.select(F.col("server").alias("service"), "start_us", "call_id"), c.where("parent_id is not null").select(F.col("client").alias("service"), F.col("server").alias("endpoint"), "start_us", "call_id"))


VEC = C + """, e AS (SELECT trace_id, client, server, count(*) AS n FROM calls GROUP BY 1, 2, 3), v AS (SELECT trace_id, list_sort(list(client || '>' || server || '>' || n)) AS edges, sum(n)::BIGINT AS spans FROM e GROUP BY 1)
"""


@query("e10_vector_counts", VEC + "SELECT edges, count(*) AS traces FROM v GROUP BY 1")
def e10(spark, d):
    return E.vector_counts(calls(spark, d))


@query("e10_span_histogram", VEC + "SELECT spans, count(*) AS traces FROM v GROUP BY 1")
def e10b(spark, d):
    return E.span_histogram(calls(spark, d))


@query("e11_expected_edges", VEC + """, g AS (SELECT client, server, trace_id FROM (SELECT DISTINCT client, server FROM calls), (SELECT DISTINCT trace_id FROM calls)), h AS (SELECT g.client, g.server, coalesce(n, 0) AS n, count(*) AS k FROM g LEFT JOIN e USING (trace_id, client, server) GROUP BY 1, 2, 3)
SELECT client, server, n AS expected FROM h QUALIFY row_number() OVER (PARTITION BY client, server ORDER BY k DESC, n) = 1""")
def e11(spark, d):
    return E.expected_edges(calls(spark, d))


@query("e12_service_map", duck("flow_rows") + """SELECT row_id, CASE side_no WHEN 0 THEN server WHEN 1 THEN 'auto-' || server WHEN 2 THEN 'inst-' || client END AS service FROM flow_rows""")
def e12(spark, d):
    f = view(spark, d, "flow_rows")
    flow = f.select("row_id", F.when(F.col("side_no") == 0, F.col("server")).otherwise("").alias("service"), F.when(F.col("side_no") < 2, F.col("server")).otherwise("none").alias("auto_service"), F.when(F.col("side_no") < 3, F.col("client")).otherwise("none").alias("auto_instance"))
    names = f.select(F.lit("service").alias("kind"), F.col("server").alias("name"), F.concat(F.lit("auto-"), "server").alias("service")).unionByName(f.select(F.lit("instance").alias("kind"), F.col("client").alias("name"), F.concat(F.lit("inst-"), "client").alias("service"))).distinct()
    return E.apply_service_map(flow, names).select("row_id", "service")


TOK = C + """, t AS (SELECT call_id, client, server, value_a AS a, value_b AS b FROM calls), n AS (SELECT client, server, count(*) AS n FROM t GROUP BY 1, 2), u AS (SELECT client, server, unnest(list_distinct([a, b])) AS token FROM t),
idf AS (SELECT client, server, token, ln((any_value(n) + 1) / (count(*) + 1)) + 1 AS idf FROM u JOIN n USING (client, server) GROUP BY 1, 2, 3)
"""


@query("c07_edge_idf", TOK + "SELECT client, server, token, round(idf, 6) AS idf FROM idf")
def c07(spark, d):
    return K.edge_idf(K.with_tokens(calls(spark, d))).withColumn("idf", F.round("idf", 6))


@query("c09_overlap", C + "SELECT c.call_id, CASE WHEN p.value_a IN (c.value_a, c.value_b) THEN CASE WHEN p.value_b IN (c.value_a, c.value_b) THEN 1.0 ELSE 0.7142857142857143 END ELSE CASE WHEN p.value_b IN (c.value_a, c.value_b) THEN 0.28571428571428575 ELSE 0.0 END END::DOUBLE AS overlap FROM calls c JOIN calls p ON p.call_id = c.parent_id")
def c09(spark, d):
    c = calls(spark, d)
    p = c.select(F.col("call_id").alias("parent_id"), F.array(F.struct(F.col("value_a").alias("token"), F.lit(1.0).alias("weight")), F.struct(F.col("value_b").alias("token"), F.lit(0.4).alias("weight"))).alias("p"))
    pairs = c.select("call_id", "parent_id", F.array("value_a", "value_b").alias("c")).join(p, "parent_id")
    return K.overlap_score(pairs).select("call_id", F.round("overlap", 9).alias("overlap"))


LINEAGE = """SELECT call_id, p_id, greatest(num / den, 0.35 * qq / dq + 0.2 * qs / dq + 0.3 * sq / ds + 0.15 * ss / ds) AS lineage FROM (
  SELECT x.call_id, x.p_id, ia * (p.a IN (c.a, c.b))::INT + 0.8 * ib * (p.b IN (c.a, c.b))::INT AS num, ia + 0.8 * ib AS den, ia AS dq, ib AS ds, ia * (p.a = c.a)::INT AS qq, ia * (p.a = c.b)::INT AS qs, ib * (p.b = c.a)::INT AS sq, ib * (p.b = c.b)::INT AS ss
  FROM (SELECT y.*, coalesce(ka.idf, 1.0) AS ia, coalesce(kb.idf, 1.0) AS ib FROM (SELECT z.call_id, z.p_id, z.client, z.server, t.a, t.b FROM pairs z JOIN t ON t.call_id = z.p_id) y
    LEFT JOIN idf ka ON ka.client = y.client AND ka.server = y.server AND ka.token = y.a LEFT JOIN idf kb ON kb.client = y.client AND kb.server = y.server AND kb.token = y.b) x
  JOIN t p ON p.call_id = x.p_id JOIN t c ON c.call_id = x.call_id) WHERE num > 0"""
TRUE_PAIRS = "pairs AS (SELECT call_id, parent_id AS p_id, client, server FROM calls WHERE parent_id IS NOT NULL)"


@query("c10_lineage_score", TOK + f", {TRUE_PAIRS}, s AS ({LINEAGE}) SELECT call_id, p_id, round(lineage, 6) AS lineage FROM s")
def c10(spark, d):
    c = calls(spark, d)
    tokens = K.with_tokens(c)
    pairs = c.where("parent_id is not null").select("call_id", F.col("parent_id").alias("p_id"), "client", "server")
    return K.lineage_score(pairs, tokens, K.edge_idf(tokens)).withColumn("lineage", F.round("lineage", 6))


@query("c11_token_diversity", TOK + "SELECT client, server, round(count(DISTINCT list_sort([a, b])) / count(*), 6) AS diversity FROM t GROUP BY 1, 2")
def c11(spark, d):
    return K.token_diversity(K.with_tokens(calls(spark, d)))


@query("c12_attach_db", C + """, s AS (SELECT *, list_filter([value_a, value_b], lambda v: v LIKE 'prt-%') AS strong FROM calls), j AS (SELECT d.call_id AS db_id, p.call_id AS owner, p.end_us + 80000 >= d.end_us AS inside, p.end_us - p.start_us AS len, abs(d.start_us - p.start_us) AS gap, len(list_intersect(d.strong, p.strong)) / greatest(least(len(d.strong), len(p.strong)), 1) AS score
  FROM s d JOIN s p ON p.server = d.client AND d.start_us BETWEEN p.start_us - 20000 AND p.end_us + 80000 WHERE d.server = 'store'),
k AS (SELECT *, bool_or(inside) OVER (PARTITION BY db_id) AS any_inside FROM j), r AS (SELECT *, coalesce(lead(score) OVER w, 0) AS second, row_number() OVER w AS rank FROM k WHERE inside OR NOT any_inside WINDOW w AS (PARTITION BY db_id ORDER BY score DESC, len, gap, owner))
SELECT db_id, owner, round(score, 6) AS score FROM r WHERE rank = 1 AND score >= 0.08 AND score - second >= 0.03""")
def c12(spark, d):
    c = calls(spark, d).withColumn("strong", F.filter(F.array("value_a", "value_b"), lambda v: v.startswith("prt-")))
    return K.attach_db_lineage(c.where("server <> 'store'"), c.where("server = 'store'"))


@query("c12_extend_owners", C + """, o AS (SELECT c.call_id, c.value_a, c.value_b, d.value_a AS d_req, d.value_b AS d_res FROM calls c LEFT JOIN calls d ON d.parent_id = c.call_id AND d.server = 'store' WHERE c.server <> 'store'),
w AS (SELECT call_id, token, max(w)::DOUBLE AS weight FROM (SELECT call_id, value_a AS token, 1.0 AS w FROM o UNION ALL SELECT call_id, value_b, 0.8 FROM o UNION ALL SELECT call_id, d_req, 0.9 FROM o UNION ALL SELECT call_id, d_res, 0.2 FROM o) WHERE token IS NOT NULL GROUP BY 1, 2)
SELECT call_id, string_agg(token || '=' || weight, ',' ORDER BY token) AS weights FROM w GROUP BY 1""")
def c12b(spark, d):
    """The tokens of a call after it has taken in those of the database calls found to be its own."""
    c = calls(spark, d).withColumn("strong", F.filter(F.array("value_a", "value_b"), lambda v: v.startswith("prt-")))
    # Of the calls that are alike in strong tokens only a containing one is the owner; parts are rare enough for one owner each.
    store = c.where("server = 'store'")
    owners = store.select(F.col("call_id").alias("db_id"), F.col("parent_id").alias("owner"))
    out = K.extend_owners(K.with_tokens(c.where("server <> 'store'")), K.with_tokens(store), owners)
    said = F.transform(F.array_sort(F.map_entries("weights")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.select("call_id", F.concat_ws(",", said).alias("weights"))


CANDS = """j AS (SELECT c.call_id, c.client, c.server, c.start_us, c.end_us, p.call_id AS p_id, p.start_us AS p_start, p.end_us AS p_end, greatest(p.start_us - c.start_us, 0) + greatest(c.end_us - p.end_us, 0) AS outside_us
  FROM calls c JOIN (SELECT *, unnest(range(CAST(floor((start_us - 50000) / 1e5) AS BIGINT), CAST(floor((end_us + 80000) / 1e5) AS BIGINT) + 1)) AS b FROM calls) p
  ON p.server = c.client AND p.b = CAST(floor(c.start_us / 1e5) AS BIGINT) WHERE c.start_us BETWEEN p.start_us - 50000 AND p.end_us + 80000),
cand AS (SELECT *, -(CASE WHEN outside_us > 80000 THEN 2.0 ELSE 0.0 END)::DOUBLE - outside_us / 1e6 * 4.0 AS temporal FROM j WHERE p_end + 80000 >= end_us OR outside_us <= 250000),
capped AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY temporal DESC, abs(start_us - p_start), p_id) <= 64)
"""
STRICT = CANDS + """, st AS (SELECT *, p_start <= start_us AND p_end >= end_us AS "strict" FROM capped), pairs AS (SELECT * FROM st QUALIFY "strict" OR NOT bool_or("strict") OVER (PARTITION BY call_id))
"""


@query("f1_temporal_candidates", C + ", " + CANDS + "SELECT call_id, p_id, outside_us, round(temporal, 6) AS temporal FROM capped")
def f1(spark, d):
    return K.temporal_candidates(calls(spark, d)).select("call_id", "p_id", "outside_us", F.round("temporal", 6).alias("temporal"))


@query("f2_fallback_candidates", C + """, r AS (SELECT c.call_id, p.call_id AS p_id, abs(c.start_us - p.start_us) AS distance_us FROM calls c JOIN calls p ON p.server = c.client AND c.start_us BETWEEN p.start_us - 250000 AND p.start_us + 250000 QUALIFY row_number() OVER (PARTITION BY c.call_id ORDER BY abs(c.start_us - p.start_us), p.call_id) <= 64)
SELECT call_id, p_id, distance_us FROM r""")
def f2(spark, d):
    return K.fallback_candidates(calls(spark, d)).select("call_id", "p_id", "distance_us")


def timed(spark, d):
    """Calls without payloads, written once: candidates read them several times."""
    return written(calls(spark, d).select("call_id", "client", "server", "start_us", "end_us"), "calls")


@query("f3_prefer_strict", C + ", " + STRICT + "SELECT call_id, p_id FROM pairs")
def f3(spark, d):
    return K.strict_candidates(timed(spark, d)).select("call_id", "p_id")


BEST = """best AS (SELECT pairs.call_id, pairs.p_id AS parent FROM pairs LEFT JOIN s USING (call_id, p_id) QUALIFY row_number() OVER (PARTITION BY pairs.call_id ORDER BY {w} * coalesce(lineage, 0) + temporal DESC, abs(start_us - p_start), p_end - p_start, pairs.p_id DESC) = 1),
pred AS (SELECT call_id, NULL AS parent, call_id AS label FROM calls WHERE client = 'ext' UNION ALL SELECT b.call_id, b.parent, b.parent FROM best b JOIN calls c USING (call_id) WHERE c.client = 'gateway' UNION ALL SELECT b.call_id, b.parent, q.parent FROM best b JOIN calls c USING (call_id) JOIN best q ON q.call_id = b.parent WHERE c.client LIKE 'svc%')
"""
TIME = C + ", " + STRICT + ", s AS (SELECT '' AS call_id, '' AS p_id, 0.0 AS lineage), " + BEST.replace("{w}", "0")
LINKED = TOK + ", " + STRICT + f", s AS ({LINEAGE}), " + BEST.replace("{w}", "20")


@query("f4_best_parent", C + ", " + STRICT + """, s AS (SELECT '' AS call_id, '' AS p_id, 0.0 AS lineage), """ + BEST.replace("{w}", "0") + "SELECT call_id, parent FROM best JOIN calls USING (call_id) WHERE client = 'gateway'")
def f4(spark, d):
    c = timed(spark, d)
    cands = K.strict_candidates(c, labels=K.roots_of(c)).withColumn("lineage", F.lit(0.0))
    return K.best_parent(cands, None).select("call_id", "parent")


@query("f5_propagate_time", TIME + "SELECT call_id, parent, label FROM pred")
def f5(spark, d):
    return K.infer(calls(spark, d), "time")[0]


@query("q5_infer_no_context", LINKED + "SELECT call_id, parent, label FROM pred")
def q5(spark, d):
    return K.infer(calls(spark, d), "no-context")[0]


# A call's context is its parent's ancestors' tokens. Only the third level has any (its root's order and customer), and none of its own (part and supplier) among them.
@query("q5_infer_full", LINKED + "SELECT call_id, parent, label FROM pred")
def q5b(spark, d):
    return K.infer(calls(spark, d), "full")[0]


def deep(spark, d):
    """Calls whose parents' ancestors decide (fixtures.DEEP_CALLS), with token arrays."""
    c = view(spark, d, "deep_calls")
    return c.withColumn("req_tokens", F.array("value_a", "value_c")).withColumn("res_tokens", F.array("value_b"))


# All store calls and their parents are contained, so pairs are the strict ones. Entry calls are labelled first, then the services' calls by lineage,
# then the store's by lineage and by what their candidates' parents, entry calls without ancestors, have said.
DEEP = duck("deep_calls") + """, t AS (SELECT call_id, client, server, list_filter([value_a, value_c], lambda v: v IS NOT NULL) AS req, [value_b] AS res, list_distinct(list_filter([value_a, value_c, value_b], lambda v: v IS NOT NULL)) AS "all" FROM deep_calls),
n AS (SELECT client, server, count(*) AS n FROM t GROUP BY 1, 2), u AS (SELECT client, server, unnest("all") AS token FROM t), idf AS (SELECT client, server, token, ln((any_value(n) + 1) / (count(*) + 1)) + 1 AS idf FROM u JOIN n USING (client, server) GROUP BY 1, 2, 3),
prs AS (SELECT c.call_id, p.call_id AS p_id, c.client, c.server, c.start_us, p.start_us AS p_start, p.end_us AS p_end FROM deep_calls c JOIN deep_calls p ON p.server = c.client AND p.start_us <= c.start_us AND p.end_us >= c.end_us),
tok AS (SELECT t.call_id AS p_id, e.server, x.token, coalesce(idf, 1.0) AS idf, list_contains(req, x.token) AS q, list_contains(res, x.token) AS s
  FROM t JOIN (SELECT DISTINCT client, server FROM t) e ON e.client = t.server, unnest(t."all") x(token) LEFT JOIN idf ON idf.client = t.server AND idf.server = e.server AND idf.token = x.token),
den AS (SELECT p_id, server, sum(idf * q::INT) AS dq, sum(idf * s::INT) AS ds, sum(idf * greatest(q::INT, 0.8 * s::INT)) AS dw FROM tok GROUP BY 1, 2),
num AS (SELECT r.call_id, r.p_id, r.server, sum(idf * greatest(q::INT, 0.8 * s::INT)) AS w, sum(idf * (q AND list_contains(c.req, token))::INT) AS qq, sum(idf * (q AND list_contains(c.res, token))::INT) AS qs, sum(idf * (s AND list_contains(c.req, token))::INT) AS sq, sum(idf * (s AND list_contains(c.res, token))::INT) AS ss
  FROM prs r JOIN t c USING (call_id) JOIN tok ON tok.p_id = r.p_id AND tok.server = r.server AND list_contains(c."all", token) GROUP BY 1, 2, 3),
lin AS (SELECT call_id, p_id, greatest(w / dw, coalesce(0.35 * qq / nullif(dq, 0), 0) + coalesce(0.2 * qs / nullif(dq, 0), 0) + coalesce(0.3 * sq / nullif(ds, 0), 0) + coalesce(0.15 * ss / nullif(ds, 0), 0)) AS lineage FROM num JOIN den USING (p_id, server)),
mid AS (SELECT r.call_id, r.p_id AS parent, lineage AS won FROM prs r LEFT JOIN lin USING (call_id, p_id) WHERE r.client = 'gateway' QUALIFY row_number() OVER (PARTITION BY r.call_id ORDER BY {lineage} * coalesce(lineage, 0) DESC, abs(start_us - p_start), p_end - p_start, r.p_id DESC) = 1),
ctx AS (SELECT m.call_id AS p_id, x.token, CASE WHEN list_contains(a.req, x.token) THEN 1.0 ELSE 0.9 END AS weight FROM mid m JOIN t a ON a.call_id = m.parent, unnest(a."all") x(token)),
cs AS (SELECT r.call_id, r.p_id, sum(weight * coalesce(idf, 1.0) * list_contains(c."all", ctx.token)::INT) / sum(weight * coalesce(idf, 1.0)) AS context FROM prs r JOIN t c USING (call_id) JOIN ctx USING (p_id) LEFT JOIN idf ON idf.client = r.client AND idf.server = r.server AND idf.token = ctx.token WHERE r.server = 'store' GROUP BY 1, 2),
low AS (SELECT r.call_id, r.p_id AS parent, lineage AS won, context FROM prs r LEFT JOIN lin USING (call_id, p_id) LEFT JOIN cs USING (call_id, p_id) WHERE r.server = 'store' QUALIFY row_number() OVER (PARTITION BY r.call_id ORDER BY {lineage} * coalesce(lineage, 0) + {context} * coalesce(context, 0) DESC, abs(start_us - p_start), p_end - p_start, r.p_id DESC) = 1),
pred AS (SELECT call_id, NULL AS parent, call_id AS label, NULL::DOUBLE AS won FROM deep_calls WHERE client = 'ext' UNION ALL SELECT call_id, parent, parent, won FROM mid UNION ALL SELECT l.call_id, l.parent, m.parent, l.won FROM low l JOIN mid m ON m.call_id = l.parent)
"""


@query("q5_infer_context", DEEP.replace("{lineage}", "20").replace("{context}", "40") + "SELECT call_id, parent, label, true AS converged FROM pred")
def q5c(spark, d):
    """The full variant where only the ancestors' tokens tell parents apart; ``converged`` says whether the rounds were enough."""
    labels, _, whole = K.infer(deep(spark, d), "full")
    return labels.withColumn("converged", F.lit(whole))


@query("q5_variants_deep", " UNION ALL ".join(
    f"SELECT * FROM ({DEEP.replace('{lineage}', a).replace('{context}', b)}SELECT '{v}' AS variant, count(*) FILTER (p.parent = c.parent_id) AS right_parents, count(*) FILTER (p.label = 'r-' || c.trace_id) AS right_labels, count(*) AS store_calls FROM deep_calls c JOIN pred p USING (call_id) WHERE c.server = 'store')"
    for v, a, b in (("time", "0", "0"), ("no-context", "20", "0"), ("context", "0", "40"), ("full", "20", "40"))))
def q5d(spark, d):
    """What each kind of evidence finds of the store's calls: without the ancestors few, with them nearly all."""
    c = deep(spark, d)
    known = c.where("server = 'store'").select("call_id", "parent_id", F.concat(F.lit("r-"), F.col("trace_id").cast("string")).alias("truth"))
    out = None
    for variant, (labels, *_) in K.infer_variants(c, ("time", "no-context", "context", "full")).items():
        j = known.join(labels, "call_id", "left")
        n = lambda e: F.sum(F.coalesce(e, F.lit(False)).cast("long"))
        row = j.agg(n(F.col("parent") == F.col("parent_id")).alias("right_parents"), n(F.col("label") == F.col("truth")).alias("right_labels"), F.count("*").alias("store_calls")).select(F.lit(variant).alias("variant"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query("g4_edge_signal", DEEP.replace("{lineage}", "20").replace("{context}", "40") + """, won AS (SELECT call_id, 0.0 AS won FROM deep_calls WHERE client = 'ext' UNION ALL SELECT call_id, coalesce(won, 0) FROM mid UNION ALL SELECT call_id, greatest(coalesce(won, 0), coalesce(context, 0)) FROM low)
SELECT client, server, round(avg(won), 6) AS signal FROM won JOIN deep_calls USING (call_id) GROUP BY 1, 2""")
def g4_signal(spark, d):
    """How strong the evidence was that won the calls of each edge."""
    c = deep(spark, d)
    return G.edge_signal(c, K.infer(c, "full", evidence=True)[0]).withColumn("signal", F.round("signal", 6))


TRUTH = "SELECT call_id, parent_id AS parent, 'r-' || trace_id AS label FROM calls"


def truth(c):
    return c.select("call_id", F.col("parent_id").alias("parent"), F.concat(F.lit("r-"), F.col("trace_id").cast("string")).alias("label"))


@query("f6_trace_context", C + """SELECT 'r-' || trace_id AS label, token, max(w)::DOUBLE AS weight FROM (SELECT trace_id, value_a AS token, 1.0 AS w FROM calls UNION ALL SELECT trace_id, value_b, 0.9 FROM calls) GROUP BY 1, 2""")
def f6(spark, d):
    c = calls(spark, d)
    return K.trace_context(truth(c), K.with_tokens(c))


@query("f7_ancestor_context", C + """, a AS (SELECT call_id, parent_id AS up FROM calls WHERE parent_id IS NOT NULL UNION ALL SELECT c.call_id, p.parent_id FROM calls c JOIN calls p ON p.call_id = c.parent_id WHERE p.parent_id IS NOT NULL)
SELECT call_id, token, max(w)::DOUBLE AS weight FROM (SELECT a.call_id, value_a AS token, 1.0 AS w FROM a JOIN calls p ON p.call_id = a.up UNION ALL SELECT a.call_id, value_b, 0.9 FROM a JOIN calls p ON p.call_id = a.up) GROUP BY 1, 2""")
def f7(spark, d):
    c = calls(spark, d)
    return K.ancestor_context(truth(c), K.with_tokens(c))


CAUSAL = """, j AS (SELECT c.call_id, p.call_id AS p_id, CASE WHEN p.start_us <= c.start_us AND p.end_us >= c.end_us THEN 0 WHEN c.start_us BETWEEN p.start_us AND p.end_us THEN 1 ELSE 2 END AS tier, abs(c.start_us - p.start_us) AS gap, p.end_us - p.start_us AS len, c.end_us - p.end_us AS over
  FROM calls c JOIN calls p ON p.trace_id = c.trace_id AND p.server = c.client AND p.call_id <> c.call_id), k AS (SELECT call_id, p_id AS parent, tier FROM j QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY tier, CASE tier WHEN 0 THEN len WHEN 1 THEN over ELSE gap END, gap, p_id) = 1)
"""


@query("f8_causal_parent", C + CAUSAL + "SELECT * FROM k")
def f8(spark, d):
    return K.causal_parent(calls(spark, d), "trace_id")


@query("f9_rebuild_parents", C + CAUSAL + "SELECT count(*) AS attempted, count(*) FILTER (k.parent <> c.parent_id) AS updated, count(*) FILTER (k.parent IS NULL) AS missing FROM calls c LEFT JOIN k USING (call_id) WHERE c.parent_id IS NOT NULL")
def f9(spark, d):
    c = calls(spark, d)
    return K.rebuild_parents(c, truth(c))[1]


@query("f10_containment_fallback", C + """, k AS (SELECT call_id, parent_id AS parent, 'r-' || trace_id AS label FROM calls WHERE client <> 'gateway'),
j AS (SELECT c.call_id, p.call_id AS p_id, greatest(p.start_us - c.start_us, 0) + greatest(c.end_us - p.end_us, 0) AS outside, p.end_us - p.start_us AS len, abs(c.start_us - p.start_us) AS gap
  FROM calls c JOIN (SELECT *, unnest(range(CAST(floor((start_us - 80000) / 1e5) AS BIGINT), CAST(floor((end_us + 80000) / 1e5) AS BIGINT) + 1)) AS b FROM calls) p ON p.server = c.client AND p.b = CAST(floor(c.start_us / 1e5) AS BIGINT)
  WHERE c.client = 'gateway' AND c.start_us BETWEEN p.start_us - 80000 AND p.end_us + 80000)
SELECT * FROM k UNION ALL SELECT call_id, p_id, p_id FROM j WHERE outside <= 80000 QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY 100 * outside + len + 0.05 * gap, p_id) = 1""")
def f10(spark, d):
    c = calls(spark, d)
    known = truth(c).where("parent is null or call_id like 'g-%'")
    return K.containment_fallback(c, known).select("call_id", "parent", "label")


DOWN = C.replace("WITH ", "WITH RECURSIVE ", 1) + """, down AS (SELECT call_id, call_id AS root, 0 AS depth FROM calls WHERE parent_id IS NULL UNION ALL SELECT c.call_id, d.root, d.depth + 1 FROM calls c JOIN down d ON c.parent_id = d.call_id)
"""


@query("f11_labels_from_parents", DOWN + "SELECT call_id, root AS label FROM down")
def f11(spark, d):
    c = calls(spark, d)
    return K.labels_from_parents(truth(c).select("call_id", "parent"), truth(c).where("parent is null"))


@query("f12_map_hops", DOWN + "SELECT root, depth, call_id FROM down WHERE depth <= 2")
def f12(spark, d):
    return K.map_hops(calls(spark, d), 2)


SCORED = """, zz AS (SELECT c.call_id, c.trace_id, c.parent_id, p.parent, coalesce(p.label = 'r-' || c.trace_id, false) AS ok, coalesce(p.parent = c.parent_id, false) AS pok FROM calls c LEFT JOIN pred p USING (call_id)),
tt AS (SELECT trace_id, bool_and(ok) AS labels, count(*) FILTER (parent_id IS NOT NULL AND NOT pok) AS missing, count(*) FILTER (parent IS NOT NULL AND NOT pok) AS extra FROM zz GROUP BY 1)
SELECT count(*) AS traces, count(*) FILTER (labels AND missing = 0 AND extra = 0) AS correct, sum(missing)::BIGINT AS missing_edges, sum(extra)::BIGINT AS extra_edges, round(100.0 * count(*) FILTER (labels AND missing = 0 AND extra = 0) / count(*), 6) AS accuracy FROM tt"""
#: By time alone, and with payload evidence.
FULL_TRACE = (TIME + SCORED, LINKED + SCORED)


@query("w1_reconstruct_and_score", FULL_TRACE[1])
def w1(spark, d):
    """Messages -> calls -> candidates -> lineage -> labels -> score against the known parents."""
    c = B.pair_messages(view(spark, d, "messages"))
    c = c.select(F.col("stream_id").alias("call_id"), "client", "server", "start_us", "end_us", F.col("req_data").alias("value_a"), F.col("res_data").alias("value_b"))
    labels = K.infer(c)[0]
    known = calls(spark, d).select("call_id", F.concat(F.lit("r-"), F.col("trace_id").cast("string")).alias("trace_id"), "parent_id", "client")
    return V.full_trace_accuracy(V.scored(known, labels.withColumnRenamed("parent", "parent_pred")))
