"""Queries of the evaluation operators (V1-V16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hopgraph.operators import evaluate as V
from hopgraph.plans.fixtures import duck, table, view
from hopgraph.plans.registry import query

S = duck("calls", "predictions") + """, s AS (
  SELECT c.*, p.label, p.parent_pred, coalesce(p.label = c.trace_id, false) AS ok,
    coalesce(p.parent_pred = c.parent_id, false) AS pok
  FROM calls c LEFT JOIN predictions p USING (call_id))
"""


def scored(spark, d):
    return V.scored(view(spark, d, "calls"), view(spark, d, "predictions"))


@query("v01_span_metrics", S + """
SELECT count(*) AS total, count(*) FILTER (ok) AS correct, count(label) AS predicted, count(*) - count(label) AS unpredicted,
  round(100.0 * count(*) FILTER (ok) / count(*), 6) AS accuracy, round(100.0 * count(label) / count(*), 6) AS coverage FROM s WHERE parent_id IS NOT NULL""")
def v01(spark, d):
    return V.span_metrics(scored(spark, d))


@query("v02_trace_assignment", S + """, t AS (SELECT trace_id, bool_and(ok) AS ok FROM s GROUP BY 1)
SELECT count(*) AS traces, count(*) FILTER (ok) AS correct, round(100.0 * count(*) FILTER (ok) / count(*), 6) AS accuracy FROM t""")
def v02(spark, d):
    return V.trace_assignment(scored(spark, d))


@query("v03_trace_assignment_strict", S + """, t AS (SELECT DISTINCT trace_id FROM s),
want AS (SELECT trace_id, list_sort(list(call_id)) AS w FROM s GROUP BY 1), got AS (SELECT label AS trace_id, list_sort(list(call_id)) AS g FROM s WHERE label IS NOT NULL GROUP BY 1),
e AS (SELECT want.trace_id, coalesce(w = g, false) AS same FROM want LEFT JOIN got USING (trace_id))
SELECT count(*) AS traces, count(*) FILTER (same) AS exact, round(100.0 * count(*) FILTER (same) / count(*), 6) AS accuracy FROM e""")
def v03(spark, d):
    return V.trace_assignment_strict(scored(spark, d))


@query("v03_external_denominator", S + """, h AS (SELECT * FROM s WHERE NOT (trace_id % 40 = 3 AND parent_id IS NULL)), want AS (SELECT trace_id, list_sort(list(call_id)) AS w, bool_or(parent_id IS NULL) AS rooted FROM h GROUP BY 1), got AS (SELECT label AS trace_id, list_sort(list(call_id)) AS g FROM h WHERE label IS NOT NULL GROUP BY 1),
p AS (SELECT trace_id FROM want UNION SELECT o_orderkey FROM orders UNION SELECT -1 - k FROM range(7) r(k)), e AS (SELECT trace_id, coalesce(w = g AND rooted, false) AS same FROM p LEFT JOIN want USING (trace_id) LEFT JOIN got USING (trace_id))
SELECT count(*) AS traces, count(*) FILTER (same) AS exact, round(100.0 * count(*) FILTER (same) / count(*), 6) AS accuracy FROM e""")
def v03b(spark, d):
    """Some entry calls and seven whole traces were never captured."""
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("trace_id")).union(spark.range(7).select(-1 - F.col("id")))
    return V.trace_assignment_strict(scored(spark, d).where("not (trace_id % 40 = 3 and parent_id is null)"), asked)


@query("v04_parent_edges", S + """, e AS (
SELECT (SELECT count(*) FROM (SELECT call_id, parent_id FROM s WHERE parent_id IS NOT NULL INTERSECT SELECT call_id, parent_pred FROM s)) AS tp,
  (SELECT count(parent_pred) FROM s) AS guesses, (SELECT count(parent_id) FROM s) AS truth, (SELECT count(*) FROM s WHERE parent_id IS NOT NULL AND parent_pred IS NULL) AS unpredicted)
SELECT tp, guesses - tp AS fp, truth - tp AS fn, unpredicted, round(100.0 * tp / guesses, 6) AS "precision", round(100.0 * tp / truth, 6) AS recall, round(200.0 * tp / (guesses + truth), 6) AS f1 FROM e""")
def v04(spark, d):
    return V.parent_edge_metrics(scored(spark, d))


@query("v05_full_trace", S + """, t AS (SELECT trace_id, bool_and(ok) AS labels, count(*) FILTER (parent_id IS NOT NULL AND NOT pok) AS missing, count(*) FILTER (parent_pred IS NOT NULL AND NOT pok) AS extra FROM s GROUP BY 1)
SELECT count(*) AS traces, count(*) FILTER (labels AND missing = 0 AND extra = 0) AS correct, sum(missing)::BIGINT AS missing_edges, sum(extra)::BIGINT AS extra_edges,
  round(100.0 * count(*) FILTER (labels AND missing = 0 AND extra = 0) / count(*), 6) AS accuracy FROM t""")
def v05(spark, d):
    return V.full_trace_accuracy(scored(spark, d))


@query("v06_root_direct", S + """, t AS (SELECT trace_id, count(*) AS n, count(*) FILTER (ok) AS k FROM s WHERE client = 'gateway' GROUP BY 1)
SELECT count(*) AS traces, count(*) FILTER (n = k) AS traces_ok, sum(n)::BIGINT AS occurrences, sum(k)::BIGINT AS occurrences_ok FROM t""")
def v06(spark, d):
    return V.root_direct(scored(spark, d))


@query("v07_edge_accuracy", S + """
SELECT client, server, count(*) AS total, count(*) FILTER (ok) AS correct, round(100.0 * count(*) FILTER (ok) / count(*), 6) AS accuracy FROM s WHERE parent_id IS NOT NULL GROUP BY 1, 2""")
def v07(spark, d):
    return V.edge_accuracy(scored(spark, d))


@query("v08_error_histogram", S + ", t AS (SELECT trace_id, count(*) FILTER (NOT ok) AS errors FROM s GROUP BY 1) SELECT errors, count(*) AS traces FROM t GROUP BY 1")
def v08a(spark, d):
    return V.error_histogram(scored(spark, d))


@query("v08_error_summary", S + """, t AS (SELECT trace_id, count(*) FILTER (NOT ok) AS errors FROM s GROUP BY 1)
SELECT round(avg(errors), 6) AS mean, max(errors) AS max, round(quantile_cont(errors, 0.5), 6) AS p50, round(quantile_cont(errors, 0.9), 6) AS p90 FROM t""")
def v08b(spark, d):
    return V.error_summary(scored(spark, d))


@query("v08_worst_traces", S + """, t AS (SELECT trace_id, count(*) FILTER (NOT ok) AS errors FROM s GROUP BY 1 ORDER BY errors DESC, trace_id LIMIT 10),
e AS (SELECT trace_id, client, server, count(*) AS edge_errors FROM s WHERE NOT ok GROUP BY 1, 2, 3), r AS (SELECT t.trace_id, errors, client, server, edge_errors, row_number() OVER (PARTITION BY t.trace_id ORDER BY edge_errors DESC, client, server) AS rank FROM t JOIN e USING (trace_id))
SELECT trace_id, errors, client, server, edge_errors, rank::INT AS rank FROM r WHERE rank <= 5""")
def v08c(spark, d):
    return V.worst_traces(scored(spark, d))


@query("v08_affected_traces", S + """, n AS (SELECT count(DISTINCT trace_id) AS total FROM s)
SELECT client, server, count(DISTINCT trace_id) AS traces, round(100.0 * count(DISTINCT trace_id) / any_value(total), 6) AS share FROM s, n WHERE NOT ok GROUP BY 1, 2""")
def v08d(spark, d):
    return V.affected_traces(scored(spark, d))


SERVICE = S + """, p AS (SELECT client, parent_id, count(*) AS n, count(*) FILTER (pok) AS k FROM s WHERE parent_id IS NOT NULL GROUP BY 1, 2),
a AS (SELECT client, sum(n)::BIGINT AS calls, sum(k)::BIGINT AS calls_ok, count(*) AS parents, count(*) FILTER (n = k) AS parents_ok, round(100.0 * sum(k) / sum(n), 6) AS accuracy, round(100.0 * count(*) FILTER (n = k) / count(*), 6) AS node_accuracy FROM p GROUP BY 1)
"""


@query("v09_service_accuracy", SERVICE + "SELECT * FROM a")
def v09(spark, d):
    return V.service_accuracy(scored(spark, d))


@query("v09_weighted_accuracy", SERVICE + "SELECT round(sum(accuracy * calls) / sum(calls), 6) AS weighted FROM a")
def v09b(spark, d):
    return V.weighted_accuracy(scored(spark, d))


FLOW = duck("flow_rows") + """, want AS (SELECT 'gateway' AS client, 'svc' || k AS server, 8 AS want FROM range(3) r(k) UNION ALL SELECT 'ext', 'gateway', 4),
seen AS (SELECT mark, client, server, count(*) AS seen FROM flow_rows GROUP BY 1, 2, 3), grid AS (SELECT mark, client, server, want FROM (SELECT DISTINCT mark FROM flow_rows) m CROSS JOIN want),
j AS (SELECT coalesce(g.mark, s.mark) AS mark, coalesce(g.client, s.client) AS client, coalesce(g.server, s.server) AS server, coalesce(want, 0)::INT AS want, coalesce(seen, 0) AS seen FROM grid g FULL JOIN seen s ON g.mark = s.mark AND g.client = s.client AND g.server = s.server),
r AS (SELECT *, greatest(want - seen, 0) AS short, greatest(seen - want, 0) AS excess FROM j)
"""


def flow_scores(spark, d):
    want = spark.createDataFrame([("ext", "gateway", 4), *(("gateway", f"svc{k}", 8) for k in range(3))], "client string, server string, want int")
    return V.score_flow_traces(view(spark, d, "flow_rows"), want)


@query("v10_flow_scores", FLOW + "SELECT * FROM r")
def v10(spark, d):
    return flow_scores(spark, d)


@query("v10_flow_summary", FLOW + """, m AS (SELECT mark, sum(short) AS short, sum(excess) AS excess, sum(least(want, seen)) AS met FROM r GROUP BY 1)
SELECT count(*) AS traces, count(*) FILTER (short = 0 AND excess = 0) AS exact, sum(met)::BIGINT AS tp, sum(excess)::BIGINT AS fp, sum(short)::BIGINT AS fn, round(200.0 * sum(met) / (2 * sum(met) + sum(excess) + sum(short)), 6) AS f1 FROM m""")
def v10b(spark, d):
    return V.flow_trace_summary(flow_scores(spark, d))


# Traces of marks as a tracer might give them: every 29th row was never captured, every 31st left out, every 37th stands in the next trace, every 41st bears no mark.
# Marks divisible by 50 have no trace; and some marks have no row at all.
CAUSES = duck("flow_rows") + """, want AS (SELECT 'gateway' AS client, 'svc' || k AS server, 8 AS want FROM range(3) r(k) UNION ALL SELECT 'ext', 'gateway', 4),
f AS (SELECT *, trace_id * 13 + side_no * 7 + length(row_id) + start_us % 1000 AS n FROM flow_rows), cap AS (SELECT * FROM f WHERE n % 29 <> 0),
sel AS (SELECT CASE WHEN n % 37 = 0 THEN CAST(trace_id + 1 AS STRING) ELSE mark END AS mark, client, server, CASE WHEN n % 41 <> 0 THEN mark END AS row_mark FROM cap WHERE n % 31 <> 0),
marks AS (SELECT CAST(o_orderkey AS STRING) AS mark, CASE WHEN o_orderkey % 50 = 0 THEN 'missing-anchor' ELSE 'ok' END AS status FROM orders UNION ALL SELECT 'none-' || k, 'missing-mark' FROM range(3) r(k)),
mix AS (SELECT mark, count(*) FILTER (row_mark <> mark) AS wrong FROM sel GROUP BY 1), se AS (SELECT mark, client, server, count(*) AS got, count(*) FILTER (wrong = 0 OR row_mark = mark) AS good FROM sel JOIN mix USING (mark) GROUP BY 1, 2, 3), ca AS (SELECT mark, client, server, count(*) AS there FROM cap GROUP BY 1, 2, 3),
g AS (SELECT m.mark, status, want, coalesce(got, 0) AS got, coalesce(good, 0) AS good, coalesce(there, 0) AS there FROM marks m CROSS JOIN want w LEFT JOIN se s ON s.mark = m.mark AND s.client = w.client AND s.server = w.server LEFT JOIN ca c ON c.mark = m.mark AND c.client = w.client AND c.server = w.server),
p AS (SELECT g.mark, status, sum(want)::BIGINT AS want, sum(got)::BIGINT AS predicted, sum(least(want, got))::BIGINT AS covered, sum(least(want, good))::BIGINT AS correct, sum(good)::BIGINT AS correct_predicted, sum(greatest(want - got, 0))::BIGINT AS missing, sum(greatest(got - want, 0))::BIGINT AS extra,
  sum(greatest(want - there, 0))::BIGINT AS not_captured, sum(greatest(least(want, there) - least(want, got), 0))::BIGINT AS not_paired, coalesce(any_value(wrong), 0) AS wrong_mark FROM g LEFT JOIN mix USING (mark) GROUP BY 1, 2),
c AS (SELECT mark, status, want, COLUMNS(['predicted', 'covered', 'correct', 'correct_predicted', 'missing', 'extra', 'not_captured', 'not_paired', 'wrong_mark']) * (status = 'ok')::BIGINT, status = 'ok' AND not_captured > 0 AS capture_fault, status = 'ok' AND (not_paired > 0 OR wrong_mark > 0) AS pairing_fault,
  status = 'ok' AND correct = want AND wrong_mark = 0 AS assigned, status = 'ok' AND missing = 0 AND wrong_mark = 0 AS exact FROM p)
"""


def causes(spark, d):
    f = view(spark, d, "flow_rows").withColumn("n", F.col("trace_id") * 13 + F.col("side_no") * 7 + F.length("row_id") + F.col("start_us") % 1000)
    cap = f.where("n % 29 <> 0")
    sel = cap.where("n % 31 <> 0").select(F.when(F.col("n") % 37 == 0, (F.col("trace_id") + 1).cast("string")).otherwise(F.col("mark")).alias("mark"), "client", "server", F.when(F.col("n") % 41 != 0, F.col("mark")).alias("row_mark"))
    asked = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("mark"), F.when(F.col("o_orderkey") % 50 == 0, "missing-anchor").otherwise("ok").alias("status"))
    asked = asked.unionByName(spark.range(3).select(F.concat(F.lit("none-"), F.col("id").cast("string")).alias("mark"), F.lit("missing-mark").alias("status")))
    want = spark.createDataFrame([("ext", "gateway", 4), *(("gateway", f"svc{k}", 8) for k in range(3))], "client string, server string, want int")
    return V.flow_trace_causes(asked, sel, cap.select("mark", "client", "server"), want)


@query("v10_flow_causes", CAUSES + "SELECT * FROM c")
def v10c(spark, d):
    return causes(spark, d)


@query("v10_cause_summary", CAUSES + """, t AS (SELECT count(*) AS traces, count(*) FILTER (status = 'ok') AS built, count(*) FILTER (exact) AS exact, count(*) FILTER (assigned) AS assigned, count(*) FILTER (capture_fault) AS capture_faults, count(*) FILTER (pairing_fault) AS pairing_faults,
  sum(COLUMNS(['want', 'predicted', 'covered', 'correct', 'correct_predicted', 'not_captured', 'not_paired', 'extra', 'wrong_mark']))::BIGINT FROM c), u AS (SELECT *, round(100.0 * correct_predicted / predicted, 6) AS precision, round(100.0 * correct / want, 6) AS recall FROM t)
SELECT *, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM u""")
def v10d(spark, d):
    return V.flow_cause_summary(causes(spark, d))


L = duck("load_requests")


@query("v11_load_summary", L + """, g AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY mode ORDER BY ts, index)))::DOUBLE AS gap, row_number() OVER (PARTITION BY mode ORDER BY latency_ms) AS r, count(*) OVER (PARTITION BY mode) AS n FROM load_requests)
SELECT mode, count(*) AS requests, count(*) FILTER (status >= 400) AS errors, round(avg(latency_ms), 4) AS mean_ms, round(avg(gap), 3) AS gap_mean_us, round(stddev_pop(gap) / 1000, 3) AS gap_std_ms,
  max(latency_ms) FILTER (r = floor((n - 1) * 0.5) + 1) AS p50, max(latency_ms) FILTER (r = floor((n - 1) * 0.9) + 1) AS p90, max(latency_ms) FILTER (r = floor((n - 1) * 0.99) + 1) AS p99 FROM g GROUP BY mode""")
def v11(spark, d):
    return V.load_summary(view(spark, d, "load_requests"), ["mode"])


@query("v11_load_timing", L + """, g AS (SELECT *, epoch_us(ts) AS began, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY mode ORDER BY ts, index))) / 1000.0 AS gap, (epoch_us(ts) % 10000000) / 1000.0 AS late FROM load_requests),
r AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY late) - 1 AS lr, count(*) OVER (PARTITION BY mode) AS ln, row_number() OVER (PARTITION BY mode ORDER BY gap NULLS LAST) - 1 AS gr, count(gap) OVER (PARTITION BY mode) AS gn FROM g),
a AS (SELECT mode, count(*) AS requests, (max(began + round(latency_ms * 1000)::BIGINT) - min(began)) / 1e6 AS elapsed_s, max(late) AS lag_max, """ + ", ".join(f"max({v}) FILTER ({v[0]}r = floor(({v[0]}n - 1) * {q})) AS {name}_p{p}" for v, name in (("late", "lag"), ("gap", "gap")) for p, q in ((50, 0.5), (90, 0.9), (99, 0.99))) + """ FROM r GROUP BY mode)
SELECT *, round(CASE WHEN elapsed_s > 0 THEN requests / elapsed_s ELSE 0 END, 6) AS rate_rps FROM a""")
def v11c(spark, d):
    """Requests are due every ten seconds; the lag is the time since."""
    late = (F.unix_micros(F.col("ts").cast("timestamp")) % 10_000_000) / 1000
    return V.load_timing(view(spark, d, "load_requests").withColumn("start_lag_ms", late), ["mode"])


@query("v11_status_counts", L + "SELECT mode, status, count(*) AS n FROM load_requests GROUP BY 1, 2")
def v11b(spark, d):
    return V.status_counts(view(spark, d, "load_requests"))


@query("v12_max_concurrency", duck("calls") + """, e AS (SELECT start_us AS t, 1 AS d FROM calls WHERE client = 'ext' UNION ALL SELECT end_us, -1 FROM calls WHERE client = 'ext')
SELECT max(n)::BIGINT AS max_concurrency FROM (SELECT sum(d) OVER (ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS n FROM e)""")
def v12(spark, d):
    # Ends of an instant come first, so the most that are open is reached after its starts, at the slice's running sum.
    return V.max_concurrency(view(spark, d, "calls").where("client = 'ext'"))


@query("v13_run_summary", L + """SELECT mode, requests, errors, n500 FROM (SELECT mode, count(*) AS requests, count(*) FILTER (status >= 400) AS errors FROM load_requests GROUP BY 1) a FULL JOIN (SELECT mode, count(*) AS n500 FROM load_requests WHERE status = 500 GROUP BY 1) b USING (mode)""")
def v13(spark, d):
    r = view(spark, d, "load_requests")
    a = V.load_summary(r, ["mode"]).select("mode", "requests", "errors")
    b = V.status_counts(r).where("status = 500").select("mode", F.col("n").alias("n500"))
    return V.run_summary(a, b, on=["mode"])


OVER = L + """, m AS (SELECT rate, mode, count(*) AS n, avg(latency_ms) AS mean, stddev_samp(latency_ms) AS std FROM load_requests GROUP BY 1, 2)
"""


@query("v14_overhead", OVER + "SELECT m.rate, m.mode, m.n, round(m.mean, 6) AS mean, round(m.std, 6) AS std, round(m.mean - b.mean, 6) AS delta FROM m LEFT JOIN m b ON b.rate = m.rate AND b.mode = 'view'")
def v14(spark, d):
    return V.overhead_by_rate(view(spark, d, "load_requests"))


@query("v14_overhead_by_repeat", L + """, u AS (SELECT rate, mode, index % 5 AS repeat, avg(latency_ms) AS value FROM load_requests WHERE NOT (mode = 'view' AND (rate = 3 OR (rate = 1 AND index % 5 = 4))) GROUP BY 1, 2, 3),
b AS (SELECT rate, repeat, value AS same FROM u WHERE mode = 'view'), t AS (SELECT rate, avg(same) AS typical FROM b GROUP BY 1),
x AS (SELECT u.*, value - coalesce(same, typical, 0) AS delta FROM u LEFT JOIN b USING (rate, repeat) LEFT JOIN t USING (rate))
SELECT rate, mode, count(*) AS repeats, round(avg(delta), 6) AS delta, round(coalesce(stddev_samp(delta), 0), 6) AS delta_std FROM x GROUP BY 1, 2""")
def v14b(spark, d):
    """One repeat of rate 1 has no baseline run, and rate 3 has none at all."""
    r = view(spark, d, "load_requests").withColumn("repeat", F.col("index") % 5)
    r = r.where("not (mode = 'view' and (rate = 3 or (rate = 1 and repeat = 4)))")
    return V.overhead_by_repeat(r.groupBy("rate", "mode", "repeat").agg(F.avg("latency_ms").alias("value")), "view")


@query("v15_metric_table", L + """, w AS (SELECT rate, count(*)::DOUBLE AS requests, count(*) FILTER (status >= 400)::DOUBLE AS errors FROM load_requests GROUP BY 1)
SELECT rate, 'requests' AS metric, requests AS "value" FROM w UNION ALL SELECT rate, 'errors', errors FROM w""")
def v15(spark, d):
    w = V.load_summary(view(spark, d, "load_requests"), ["rate"]).select("rate", F.col("requests").cast("double"), F.col("errors").cast("double"))
    return V.metric_table(w, ["rate"], ["requests", "errors"])


@query("v16_pivot_modes", L + """SELECT rate, nullif(count(*) FILTER (mode = 'click'), 0) AS click, nullif(count(*) FILTER (mode = 'view'), 0) AS view, nullif(count(*) FILTER (mode = 'error'), 0) AS error FROM load_requests GROUP BY 1""")
def v16(spark, d):
    return V.pivot_modes(view(spark, d, "load_requests"), ["click", "view", "error"])


@query("v16_ablation", L + """, s AS (SELECT rate, mode, CASE WHEN rate < 2 THEN max(latency_ms) END AS p, max(latency_ms) / 2 AS q FROM load_requests GROUP BY 1, 2)
SELECT rate, max(coalesce(p, q)) FILTER (mode = 'click') AS click, max(coalesce(p, q)) FILTER (mode = 'error') AS error FROM s GROUP BY 1""")
def v16b(spark, d):
    """Summaries of rates 2 and 3 lack the first column, so the second speaks for them."""
    s = view(spark, d, "load_requests").groupBy("rate", "mode").agg(F.max("latency_ms").alias("most"))
    s = s.select("rate", "mode", F.when(F.col("rate") < 2, F.col("most")).alias("p"), (F.col("most") / 2).alias("q"))
    return V.ablation_table(s, "rate", "mode", ["p", "q"], ["click", "error"])
