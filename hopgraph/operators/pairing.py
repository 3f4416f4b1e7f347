"""Messages to calls and back: de-duplication, pairing, spans and complete traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopgraph.functions.columns import is_loopback


def drop_loopback(df: DataFrame, client: str = "client", server: str = "server") -> DataFrame:
    return df.where(~(is_loopback(F.col(client)) & is_loopback(F.col(server))))


def drop_hosts(df: DataFrame, hosts: list[str]) -> DataFrame:
    return df.where(~F.col("client").isin(hosts) & ~F.col("server").isin(hosts))


def dedupe_observations(df: DataFrame) -> DataFrame:
    """One row per (msg_type, src, dst, tcp_seq): the richest payload (first seen on ties), earliest time per direction, row count."""
    rich = F.struct(F.char_length("payload").alias("a"), F.col("n_headers").alias("b"), (-F.col("at")).alias("c"))
    side = lambda d: F.min(F.when(F.col("direction") == d, F.col("time_us")))
    return df.groupBy("msg_type", "src", "dst", "tcp_seq").agg(
        F.max_by("payload", rich).alias("payload"), side("OUT").alias("out_us"), side("IN").alias("in_us"), F.min("time_us").alias("time_us"), F.count("*").alias("rows")
    )


def dedupe_segments(df: DataFrame) -> DataFrame:
    return df.dropDuplicates(["src", "dst", "tcp_seq", "payload"])


def pair_fifo(df: DataFrame, conn: str = "conn", order: str = "at") -> DataFrame:
    """(conn, req_at, res_at): the n-th request of a connection with the n-th response that finds one waiting.

    A response is an orphan when the running balance (+1 request, -1 response) reaches a new low below
    zero. Orphans so far are the fall of the running low, so accepted responses are counted by windows
    alone; unanswered requests keep a null response.
    """
    w = Window.partitionBy(conn).orderBy(order)
    request = F.col("msg_type") == "Request"
    b = df.withColumn("balance", F.sum(F.when(request, 1).otherwise(-1)).over(w))
    b = b.withColumn("low", F.least(F.min("balance").over(w), F.lit(0)))
    b = b.withColumn("low_before", F.coalesce(F.lag("low").over(w), F.lit(0)))
    b = b.where(request | (F.col("low") == F.col("low_before")))
    kind = Window.partitionBy(conn, "msg_type").orderBy(order)
    b = b.withColumn("n", F.row_number().over(kind))
    req = b.where(request).select(conn, "n", F.col(order).alias("req_at"))
    res = b.where(~request).select(conn, "n", F.col(order).alias("res_at"))
    return req.join(res, [conn, "n"], "left").select(conn, "req_at", "res_at")


def pair_by_stream(frames: DataFrame) -> DataFrame:
    """HTTP/2 frames (client, server, stream_id, msg_type, time_us, data) folded into one call a stream."""
    request = F.col("msg_type") == "Request"
    return frames.groupBy("client", "server", "stream_id").agg(
        F.min(F.when(request, F.col("time_us"))).alias("start_us"), F.min(F.when(~request, F.col("time_us"))).alias("end_us"),
        F.array_sort(F.collect_set(F.when(request, F.col("data")))).alias("req_data"), F.array_sort(F.collect_set(F.when(~request, F.col("data")))).alias("res_data"),
    ).where("start_us is not null")


def pair_by_request_id(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """requests(conn, request_id, time_us), responses(conn, response_to, time_us, result): repeated observations fold to the earliest."""
    req = requests.groupBy("conn", "request_id").agg(F.min("time_us").alias("start_us"))
    res = responses.groupBy("conn", F.col("response_to").alias("request_id")).agg(F.min("time_us").alias("end_us"), F.array_sort(F.collect_set("result")).alias("results"))
    return req.join(res, ["conn", "request_id"], "left")


def pair_messages(messages: DataFrame, strict: bool = False) -> DataFrame:
    """Calls keyed by (client, server, stream_id) that have both directions; of repeats the latest row counts.

    ``strict`` also asks for a trace id and an end not before the start, and lifts durations to 1 µs.
    """
    request = F.col("msg_type") == "Request"
    last = lambda c, cond: F.max_by(F.when(cond, F.col(c)), F.when(cond, F.col("time_us")))
    calls = messages.groupBy("client", "server", "stream_id").agg(
        F.max("trace_id").alias("trace_id"), F.max(F.when(request, F.col("time_us"))).alias("start_us"), F.max(F.when(~request, F.col("time_us"))).alias("end_us"),
        last("data", request).alias("req_data"), last("data", ~request).alias("res_data"),
    ).where("start_us is not null and end_us is not null")
    if strict:
        calls = calls.where("trace_id is not null and trace_id <> '' and end_us >= start_us").withColumn("end_us", F.greatest("end_us", F.col("start_us") + 1))
    return calls


def to_span_rows(calls: DataFrame, form: str = "rpc") -> DataFrame:
    """Span rows. ``rpc``: one a call, a client span if it has a parent. ``client-server``: a child call gives a client and a server span."""
    child = F.col("parent_id").isNotNull()
    if form == "rpc":
        kind = F.when(child, "client").otherwise("server")
        return calls.select("trace_id", F.col("call_id").alias("span_id"), F.col("parent_id").alias("parent_span_id"), kind.alias("kind"), F.when(child, F.col("client")).otherwise(F.col("server")).alias("endpoint"), F.when(child, F.col("server")).otherwise(F.col("client")).alias("peer"))
    server_id = F.when(child, F.substring(F.sha2(F.concat_ws("|", F.col("trace_id").cast("string"), "call_id", F.lit("server")), 256), 1, 16)).otherwise(F.col("call_id"))
    span = lambda i, p, k, e, o: F.struct(i.alias("span_id"), p.alias("parent_span_id"), F.lit(k).alias("kind"), e.alias("endpoint"), o.alias("peer"))
    c, s = F.col("client"), F.col("server")
    rows = F.when(child, F.array(span(F.col("call_id"), F.col("parent_id"), "client", c, s), span(server_id, F.col("call_id"), "server", s, c)))
    return calls.select("trace_id", F.explode(rows.otherwise(F.array(span(F.col("call_id"), F.col("parent_id"), "server", s, c)))).alias("x")).select("trace_id", "x.*")


def to_message_rows(calls: DataFrame) -> DataFrame:
    """Request and response rows of calls; a direction counts only if it has a time or data."""
    row = lambda kind, t, d: F.struct(F.lit(kind).alias("msg_type"), t.alias("time_us"), d.alias("data"))
    pair = F.array(row("Request", F.col("start_us"), F.col("value_a")), row("Response", F.col("end_us"), F.col("value_b")))
    return calls.select("client", "server", "call_id", F.explode(pair).alias("m")).select("client", "server", "call_id", "m.*").where("time_us is not null or data is not null")


def trace_sizes(calls: DataFrame) -> DataFrame:
    return calls.groupBy("trace_id").agg(F.count("*").alias("n"))


def upper_median(df: DataFrame, col: str) -> DataFrame:
    """One row: the element at place count // 2 of the sorted values, from a histogram."""
    h = df.groupBy(F.col(col).alias("median")).agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.orderBy("median"))  # a row for each distinct size
    total = F.sum("k").over(Window.partitionBy())
    return h.select("median", upto.alias("upto"), total.alias("total")).where("upto > total div 2").agg(F.min("median").alias("median"))


def filter_complete_traces(calls: DataFrame, expected: int = 0, keep: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept rows, removed trace ids): traces with exactly ``expected`` calls; with 0, of at least int(0.75 x upper median)."""
    sizes = trace_sizes(calls)
    if expected:
        bad = sizes.where(F.col("n") != expected)
    else:
        bad = sizes.crossJoin(F.broadcast(upper_median(sizes, "n"))).where("n < floor(0.75 * median)")
    bad = bad.select("trace_id", "n")
    kept = calls.join(bad.select("trace_id"), "trace_id", "left_anti")
    if keep is not None:
        kept = kept.unionByName(calls.where(keep).join(bad.select("trace_id"), "trace_id", "left_semi"))
    return kept, bad


def synthesize_clients(spans: DataFrame) -> DataFrame:
    """spans(trace_id, sid, process, kind, parent): a server span under a server span of another process gets a client span between."""
    p = spans.select("trace_id", F.col("sid").alias("parent"), F.col("process").alias("p_process"), F.col("kind").alias("p_kind"))
    j = spans.join(p, ["trace_id", "parent"], "left")
    gap = F.coalesce((F.col("kind") == "server") & (F.col("p_kind") == "server") & (F.col("process") != F.col("p_process")), F.lit(False))
    new = j.where(gap).select("trace_id", F.concat("sid", F.lit("_client")).alias("sid"), F.col("p_process").alias("process"), F.lit("client").alias("kind"), "parent")
    old = j.select("trace_id", "sid", "process", "kind", F.when(gap, F.concat("sid", F.lit("_client"))).otherwise(F.col("parent")).alias("parent"))
    return old.unionByName(new)


def restrict_complete(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls of traces that were seen on every edge of edges(client, server)."""
    total = edges.agg(F.count("*").alias("total"))
    met = calls.join(edges, ["client", "server"], "left_semi").groupBy("trace_id").agg(F.countDistinct("client", "server").alias("met"))
    whole = met.crossJoin(F.broadcast(total)).where("met = total").select("trace_id")
    return calls.join(whole, "trace_id", "left_semi")


def infer_ports(segments: DataFrame) -> DataFrame:
    """segments(src_port, dst_port, payload text) -> (port, protocol); an HTTP/2 port is no HTTP/1 port."""
    p = F.col("payload")
    asks, answers, h2 = p.rlike("^(GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH) "), p.startswith("HTTP/1."), p.startswith("PRI * HTTP/2.0")
    low = F.when(F.col("dst_port") < 32768, F.col("dst_port")).otherwise(F.col("src_port"))
    found = segments.select(
        F.when(h2, low).when(asks, F.col("dst_port")).when(answers, F.col("src_port")).alias("port"), F.when(h2, "HTTP/2").when(asks | answers, "HTTP/1").alias("protocol")
    ).where("port is not null").distinct()
    two = found.where("protocol = 'HTTP/2'")
    return two.unionByName(found.where("protocol = 'HTTP/1'").join(two.select("port"), "port", "left_anti").select("port", "protocol"))
