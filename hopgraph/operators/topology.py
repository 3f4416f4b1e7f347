"""The service graph, its order and its timing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopgraph.operators.candidates import interval_pairs
from hopgraph.operators.common import ranked, written

#: Rows are ranked within slices of this time.
SLICE_US = 1_000_000


def external_clients(calls: DataFrame) -> DataFrame:
    servers = calls.select(F.col("server").alias("client")).distinct()
    return calls.select("client").distinct().join(servers, "client", "left_anti")


def find_root(calls: DataFrame) -> DataFrame:
    """One row: the service with most calls from outside (first by name on ties)."""
    outside = calls.join(external_clients(calls), "client", "left_semi").groupBy("server").agg(F.count("*").alias("calls"))
    return outside.orderBy(F.desc("calls"), "server").limit(1)


def service_edges(calls: DataFrame) -> DataFrame:
    """Calls by (client, server); root edges come from outside."""
    e = calls.groupBy("client", "server").agg(F.count("*").alias("calls"))
    ext = external_clients(calls).withColumn("root_edge", F.lit(True))
    return e.join(ext, "client", "left").select("client", "server", "calls", F.coalesce("root_edge", F.lit(False)).alias("root_edge"))


def message_graph(messages: DataFrame) -> DataFrame:
    """Directed edges for display, responses reversed, numbered by when they were first seen."""
    answer = F.col("msg_type") == "Response"
    m = messages.select(F.when(answer, F.col("server")).otherwise(F.col("client")).alias("src"), F.when(answer, F.col("client")).otherwise(F.col("server")).alias("dst"), "protocol_type", "time_us")
    g = m.groupBy("src", "dst").agg(F.count("*").alias("n"), F.concat_ws(",", F.array_sort(F.collect_set("protocol_type"))).alias("protocols"), F.min("time_us").alias("first_us"))
    return g.withColumn("seq", F.row_number().over(Window.orderBy("first_us", "src", "dst")))  # a row for each pair of services


def service_tree(edges: DataFrame, root: str) -> DataFrame:
    """Breadth-first tree (service, parent, depth) over the small edge table; each service keeps its first parent by name."""
    tree = edges.sparkSession.createDataFrame([(root, None, 0)], "service string, parent string, depth int")
    depth = 0
    while True:
        level = tree.where(F.col("depth") == depth).select(F.col("service").alias("client"))
        new = edges.join(level, "client").join(tree.select(F.col("service").alias("server")), "server", "left_anti").groupBy("server").agg(F.min("client").alias("parent"))
        new = written(new.select(F.col("server").alias("service"), "parent", F.lit(depth + 1).alias("depth")), "tree-level")
        if new.isEmpty():
            return tree
        tree, depth = tree.unionByName(new), depth + 1


def jaeger_tree(spans: DataFrame) -> DataFrame:
    """spans(sid, parent, process, kind, start_us): edges of client spans with exactly one server child, in order of first start."""
    server = spans.where("kind = 'server'").select(F.col("parent").alias("sid"), F.col("process").alias("callee"), F.col("start_us").alias("child_start"))
    only = server.groupBy("sid").agg(F.count("*").alias("n"), F.min("callee").alias("callee"), F.min("child_start").alias("child_start")).where("n = 1")
    e = spans.where("kind = 'client'").join(only, "sid").groupBy("process", "callee").agg(F.min("start_us").alias("first_us"), F.count("*").alias("calls"))
    return e.withColumn("seq", F.row_number().over(Window.orderBy("first_us", "process", "callee")))


def child_order_first_trace(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """Children of each client in the order of the first trace's starts; services it lacks come last (supervised: reads trace ids)."""
    first = calls.where("parent_id is null").agg(F.min_by("trace_id", F.struct("start_us", "trace_id")).alias("trace_id"))
    seen = calls.join(F.broadcast(first), "trace_id").groupBy("client", "server").agg(F.min("start_us").alias("first_us"))
    j = edges.select("client", "server").join(seen, ["client", "server"], "left")
    return j.withColumn("place", F.row_number().over(Window.partitionBy("client").orderBy(F.col("first_us").asc_nulls_last(), "server")))


def gap_pairs(children: DataFrame, parents: DataFrame, slack_us: int = 50_000, bucket_us: int = 100_000) -> DataFrame:
    """client, server, gap_us, inside: calls with each call of their client's service that is open at their start, or ended at most ``slack_us`` before."""
    pairs = interval_pairs(children, parents, 0, slack_us, bucket_us)
    return pairs.select("client", "server", (F.col("start_us") - F.col("p_start")).alias("gap_us"), (F.col("p_end") >= F.col("end_us")).alias("inside"))


def child_order_gap(pairs: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """pairs(client, server, gap_us, inside) -> a client's callees by the p10 and p50 of their gaps, then most gaps.

    Gaps are those to parents that contain the call. An edge without any takes its other pairs, and one of
    ``edges`` without pairs comes last, with nulls. Without ``inside`` all pairs count as contained.
    """
    inside = F.col("inside") if "inside" in pairs.columns else F.lit(True)
    own = F.when(inside, F.col("gap_us"))
    both = [f(c).alias(f"{name}{k}") for k, c in enumerate((own, F.col("gap_us"))) for name, f in (("p10", lambda c: F.percentile(c, F.lit(0.1))), ("p50", lambda c: F.percentile(c, F.lit(0.5))), ("n", F.count))]
    g = pairs.groupBy("client", "server").agg(*both)
    g = g.select("client", "server", *[F.when(F.col("n0") > 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1")).alias(c) for c in ("p10", "p50", "n")])
    if edges is not None:
        g = edges.select("client", "server").distinct().join(g, ["client", "server"], "left").na.fill(0, ["n"])
    order = Window.partitionBy("client").orderBy(F.col("p10").asc_nulls_last(), F.col("p50").asc_nulls_last(), F.desc("n"), "server")
    return g.withColumn("place", F.row_number().over(order))


def temporal_profile(calls: DataFrame, buckets: int = 10, least: int = 8, max_ratio: float = 1.5, tolerance_us: int = 50_000, floor_us: int = 50_000) -> DataFrame:
    """By edge: mean offset of child starts from parent starts, and its spread over rank buckets, or the reason for none."""
    # Times from the first call on: means of small numbers are exact enough.
    origin = calls.agg(F.min("start_us").alias("origin"))
    calls = calls.crossJoin(F.broadcast(origin)).withColumn("start_us", F.col("start_us") - F.col("origin")).drop("origin")
    n_parents = calls.groupBy(F.col("server").alias("client")).agg(F.count("*").alias("parents"), F.avg("start_us").alias("p_mean"))
    e = calls.groupBy("client", "server").agg(F.count("*").alias("children"), F.avg("start_us").alias("c_mean")).join(n_parents, "client")
    mu = F.col("c_mean") - F.col("p_mean")
    ratio = F.greatest("parents", "children") / F.least("parents", "children")
    e = e.withColumn("mu_us", mu).withColumn(
        "reason", F.when((F.col("parents") < least) | (F.col("children") < least), "too-few-spans").when(ratio > max_ratio, "count-ratio-too-high").when(mu < -tolerance_us, "negative-offset").otherwise("ok")
    )
    good = e.where("reason = 'ok'").select("client", "server", "parents", "children")

    def means(df, keys, name):
        # Row k of n is in bucket b when round(b n / B) <= k < round((b + 1) n / B).
        r = ranked(df, keys, F.expr(f"start_us div {SLICE_US}"), ["start_us", "call_id"])
        b = F.greatest(F.lit(0), F.floor((F.col("k") + 0.5) * buckets / F.col("n")))
        return r.withColumn("bucket", b).groupBy(*keys, "bucket").agg(F.avg("start_us").alias(name))

    c = means(calls.join(good.select("client", "server"), ["client", "server"], "left_semi"), ["client", "server"], "c_avg")
    p = means(calls.join(good.select(F.col("client").alias("server")).distinct(), "server", "left_semi"), ["server"], "p_avg").withColumnRenamed("server", "client")
    spread = c.join(p, ["client", "bucket"]).groupBy("client", "server").agg(F.stddev_samp(F.col("c_avg") - F.col("p_avg")).alias("spread"))
    sigma = F.when(F.col("reason") == "ok", F.greatest(F.coalesce("spread", F.lit(0.0)), F.lit(float(floor_us))))
    return e.join(spread, ["client", "server"], "left").select("client", "server", "parents", "children", "reason", F.when(F.col("reason") == "ok", F.round("mu_us", 3)).alias("mu_us"), F.round(sigma, 3).alias("sigma_us"))


def delay_model(incoming: DataFrame, outgoing: DataFrame, batch: int = 100) -> DataFrame:
    """Endpoint pair's delay from ranks: incoming(service, start_us), outgoing(service, endpoint, start_us) -> mean gap and deviation in seconds."""
    at = F.expr(f"start_us div {SLICE_US}")
    i = ranked(incoming, ["service"], at, ["start_us", "call_id"])
    o = ranked(outgoing, ["service", "endpoint"], at, ["start_us", "call_id"]).withColumnRenamed("start_us", "out_us")
    j = o.select("service", "endpoint", "k", "out_us").join(i.select("service", "k", "start_us"), ["service", "k"])
    b = j.groupBy("service", "endpoint", F.expr(f"k div {batch}").alias("batch")).agg(F.avg(F.col("out_us") - F.col("start_us")).alias("gap"), F.count("*").alias("n"))
    std = F.greatest(F.coalesce(F.sqrt(F.lit(float(batch))) * F.stddev_samp("gap") / 1e6, F.lit(0.001)), F.lit(0.001))
    return b.groupBy("service", "endpoint").agg(F.round(F.sum(F.col("gap") * F.col("n")) / F.sum("n") / 1e6, 6).alias("mean_s"), F.round(std, 6).alias("std_s"))


def endpoint_order(outgoing: DataFrame) -> DataFrame:
    """(service, endpoint, place from 0): a service's endpoints by the first call that it made to each."""
    first = outgoing.groupBy("service", "endpoint").agg(F.min("start_us").alias("first_us"))
    return first.select("service", "endpoint", (F.row_number().over(Window.partitionBy("service").orderBy("first_us", "endpoint")) - 1).alias("place"))


def delay_chain(incoming: DataFrame, outgoing: DataFrame, order: DataFrame, window: int = 100, parallel: bool = False, batches: int = 10) -> DataFrame:
    """(service, window, place, mean_us, std_us): how long each step takes, for each ``window`` of incoming spans by start.

    Both sides of a step are ranked on their own and compared rank by rank. One after another: from the incoming
    start to the first endpoint's start (place 0), from an endpoint's end to the next one's start, and from the
    last one's end to the incoming end (one place more than endpoints). In parallel: from the incoming start to every
    endpoint's start. The deviation is that of ``batches`` batch means times the root of a batch's size, 0.001 where
    there is none.
    """
    i = incoming.select("service", "start_us", "end_us", "call_id")
    o = outgoing.join(order, ["service", "endpoint"]).select("service", "place", "start_us", "end_us", "call_id")

    def series(df: DataFrame, keys: list[str], time: str) -> DataFrame:
        r = ranked(df.select(*keys, F.col(time).alias("t"), "call_id"), keys, F.expr(f"t div {SLICE_US}"), ["t", "call_id"])
        return r.select(*keys, "t", "k")

    ends = order.groupBy("service").agg(F.count("*").cast("int").alias("place"))
    start = series(i, ["service"], "start_us")
    begun = series(o, ["service", "place"], "start_us")
    if parallel:
        steps = begun.withColumnRenamed("t", "to").join(start.withColumnRenamed("t", "from"), ["service", "k"])
    else:
        done = series(o, ["service", "place"], "end_us").withColumn("place", F.col("place") + 1)
        from_us = start.withColumn("place", F.lit(0)).unionByName(done).withColumnRenamed("t", "from")
        to_us = begun.unionByName(series(i, ["service"], "end_us").join(ends, "service")).withColumnRenamed("t", "to")
        steps = from_us.join(to_us, ["service", "place", "k"])
    of_window = Window.partitionBy("service", "place", "window")  # at most ``window`` rows
    d = steps.select("service", "place", F.expr(f"k div {window}").alias("window"), (F.col("k") % window).alias("at"), (F.col("to") - F.col("from")).alias("gap")).withColumn("size", F.ceil(F.count("*").over(of_window) / batches))
    b = d.groupBy("service", "place", "window", "size", F.expr("at div size").alias("batch")).agg(F.sum("gap").alias("total"), F.count("*").alias("n"))
    std = F.sqrt("size") * F.stddev_samp(F.col("total") / F.col("n"))
    b = b.groupBy("service", "place", "window", "size").agg((F.sum("total") / F.sum("n")).alias("mean_us"), std.alias("std_us"))
    return b.select("service", "window", "place", "mean_us", F.when(F.col("std_us") >= 1e-12, F.col("std_us")).otherwise(0.001).alias("std_us"))


def edge_vectors(calls: DataFrame) -> DataFrame:
    """By trace: its edges with their occurrences as one sorted array."""
    e = calls.groupBy("trace_id", "client", "server").agg(F.count("*").alias("n"))
    return e.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.concat_ws(">", "client", "server", F.col("n").cast("string")))).alias("edges"), F.sum("n").alias("spans"))


def vector_counts(calls: DataFrame) -> DataFrame:
    return edge_vectors(calls).groupBy("edges").agg(F.count("*").alias("traces"))


def span_histogram(calls: DataFrame) -> DataFrame:
    return edge_vectors(calls).groupBy("spans").agg(F.count("*").alias("traces"))


def expected_edges(calls: DataFrame) -> DataFrame:
    """By edge: the commonest occurrence over all traces, zeros too, the smallest on ties."""
    per = calls.groupBy("trace_id", "client", "server").agg(F.count("*").alias("n"))
    traces = calls.agg(F.countDistinct("trace_id").alias("traces"))
    h = per.groupBy("client", "server", "n").agg(F.count("*").alias("k"))
    zero = h.groupBy("client", "server").agg(F.sum("k").alias("seen")).crossJoin(F.broadcast(traces)).select("client", "server", F.lit(0).cast("long").alias("n"), (F.col("traces") - F.col("seen")).alias("k"))
    return h.unionByName(zero.where("k > 0")).groupBy("client", "server").agg(F.max_by("n", F.struct("k", -F.col("n"))).alias("expected"))


def apply_service_map(flow: DataFrame, services: DataFrame) -> DataFrame:
    """Fill an empty service by the service map's auto_service, then by its auto_instance (services(kind, name, service))."""
    pick = lambda kind, name: services.where(F.col("kind") == kind).select(F.col("name").alias(name), F.col("service").alias(f"by_{name}"))
    j = flow.join(pick("service", "auto_service"), "auto_service", "left").join(pick("instance", "auto_instance"), "auto_instance", "left")
    return j.withColumn("service", F.coalesce(F.nullif("service", F.lit("")), "by_auto_service", "by_auto_instance")).drop("by_auto_service", "by_auto_instance")
