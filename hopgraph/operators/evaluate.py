"""Scores of predicted traces and parents, and statistics of load reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopgraph.operators.common import ranked, share


def _n(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0)).cast("long")


def scored(calls: DataFrame, pred: DataFrame) -> DataFrame:
    """Calls with their prediction: label_ok and parent_ok, null where nothing was predicted."""
    j = calls.join(pred, "call_id", "left")
    return j.withColumn("label_ok", F.col("label") == F.col("trace_id")).withColumn("parent_ok", F.col("parent_pred").eqNullSafe(F.col("parent_id")) & F.col("label").isNotNull())


def span_metrics(s: DataFrame) -> DataFrame:
    """Of all non-root calls: right, predicted, unpredicted, accuracy and coverage."""
    inner = s.where("parent_id is not null")
    return inner.agg(F.count("*").alias("total"), _n(F.coalesce("label_ok", F.lit(False))).alias("correct"), _n(F.col("label").isNotNull()).alias("predicted")).select(
        "total", "correct", "predicted", (F.col("total") - F.col("predicted")).alias("unpredicted"),
        share(F.col("correct"), F.col("total")).alias("accuracy"), share(F.col("predicted"), F.col("total")).alias("coverage"),
    )


def trace_assignment(s: DataFrame) -> DataFrame:
    """Traces all of whose calls have the right label."""
    t = s.groupBy("trace_id").agg(F.bool_and(F.coalesce("label_ok", F.lit(False))).alias("ok"))
    return t.agg(F.count("*").alias("traces"), _n(F.col("ok")).alias("correct")).withColumn("accuracy", share(F.col("correct"), F.col("traces")))


def trace_assignment_strict(s: DataFrame, population: DataFrame | None = None) -> DataFrame:
    """Expected set equals predicted set: a foreign call spoils the trace it came from and the one it went to.

    With ``population`` (trace_id), the traces that were asked for, those that were never captured, or whose entry
    call wasn't, are in the denominator and not exact.
    """
    missing = s.where("label is null or label <> trace_id").select("trace_id").distinct()
    extra = s.where("label <> trace_id").select(F.col("label").alias("trace_id")).distinct()
    bad = missing.union(extra).distinct().withColumn("bad", F.lit(True))
    t = s.select("trace_id").distinct()
    if population is not None:
        rooted = s.where("parent_id is null").select("trace_id").distinct()
        t = t.union(population.select("trace_id")).distinct()
        bad = bad.union(t.join(rooted, "trace_id", "left_anti").withColumn("bad", F.lit(True))).distinct()
    t = t.join(bad, "trace_id", "left")
    return t.agg(F.count("*").alias("traces"), _n(F.col("bad").isNull()).alias("exact")).withColumn("accuracy", share(F.col("exact"), F.col("traces")))


def parent_edge_metrics(s: DataFrame) -> DataFrame:
    """Micro precision, recall and F1 of (child, parent) edges."""
    truth, guess = F.col("parent_id").isNotNull(), F.col("parent_pred").isNotNull()
    hit = truth & guess & (F.col("parent_id") == F.col("parent_pred"))
    m = s.agg(_n(hit).alias("tp"), _n(guess & ~F.coalesce(hit, F.lit(False))).alias("fp"), _n(truth & ~F.coalesce(hit, F.lit(False))).alias("fn"), _n(truth & ~guess).alias("unpredicted"))
    return m.select("*", share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), share(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def full_trace_accuracy(s: DataFrame) -> DataFrame:
    """Traces whose labels and parent edges are all right, with missing and extra edges."""
    wrong = ~F.coalesce(F.col("parent_pred") == F.col("parent_id"), F.lit(False))
    t = s.groupBy("trace_id").agg(
        F.bool_and(F.coalesce("label_ok", F.lit(False))).alias("labels"),
        _n(F.col("parent_id").isNotNull() & wrong).alias("missing"),
        _n(F.col("parent_pred").isNotNull() & wrong).alias("extra"),
    )
    ok = F.col("labels") & (F.col("missing") == 0) & (F.col("extra") == 0)
    return t.agg(F.count("*").alias("traces"), _n(ok).alias("correct"), F.sum("missing").alias("missing_edges"), F.sum("extra").alias("extra_edges")).withColumn("accuracy", share(F.col("correct"), F.col("traces")))


def root_direct(s: DataFrame, root: str = "gateway") -> DataFrame:
    """Calls made by the root service: right per occurrence and per trace."""
    t = s.where(F.col("client") == root).groupBy("trace_id").agg(F.count("*").alias("n"), _n(F.coalesce("label_ok", F.lit(False))).alias("ok"))
    return t.agg(F.count("*").alias("traces"), _n(F.col("n") == F.col("ok")).alias("traces_ok"), F.sum("n").alias("occurrences"), F.sum("ok").alias("occurrences_ok"))


def edge_accuracy(s: DataFrame) -> DataFrame:
    """Accuracy by client and server."""
    e = s.where("parent_id is not null").groupBy("client", "server").agg(F.count("*").alias("total"), _n(F.coalesce("label_ok", F.lit(False))).alias("correct"))
    return e.withColumn("accuracy", share(F.col("correct"), F.col("total")))


def trace_errors(s: DataFrame) -> DataFrame:
    return s.groupBy("trace_id").agg(_n(~F.coalesce("label_ok", F.lit(False))).alias("errors"))


def error_histogram(s: DataFrame) -> DataFrame:
    return trace_errors(s).groupBy("errors").agg(F.count("*").alias("traces"))


def error_summary(s: DataFrame) -> DataFrame:
    return trace_errors(s).agg(
        F.round(F.avg("errors"), 6).alias("mean"), F.max("errors").alias("max"), F.round(F.percentile("errors", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("errors", F.lit(0.9)), 6).alias("p90"),
    )


def worst_traces(s: DataFrame, traces: int = 10, edges: int = 5) -> DataFrame:
    """The traces with most errors (a report), each with its worst edges."""
    top = trace_errors(s).orderBy(F.desc("errors"), "trace_id").limit(traces)
    bad = s.where(~F.coalesce("label_ok", F.lit(False))).groupBy("trace_id", "client", "server").agg(F.count("*").alias("edge_errors"))
    rank = F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc("edge_errors"), "client", "server"))
    return top.where("errors > 0").join(bad, "trace_id").withColumn("rank", rank).where(F.col("rank") <= edges)


def affected_traces(s: DataFrame) -> DataFrame:
    """By edge: the share of all traces that have an error on it."""
    bad = s.where(~F.coalesce("label_ok", F.lit(False))).groupBy("client", "server").agg(F.countDistinct("trace_id").alias("traces"))
    total = s.agg(F.countDistinct("trace_id").alias("total"))
    return bad.crossJoin(F.broadcast(total)).select("client", "server", "traces", share(F.col("traces"), F.col("total")).alias("share"))


def service_accuracy(s: DataFrame) -> DataFrame:
    """By parent service: calls with a right parent, and parents all of whose children are right."""
    inner = s.where("parent_id is not null")
    per = inner.groupBy("client", "parent_id").agg(F.count("*").alias("n"), _n(F.coalesce(F.col("parent_pred") == F.col("parent_id"), F.lit(False))).alias("ok"))
    out = per.groupBy("client").agg(F.sum("n").alias("calls"), F.sum("ok").alias("calls_ok"), F.count("*").alias("parents"), _n(F.col("n") == F.col("ok")).alias("parents_ok"))
    return out.select("*", share(F.col("calls_ok"), F.col("calls")).alias("accuracy"), share(F.col("parents_ok"), F.col("parents")).alias("node_accuracy"))


def weighted_accuracy(s: DataFrame) -> DataFrame:
    return service_accuracy(s).agg(F.round(F.sum(F.col("accuracy") * F.col("calls")) / F.sum("calls"), 6).alias("weighted"))


def lower_rank(df: DataFrame, value: str, by: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Percentiles by the lower rank: the value at position int((n - 1) q). Rows are sorted in slices of about a percent of the value."""
    v = F.col(value)
    known = df.where(v.isNotNull())
    r = ranked(known, by, F.when(v > 0, F.floor(F.log(v) * 100)).otherwise(F.lit(-(2**40))), [value])
    at = lambda q: F.max(F.when(F.col("k") == F.floor((F.col("n") - 1) * F.lit(q)), v))
    return r.groupBy(*by).agg(*[at(q).alias(name) for name, q in quantiles.items()])


def start_gaps(requests: DataFrame, by: list[str], slice_us: int = 60_000_000) -> DataFrame:
    """requests with ``gap_us``, the time since the group's request before; slices of time hand on their last start."""
    r = requests.withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("_slice", F.expr(f"_at div {slice_us}"))
    ends = r.groupBy(*by, "_slice").agg(F.max("_at").alias("_end"))
    ends = ends.select(*by, "_slice", F.lag("_end").over(Window.partitionBy(*by).orderBy("_slice")).alias("_before"))
    own = F.lag("_at").over(Window.partitionBy(*by, "_slice").orderBy("ts", "index"))
    r = r.withColumn("_own", own).join(ends, [*by, "_slice"])
    return r.withColumn("gap_us", F.col("_at") - F.coalesce("_own", "_before")).drop("_slice", "_at", "_own", "_before")


def load_summary(requests: DataFrame, by: list[str]) -> DataFrame:
    """Requests, errors (status 400 and up, or none), latency percentiles and the gaps between starts, by group."""
    q = lower_rank(requests, "latency_ms", by, {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    a = start_gaps(requests, by).groupBy(*by).agg(
        F.count("*").alias("requests"), _n(F.col("status").isNull() | (F.col("status") >= 400)).alias("errors"), F.round(F.avg("latency_ms"), 4).alias("mean_ms"),
        F.round(F.avg("gap_us"), 3).alias("gap_mean_us"), F.round(F.stddev_pop("gap_us") / 1000, 3).alias("gap_std_ms"),
    )
    return a.join(q, by, "left")


def load_timing(requests: DataFrame, by: list[str]) -> DataFrame:
    """requests(ts, index, latency_ms, start_lag_ms), by group: the rate reached from first start to last end, and percentiles of start lags and of gaps between starts.

    Percentiles are lower ranks; unknown lags and latencies are left out, and a group without a span of time has rate 0.
    """
    ranks = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    end = start + F.coalesce(F.round(F.col("latency_ms") * 1000), F.lit(0)).cast("long")
    r = start_gaps(requests, by).withColumn("gap_ms", F.col("gap_us") / 1000)
    a = r.groupBy(*by).agg(F.count("*").alias("requests"), ((F.max(end) - F.min(start)) / 1e6).alias("elapsed_s"), F.max("start_lag_ms").alias("lag_max"))
    a = a.withColumn("rate_rps", F.round(F.when(F.col("elapsed_s") > 0, F.col("requests") / F.col("elapsed_s")).otherwise(0.0), 6))
    lags = lower_rank(requests, "start_lag_ms", by, {f"lag_{k}": q for k, q in ranks.items()})
    gaps = lower_rank(r, "gap_ms", by, {f"gap_{k}": q for k, q in ranks.items()})
    return a.join(lags, by, "left").join(gaps, by, "left")


def status_counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy("mode", "status").agg(F.count("*").alias("n"))


def max_concurrency(intervals: DataFrame, slice_us: int = 60_000_000) -> DataFrame:
    """Most intervals open at once, ends before starts at one instant. Sums of time slices come first, so no task sweeps all."""
    deltas = intervals.select(F.explode(F.array(F.struct(F.col("start_us").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_us").alias("t"), F.lit(-1).alias("d")))).alias("e")).select("e.*")
    deltas = deltas.groupBy("t").agg(F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("up"), F.sum(F.when(F.col("d") < 0, 1).otherwise(0)).alias("down"))
    deltas = deltas.withColumn("slice", F.expr(f"t div {slice_us}"))
    in_slice = Window.partitionBy("slice").orderBy("t")
    deltas = deltas.withColumn("upto", F.sum(F.col("up") - F.col("down")).over(in_slice))
    slices = deltas.groupBy("slice").agg(F.sum(F.col("up") - F.col("down")).alias("net"), F.max("upto").alias("peak"))
    before = F.coalesce(F.sum("net").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return slices.withColumn("open", before + F.col("peak")).agg(F.max("open").alias("max_concurrency"))


def overhead_by_rate(requests: DataFrame, baseline: str = "view") -> DataFrame:
    """Mean and sample deviation of latency by rate and mode, with the difference from the mode ``baseline``."""
    m = requests.groupBy("rate", "mode").agg(F.count("*").alias("n"), F.avg("latency_ms").alias("mean"), F.stddev_samp("latency_ms").alias("std"))
    base = m.where(F.col("mode") == baseline).select("rate", F.col("mean").alias("base"))
    return m.join(base, "rate", "left").select("rate", "mode", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round(F.col("mean") - F.col("base"), 6).alias("delta"))


def overhead_by_repeat(runs: DataFrame, baseline: str) -> DataFrame:
    """runs(rate, mode, repeat, value) -> by rate and mode the mean and sample deviation of each run's difference from the baseline run of the same repeat.

    Where that repeat has no baseline run, the mean of the rate's baseline runs stands in, and 0 where there is none.
    One run has deviation 0. Runs told twice count by their mean.
    """
    runs = runs.groupBy("rate", "mode", "repeat").agg(F.avg("value").alias("value"))
    base = runs.where(F.col("mode") == baseline).select("rate", "repeat", F.col("value").alias("same"))
    mean = base.groupBy("rate").agg(F.avg("same").alias("typical"))
    delta = F.col("value") - F.coalesce("same", "typical", F.lit(0.0))
    d = runs.join(base, ["rate", "repeat"], "left").join(mean, "rate", "left").withColumn("delta", delta)
    return d.groupBy("rate", "mode").agg(F.count("*").alias("repeats"), F.round(F.avg("delta"), 6).alias("delta"), F.round(F.coalesce(F.stddev_samp("delta"), F.lit(0.0)), 6).alias("delta_std"))


def pivot_modes(requests: DataFrame, modes: list[str]) -> DataFrame:
    return requests.groupBy("rate").pivot("mode", modes).agg(F.count(F.lit(1)))


def ablation_table(summary: DataFrame, workload: str, variant: str, columns: list[str], variants: list[str]) -> DataFrame:
    """A row for each workload and a column for each variant: the first of ``columns`` that the summary's row has."""
    return summary.groupBy(workload).pivot(variant, variants).agg(F.max(F.coalesce(*columns)))


def metric_table(summary: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Wide summary to (keys, metric, value)."""
    return summary.unpivot(keys, metrics, "metric", "value")


def run_summary(*tables: DataFrame, on: list[str]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, on, "full")
    return out


def score_flow_traces(flow: DataFrame, expected: DataFrame) -> DataFrame:
    """flow(mark, client, server) against expected(client, server, want): a row per mark and edge with shortfall and excess."""
    seen = flow.groupBy("mark", "client", "server").agg(F.count("*").alias("seen"))
    grid = flow.select("mark").distinct().crossJoin(F.broadcast(expected))
    j = grid.join(seen, ["mark", "client", "server"], "full").na.fill(0, ["want", "seen"])
    return j.select("mark", "client", "server", "want", "seen", F.greatest(F.col("want") - F.col("seen"), F.lit(0)).alias("short"), F.greatest(F.col("seen") - F.col("want"), F.lit(0)).alias("excess"))


def flow_trace_causes(marks: DataFrame, selected: DataFrame, captured: DataFrame, expected: DataFrame) -> DataFrame:
    """A row for each mark that was asked for: what its trace lacks, and whether capture or pairing is to blame.

    marks(mark, status): 'ok' where a trace was built. selected(mark, client, server, row_mark): the rows of each
    mark's trace with the mark that they bear themselves (null: none). captured(mark, client, server): all rows by their own
    mark. expected(client, server, want). Expected against captured gives what was never captured; captured against
    selected what was there and isn't in the trace. A trace that isn't 'ok' has all it lacks in ``want``, and no cause.
    """
    edges = expected.select("client", "server", "want")
    wrong = F.col("row_mark").isNotNull() & (F.col("row_mark") != F.col("mark"))
    mixed = selected.groupBy("mark").agg(_n(wrong).alias("wrong_mark"))
    sel = selected.join(edges.select("client", "server"), ["client", "server"])
    sel = sel.groupBy("mark", "client", "server").agg(F.count("*").alias("got"), _n(F.coalesce(F.col("row_mark") == F.col("mark"), F.lit(False))).alias("own"))
    cap = captured.join(edges.select("client", "server"), ["client", "server"]).groupBy("mark", "client", "server").agg(F.count("*").alias("there"))
    # A row for each mark asked for and expected edge, which are a handful: rows that nothing was seen of count too.
    grid = marks.join(edges).join(sel, ["mark", "client", "server"], "left").join(cap, ["mark", "client", "server"], "left").join(mixed, "mark", "left").na.fill(0, ["got", "own", "there", "wrong_mark"])
    # In a trace of one mark rows without a mark are right too; in a mixed one only those that bear it.
    grid = grid.withColumn("right", F.when(F.col("wrong_mark") == 0, F.col("got")).otherwise(F.col("own")))
    want, got, there = F.col("want"), F.col("got"), F.col("there")
    more = lambda a, b: F.greatest(a - b, F.lit(0)).cast("long")
    per = grid.groupBy("mark", "status").agg(
        F.sum("want").cast("long").alias("want"), F.sum("got").alias("predicted"), F.sum(F.least(want, got)).cast("long").alias("covered"), F.sum(F.least(want, F.col("right"))).cast("long").alias("correct"),
        F.sum("right").alias("correct_predicted"), F.sum(more(want, got)).alias("missing"), F.sum(more(got, want)).alias("extra"), F.sum(more(want, there)).alias("not_captured"),
        F.sum(more(F.least(want, there), F.least(want, got))).alias("not_paired"), F.max("wrong_mark").alias("wrong_mark"),
    )
    ok = F.col("status") == "ok"
    counts = [F.when(ok, F.col(c)).otherwise(0).cast("long").alias(c) for c in ("predicted", "covered", "correct", "correct_predicted", "missing", "extra", "not_captured", "not_paired", "wrong_mark")]
    return per.select(
        "mark", "status", "want", *counts, (ok & (F.col("not_captured") > 0)).alias("capture_fault"), (ok & ((F.col("not_paired") > 0) | (F.col("wrong_mark") > 0))).alias("pairing_fault"),
        (ok & (F.col("correct") == F.col("want")) & (F.col("wrong_mark") == 0)).alias("assigned"), (ok & (F.col("missing") == 0) & (F.col("wrong_mark") == 0)).alias("exact"),
    )


def flow_cause_summary(causes: DataFrame) -> DataFrame:
    """One row over all marks asked for: exact and assigned traces, spans by cause, and edge precision, recall and F1."""
    s = causes.agg(
        F.count("*").alias("traces"), _n(F.col("status") == "ok").alias("built"), _n(F.col("exact")).alias("exact"), _n(F.col("assigned")).alias("assigned"), _n(F.col("capture_fault")).alias("capture_faults"), _n(F.col("pairing_fault")).alias("pairing_faults"),
        *[F.sum(c).alias(c) for c in ("want", "predicted", "covered", "correct", "correct_predicted", "not_captured", "not_paired", "extra", "wrong_mark")],
    )
    p, r = share(F.col("correct_predicted"), F.col("predicted")), share(F.col("correct"), F.col("want"))
    return s.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, F.round(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")), 6)))


def flow_trace_summary(rows: DataFrame) -> DataFrame:
    m = rows.groupBy("mark").agg(F.sum("short").alias("short"), F.sum("excess").alias("excess"), F.sum(F.least("want", "seen")).alias("met"))
    t = m.agg(F.count("*").alias("traces"), _n((F.col("short") == 0) & (F.col("excess") == 0)).alias("exact"), F.sum("met").alias("tp"), F.sum("excess").alias("fp"), F.sum("short").alias("fn"))
    return t.withColumn("f1", share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
