"""Readers and writers of messages, observations, spans, flow logs and load reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopgraph.operators.common import new_path

#: The 15 columns of a message table, in order.
MESSAGE_COLUMNS = [
    "protocol_type", "msg_type", "timestamp", "network_duration_us", "client", "server", "stream_id", "trace_id", "span_id", "parent_span_id",
    "span_kind", "span_endpoint", "peer_endpoint", "headers", "data",
]
MESSAGE_SCHEMA = ", ".join(f"{c} {'timestamp_ntz' if c == 'timestamp' else 'bigint' if c == 'network_duration_us' else 'string'}" for c in MESSAGE_COLUMNS)
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
OBSERVATION_SCHEMA = "event_id string, caller string, callee string, operation string, start_ns bigint, end_ns bigint, request map<string,string>, response map<string,string>"
QUERY_SCHEMA = "query_id string, scenario string, sink struct<event_id:string,location:string,field:string>, value string"
ORACLE_SCHEMA = "event_id string, call_children array<string>, source string, flow_edges array<struct<from:struct<event_id:string,location:string,field:string>,to:struct<event_id:string,location:string,field:string>>>"
SPAN = "struct<traceID:string,spanID:string,operationName:string,startTime:bigint,duration:bigint,processID:string,references:array<struct<refType:string,traceID:string,spanID:string>>,tags:array<struct<key:string,value:string>>>"
JAEGER_SCHEMA = f"data array<struct<traceID:string,spans:array<{SPAN}>,processes:map<string,struct<serviceName:string>>>>"
REQUEST = "struct<index:bigint,mark:string,started_at:double,ended_at:double,start_lag_ms:double,latency_ms:double,status:int,bytes:bigint,error:string>"


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Message CSV files with quoted JSON and line breaks inside fields."""
    return spark.read.schema(MESSAGE_SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').option("timestampNTZFormat", TIME_FORMAT).csv(path)


def write_messages(df: DataFrame, path: str | None = None) -> str:
    """Message CSV files, each ordered by time."""
    path = path or new_path(df.sparkSession, "messages")
    df.select(*MESSAGE_COLUMNS).sortWithinPartitions("timestamp", "client", "server", "stream_id").write.option("header", True).option("escape", '"').option("timestampNTZFormat", TIME_FORMAT).csv(path)
    return path


def from_fixture(messages: DataFrame) -> DataFrame:
    """Messages with time in µs as the 15 columns."""
    have = messages.withColumn("timestamp", F.timestamp_micros("time_us").cast("timestamp_ntz"))
    return have.select(*[F.col(c) if c in have.columns else F.lit(None).cast("bigint" if c == "network_duration_us" else "string").alias(c) for c in MESSAGE_COLUMNS])


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OBSERVATION_SCHEMA).json(path)


def write_observations(events: DataFrame, path: str | None = None) -> str:
    path = path or new_path(events.sparkSession, "observations")
    events.select("event_id", "caller", "callee", F.lit("call").alias("operation"), "start_ns", "end_ns", F.create_map(F.lit("value"), "value").alias("response")).write.json(path)
    return path


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUERY_SCHEMA).json(path)


def read_flow_oracle(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ORACLE_SCHEMA).json(path)


def read_jaeger(spark: SparkSession, path: str, root_operation: str | None = None, lines: bool = False) -> DataFrame:
    """Spans of trace files that hold exactly one trace (``lines``: of lines that do); with ``root_operation`` only of traces whose root has that name."""
    traces = spark.read.schema(JAEGER_SCHEMA).option("multiLine", not lines).json(path).where("size(data) = 1").select(F.col("data")[0].alias("t"))
    if root_operation:
        traces = traces.where(F.exists("t.spans", lambda s: (F.coalesce(F.size(s["references"]), F.lit(0)) <= 0) & (s["operationName"] == root_operation)))
    spans = traces.select(F.explode("t.spans").alias("s"), F.col("t.processes").alias("processes"))
    kind = F.element_at(F.transform(F.filter("s.tags", lambda t: t["key"] == "span.kind"), lambda t: t["value"]), 1)
    return spans.select(
        F.col("s.traceID").alias("trace_id"), F.col("s.spanID").alias("sid"), F.col("s.startTime").alias("start_us"), F.col("s.duration").alias("duration_us"),
        F.col("s.operationName").alias("op_name"), F.transform("s.references", lambda r: F.struct(r["traceID"].alias("trace_id"), r["spanID"].alias("sid"))).alias("references"),
        F.col("processes")[F.col("s.processID")]["serviceName"].alias("process"), kind.alias("kind"),
    )


def write_jaeger(spans: DataFrame, path: str | None = None) -> str:
    """spans(trace_id, sid, parent_sid, start_us, duration_us, op_name, process) as one trace a line."""
    path = path or new_path(spans.sparkSession, "jaeger")
    reference = F.when(F.col("parent_sid").isNotNull(), F.array(F.struct(F.lit("CHILD_OF").alias("refType"), F.col("trace_id").alias("traceID"), F.col("parent_sid").alias("spanID"))))
    span = F.struct(
        F.col("trace_id").alias("traceID"), F.col("sid").alias("spanID"), F.col("op_name").alias("operationName"), F.col("start_us").alias("startTime"), F.col("duration_us").alias("duration"),
        F.col("process").alias("processID"), reference.alias("references"),
    )
    traces = spans.groupBy("trace_id").agg(F.collect_list(span).alias("spans"))
    names = F.array_distinct(F.transform("spans", lambda s: s["processID"]))
    processes = F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.struct(n.alias("serviceName")))))
    traces.select(F.array(F.struct(F.col("trace_id").alias("traceID"), "spans", processes.alias("processes"))).alias("data")).write.json(path)
    return path


def read_flow_log(df: DataFrame, start_us: int, end_us: int, mark_prefix: str | None = None, limit: int | None = None) -> DataFrame:
    """Flow rows of a time window, optionally of marks with a prefix, in time order, the first ``limit``."""
    df = df.where(F.col("start_us").between(start_us, end_us))
    if mark_prefix:
        df = df.where(F.col("mark").startswith(mark_prefix))
    df = df.orderBy("start_us", "row_id")
    return df.limit(limit) if limit else df


def read_load_report(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The requests of report files (``lines``: of reports that are one line each)."""
    report = spark.read.schema(f"rate double, requests array<{REQUEST}>").option("multiLine", not lines).json(path)
    return report.select("rate", F.explode("requests").alias("r")).select("rate", "r.*")


def write_load_report(requests: DataFrame, path: str | None = None, size: int = 1000) -> str:
    """requests(rate, index, mark, latency_ms, status) as reports of neighbouring indexes, one a line, at most ``size`` requests each."""
    path = path or new_path(requests.sparkSession, "load-reports")
    request = F.struct("index", "mark", "latency_ms", "status")
    parts = requests.groupBy(F.col("rate").cast("double").alias("rate"), F.floor(F.col("index") / size).alias("part")).agg(F.collect_list(request).alias("requests"))
    parts.select("rate", "requests").write.json(path)
    return path


def write_paired(calls: DataFrame, path: str | None = None) -> str:
    path = path or new_path(calls.sparkSession, "paired")
    calls.write.parquet(path)
    return path
