"""HTTP/1.1 messages from TCP segments."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START_LINE = re.compile(rb"(?:GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH) [^\r\n]* HTTP/1\.[01]\r\n|HTTP/1\.[01] \d{3}[^\r\n]*\r\n")
LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d+)", re.I)
CHUNKED = re.compile(rb"\r\nTransfer-Encoding:[ \t]*chunked", re.I)
CHUNK_SIZE = re.compile(rb"[ \t]*([0-9A-Fa-f]+)[^\r\n]*\r\n")


def chunked_end(data: bytes | bytearray, at: int) -> int | None:
    """Where a chunked body that begins at ``at`` ends, from size to size; None while it isn't whole."""
    while size := CHUNK_SIZE.match(data, at):
        n = int(size[1], 16)
        if n == 0:
            # Trailer lines may follow the last chunk, up to an empty line.
            if data[size.end():size.end() + 2] == b"\r\n":
                return size.end() + 2
            end = data.find(b"\r\n\r\n", size.end())
            return None if end < 0 else end + 4
        at = size.end() + n + 2
        if at > len(data):
            return None
    return None


def cut_message(data: bytes | bytearray, at: int = 0) -> int | None:
    """Where the message that begins at ``at`` ends, or None while it isn't whole."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    head = bytes(data[at:end])
    if CHUNKED.search(head):
        return chunked_end(data, end + 4)
    size = LENGTH.search(head)
    whole = end + 4 + (int(size[1]) if size else 0)
    return whole if len(data) >= whole else None


def messages_of(segments: list[tuple[int, int, bytes]]):
    """segments (time, sequence number, payload) of one direction -> (time, bytes) of its whole messages.

    Segments are laid in order of their numbers, so late ones find their place; overlaps are dropped. What is
    before a gap or before a start line and isn't a whole message is left out. A message's time is that by
    which all bytes up to its end had come.
    """
    data, ends, times, after = bytearray(), [], [], None
    for time, seq, payload in [*sorted(segments, key=lambda s: (s[1], -len(s[2]), s[0])), (0, None, b"")]:
        if seq is None or (after is not None and seq > after):
            at, k = 0, 0
            while start := START_LINE.search(data, at):
                end = cut_message(data, start.start())
                if end is None:
                    # Not whole, unless another start line shows that the gap is inside of it.
                    at = start.end()
                    continue
                while ends[k] < end:
                    k += 1
                yield times[k], bytes(data[start.start():end])
                at = end
            data, ends, times, after = bytearray(), [], [], None
        if seq is None or not payload:
            continue
        new = payload if after is None else payload[after - seq:]
        if not new:
            continue
        data += new
        after = (seq if after is None else after) + len(new)
        ends.append(len(data))
        times.append(max(time, times[-1]) if times else time)


def reassemble_http1(segments: DataFrame, idle_us: int = 60_000_000) -> DataFrame:
    """segments(flow, time_us, seq, payload binary) -> (flow, part, n, time_us, head, body) of every whole message.

    A flow is cut where it is idle for ``idle_us``. A part is the state of one direction and goes through one task.
    """
    w = Window.partitionBy("flow").orderBy("time_us", "seq")
    idle = F.coalesce((F.col("time_us") - F.lag("time_us").over(w) > idle_us).cast("int"), F.lit(0))
    parts = segments.withColumn("idle", idle).withColumn("part", F.sum("idle").over(w)).select("flow", "part", "time_us", "seq", "payload")

    def run(key, g):
        out = []
        for t, message in messages_of([(t, s, bytes(p)) for t, s, p in zip(g["time_us"].tolist(), g["seq"].tolist(), g["payload"])]):
            head, _, body = message.partition(b"\r\n\r\n")
            out.append((*key, len(out), t, head.decode("utf-8", "replace"), body.decode("utf-8", "replace")))
        return pd.DataFrame(out, columns=["flow", "part", "n", "time_us", "head", "body"])

    return parts.groupBy("flow", "part").applyInPandas(run, "flow long, part long, n long, time_us long, head string, body string")
