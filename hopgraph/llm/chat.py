"""Chat formatting from an event log, in DataFrame functions only.

Events are partitioned by conversation and sorted by sequence; streamed deltas,
edits and regenerations are folded into final messages, which are rendered with
a template. Kinds of event:

- ``message``: a new message at the end.
- ``delta``: more text at the end of the message begun last.
- ``edit``: new text for the message that began at sequence ``ref``.
- ``regenerate``: the message that began at ``ref`` and all begun since are
  discarded; this one stands in their place.

A message is known by its place in the sorted log, so messages that share a
sequence number are all kept; ``ref`` means the last of them begun before. A
conversation's turns are one row in the end, so one conversation has to fit into
a task, as it has to fit into its result.

In the output every turn stands between control strings. Inside roles and texts
those strings, and those of other common templates, are broken by an escape
that ``unescape`` undoes exactly.

Defined results: null text or role counts as empty; a null conversation id is a
conversation of its own; events with equal sequence go by kind, role and text;
an edit of an unknown message adds nothing; a regeneration of one discards
nothing and stands as a new message; a delta before any message adds nothing; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopgraph.llm.common import read_table

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that a tokenizer may take for control tokens.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TAIL = END + "\n"


def _plain(col: Column, old: str, new: str) -> Column:
    return F.replace(col, F.lit(old), F.lit(new))


def escape(col: Column) -> Column:
    """``~`` becomes ``~0``; ``~1`` goes into every control string, after its first character."""
    return reduce(lambda c, s: _plain(c, s, s[0] + "~1" + s[1:]), CONTROL, _plain(col, "~", "~0"))


def unescape(col: Column) -> Column:
    return _plain(_plain(col, "~1", ""), "~0", "~")


def escape_role(col: Column) -> Column:
    return _plain(escape(col), "\n", "~2")


def unescape_role(col: Column) -> Column:
    return unescape(_plain(col, "~2", "\n"))


def fold_events(events: DataFrame) -> DataFrame:
    """events(conv_id, seq, kind, role, text, ref) -> messages(conv_id, seq, role, text), final ones only; their seq is the place of their first event."""
    order = Window.partitionBy("conv_id").orderBy("seq", "kind", "role", "text", "ref")
    begins = F.col("kind").isin("message", "regenerate")
    e = (
        events.select("conv_id", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "ref")
        .withColumn("at", F.row_number().over(order))
    )
    # The last message begun at ``ref`` before the event that names it.
    heads = e.where(begins).select(F.col("conv_id").alias("h_conv"), F.col("seq").alias("h_seq"), F.col("at").alias("h_at"))
    named = e.where(F.col("kind").isin("edit", "regenerate") & F.col("ref").isNotNull()).select(F.col("conv_id").alias("n_conv"), "ref", F.col("at").alias("n_at"))
    meant = named.join(heads, F.col("n_conv").eqNullSafe(F.col("h_conv")) & (F.col("ref") == F.col("h_seq")) & (F.col("h_at") < F.col("n_at")))
    meant = meant.groupBy("n_conv", "n_at").agg(F.max("h_at").alias("target"))
    order = Window.partitionBy("conv_id").orderBy("at")
    later = order.rowsBetween(1, Window.unboundedFollowing)
    e = (
        e.join(meant, F.col("conv_id").eqNullSafe(F.col("n_conv")) & (F.col("at") == F.col("n_at")), "left")
        .withColumn("own", F.last(F.when(begins, F.col("at")), ignorenulls=True).over(order))
        .withColumn("cut", F.min(F.when(F.col("kind") == "regenerate", F.col("target"))).over(later))
        .withColumn("message", F.when(F.col("kind") == "edit", F.col("target")).otherwise(F.col("own")))
    )
    parts = e.groupBy("conv_id", "message").agg(
        F.array_sort(F.collect_list(F.struct("at", "kind", "text"))).alias("parts"),
        F.max(F.when(begins, F.struct("at", "role", "cut"))).alias("head"),
    ).where("head is not null and (head.cut is null or head.cut > message)")
    sets = F.filter("parts", lambda p: p["kind"] != "delta")
    last_set = F.array_max(F.transform(sets, lambda p: p["at"]))
    live = F.filter("parts", lambda p: p["at"] >= last_set)
    return parts.select("conv_id", F.col("message").alias("seq"), F.col("head.role").alias("role"), F.concat_ws("", F.transform(live, lambda p: p["text"])).alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """messages(conv_id, seq, role, text) -> conv_id, formatted, loss spans (code points, end exclusive) of the assistant texts."""
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    m = messages.select("conv_id", "seq", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    m = m.withColumn("turn_text", F.concat("head", "body", F.lit(TAIL)))
    # Offsets by a running sum over the sorted conversation.
    order = Window.partitionBy("conv_id").orderBy("seq")
    before = F.coalesce(F.sum(F.char_length("turn_text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = (before + F.char_length("head")).cast("int")
    m = m.withColumn("from", start).withColumn("to", (start + F.char_length("body")).cast("int"))
    turns = F.array_sort(F.collect_list(F.struct("seq", "role", "turn_text", "from", "to")))
    return m.groupBy("conv_id").agg(turns.alias("turns")).select(
        "conv_id",
        F.concat_ws("", F.transform("turns", lambda t: t["turn_text"])).alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["from"].alias("from"), t["to"].alias("to"))).alias("loss"),
    )


def parse(formatted: Column) -> Column:
    """The turns back from a formatted conversation: array of (role, text)."""
    turns = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda _, i: i > 0)

    def turn(t):
        at = F.instr(t, "\n")
        body = F.substring(t, at + 1, F.char_length(t) - at - len(TAIL))
        return F.struct(unescape_role(F.substring(t, F.lit(1), at - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(turns, turn)


def loss_text(formatted: Column, loss: Column) -> Column:
    return unescape(F.concat_ws("", F.transform(loss, lambda s: F.substring(formatted, s["from"] + 1, s["to"] - s["from"]))))


def format_events(events: DataFrame) -> DataFrame:
    return render(fold_events(events))


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Rows of a finished log as events: each is a message, in order of turn, role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select(
        "conv_id", F.row_number().over(order).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text", F.lit(None).cast("long").alias("ref")
    )


def digest(formatted: DataFrame) -> DataFrame:
    """What the contract asks for, all read back from the formatted text and its mask."""
    said = F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return (
        formatted.withColumn("read", parse(F.col("formatted")))
        .withColumn("learnt", loss_text(F.col("formatted"), F.col("loss")))
        .select(
            "conv_id",
            F.size("read").cast("long").alias("n_turns"),
            F.sha2(F.concat_ws("", said), 256).alias("turns_sha256"),
            F.char_length("learnt").cast("long").alias("loss_chars"),
            F.sha2(F.col("learnt"), 256).alias("loss_sha256"),
            F.char_length("formatted").cast("long").alias("formatted_chars"),
        )
    )


SAMPLE_TEXT = "</s>[INST] ok [/INST]"


def op4_chat_format(spark, sf_dir):
    given = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SAMPLE_TEXT).alias("text"))
    return digest(format_events(conversation_events(given.unionByName(extra))))


def _sql_escape(x: str) -> str:
    x = f"replace({x}, '~', '~0')"
    for s in CONTROL:
        x = f"replace({x}, '{s}', '{s[0]}~1{s[1:]}')"
    return x


OP4_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{SAMPLE_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{SAMPLE_TEXT}'
), t AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learnt,
    sum(length({_sql_escape('text')}) + length(replace({_sql_escape('role')}, chr(10), '~2')) + {len(START) + 1 + len(TAIL)}) AS formatted_chars
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learnt)::BIGINT AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM t
"""
