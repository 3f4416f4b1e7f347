"""Exact de-duplication by two-pass Bloom filtering, in DataFrame functions only.

Pass one hashes every text and counts the slots its hash falls on; slots hit
twice or more make a bitmap of bounded size. Pass two probes that bitmap: a text
is possibly repeated only if all its slots were hit twice. Only those rows are
shuffled and grouped; all others pass straight through as groups of one. A
filter that is too small lets more rows through to the grouping, never fewer, so
the result doesn't depend on its size.

Defined results: a null text counts as empty; a null id ranks below every id;
of rows repeated with the same id and text exactly one stays, in
``drop_exact_duplicates`` the one whose columns, as JSON, sort last; an empty table
gives an empty result; other columns, whatever their names, are carried along
by ``drop_exact_duplicates`` and ignored by ``exact_groups``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopgraph.llm.common import ascii_lower, read_table, text_of, written

#: One bitmap row: 32768 bits, what bitmap_construct_agg makes.
BITMAP_BITS = 32768
#: The broadcast filter is never larger than this (64 MB); beyond it the filter only gets less sharp.
MAX_FILTER_BITS = 2**29
BITS_PER_ROW = 16
PROBES = 2


def text_sha(text: str = "text") -> Column:
    return F.sha2(ascii_lower(text_of(text)), 256)


def filter_bits(rows: int) -> int:
    wanted = 2 ** math.ceil(math.log2(max(1, rows) * BITS_PER_ROW))
    return min(MAX_FILTER_BITS, max(2**18, wanted))


def _slot(sha: Column, probe: int, bits: int) -> Column:
    part = F.conv(F.substring(sha, 1 + 15 * probe, 15), 16, 10).cast("long")
    return F.pmod(part, F.lit(bits))


def repeated_filter(hashes: DataFrame, bits: int) -> DataFrame:
    """(bucket, bitmap) of the slots that two or more rows of ``hashes`` (column ``sha``) fall on."""
    slots = hashes.select(F.explode(F.array(*[_slot(F.col("sha"), p, bits) for p in range(PROBES)])).alias("slot"))
    twice = slots.groupBy("slot").agg(F.count("*").alias("n")).where("n >= 2")
    return (
        twice.groupBy(F.expr(f"slot div {BITMAP_BITS}").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.col("slot") % BITMAP_BITS).alias("bitmap"))
    )


def mark_possible(rows: DataFrame, filter_df: DataFrame, bits: int) -> DataFrame:
    """Add ``possible``: whether all slots of ``sha`` are set in the filter (bounded, so broadcast)."""
    hit = F.lit(True)
    for p in range(PROBES):
        side = F.broadcast(filter_df.select(F.col("bucket").alias(f"_bucket{p}"), F.col("bitmap").alias(f"_bitmap{p}")))
        slot = _slot(F.col("sha"), p, bits)
        rows = rows.withColumn(f"_slot{p}", slot).join(side, F.expr(f"_slot{p} div {BITMAP_BITS}") == F.col(f"_bucket{p}"), "left")
        at = F.col(f"_slot{p}") % BITMAP_BITS
        byte = F.conv(F.hex(F.substring(F.col(f"_bitmap{p}"), (F.expr(f"(_slot{p} % {BITMAP_BITS}) div 8") + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        bit = F.expr("1") == F.when(F.col(f"_bitmap{p}").isNull(), 0).otherwise((byte / F.pow(F.lit(2), at % 8)).cast("int") % 2)
        hit = hit & bit
    rows = rows.withColumn("possible", hit)
    return rows.drop(*[f"{c}{p}" for p in range(PROBES) for c in ("_bucket", "_bitmap", "_slot")])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    hashes = written(docs.select(F.col(id_col).alias("doc_id"), text_sha(text_col).alias("sha")), "exact-hashes")
    bits = filter_bits(hashes.count())
    marked = mark_possible(hashes, written(repeated_filter(hashes, bits), "exact-filter"), bits)
    alone = marked.where(~F.col("possible")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256")
    )
    rows = marked.where("possible").groupBy("sha", "doc_id").agg(F.count("*").alias("n"))
    # Written, so that the join below deals both sides anew and a large group can be split over tasks.
    groups = written(rows.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")), "exact-groups")
    rows = written(rows, "exact-rows")
    again = (
        rows.join(groups, "sha")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))
    )
    return alone.unionByName(again)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of each group of equal texts only the one with the largest id."""
    columns = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), text_sha(text_col).alias("sha"))
    hashes = written(keyed.select("sha"), "exact-hashes")
    bits = filter_bits(hashes.count())
    marked = mark_possible(keyed, written(repeated_filter(hashes, bits), "exact-filter"), bits)
    alone = marked.where(~F.col("possible")).select("row")
    kept = marked.where("possible").groupBy("sha").agg(F.max_by("row", F.struct(F.col("row")[id_col], F.to_json("row"))).alias("row")).select("row")
    return alone.unionByName(kept).select("row.*")


def op10_exact_dedup(spark, sf_dir):
    return exact_groups(read_table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
