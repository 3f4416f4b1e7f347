"""Mixing sources to target weights, in DataFrame functions only.

Capped water-filling: every source gets its weight's share of the words, sources
that would pass ``max_epochs`` times their own size are clamped there and the
excess goes to the others by weight until none is above. Sorted by cap over
weight, the clamped sources are a prefix, so one running sum over the small
table of sources finds the fixed point.

A source whose target is r times its size takes floor(r) whole repetitions of
every document and, for the fraction, one more of the documents that come first
in a seeded order, as long as they fit. That order is cut into 4096 buckets by
the hash; sums of whole buckets say what goes before each, and rows are ordered
within a bucket of a source. So no source, however large, passes through one
task. All of this is decided on sizes alone; what is decided is a few places in
the order of each source, and texts are only filtered by them, not shuffled.
Behind a document that is too long the order goes on, in rounds, until no unused
document of the source fits; then the nearest one, which may go over, is taken if
that is nearer than none. So a long document ends no source's budget.

Defined results: a null text has size 0; a null source is a source of its own,
sorted last; documents with a null id are ordered by their text's hash; rows repeated with one id
are separate documents, in order of size and then of a hash of their columns; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from hopgraph.llm.common import WORD, read_table, text_of, written

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = "mix-1"


def water_fill(sources: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """sources(source, source_size) -> source, source_size, target, rate. One row per source, so a small table."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("weight", F.get(table, ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * max_epochs)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    s = (
        s.withColumn("total", F.sum("source_size").over(all_rows))
        .withColumn("left_words", F.col("total") - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("clamped", F.col("cap") * F.col("left_weight") < F.col("weight") * F.col("left_words"))
        .withColumn("first", F.min(F.when(~F.col("clamped"), F.struct(F.row_number().over(order), "left_words", "left_weight"))).over(all_rows))
    )
    level = F.col("weight") * F.col("first.left_words") / F.col("first.left_weight")
    target = F.when(F.col("clamped") | F.col("first").isNull(), F.col("cap").cast("double")).otherwise(level)
    return s.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """docs -> its columns as ``row``, with source, size, place (where the document stands in the seeded order) and tie (the order of rows that share an id)."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(text_of())))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("source").alias("source"),
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), name)).alias("place"),
        F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if isinstance(t.dataType, (ArrayType, MapType, StructType)) else F.col(f"`{c}`") for c, t in zip(docs.columns, docs.schema)]).alias("tie"),
    )


def of_source(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with a table that has a row for each source."""
    return rows.join(table.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), how).drop("of")


def key() -> Column:
    """A row's place in its source's seeded order, to the last detail."""
    return F.struct("place", "size", "tie")


def upto(before: Column) -> Column:
    """Words of the source up to a row in the seeded order; one bucket of one source is all that is sorted at once."""
    fine = Window.partitionBy("source", "bucket").orderBy("place", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    return before + F.sum("size").over(fine)


def ahead(rows: DataFrame) -> DataFrame:
    """rows with ``before``: the words of the source's buckets before their own."""
    words = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    in_order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    words = words.select(F.col("source").alias("of"), F.col("bucket").alias("slot"), F.coalesce(F.sum("words").over(in_order), F.lit(0)).alias("before"))
    return rows.join(words.hint("merge"), F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("slot"))).drop("of", "slot")


def taken_in_order() -> Column:
    """Whether a row joined with its source's decisions gets one more repetition in the seeded order."""
    first = F.coalesce(F.col("budget") > 0, F.lit(False)) & (F.col("cut").isNull() | (key() < F.col("cut")))
    later = F.exists("rounds", lambda r: (F.col("size") > 0) & (F.col("size") <= r["gap"]) & (r["cut"].isNull() | (key() < r["cut"])))
    return first | later


def nearest(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """sources with ``pick``: the row whose size is nearest to their gap, which it may pass, if any is nearer than none."""
    open_rows = of_source(rows, sources).where(~taken_in_order() & (F.col("size") > 0))
    off = F.abs(F.col("gap") - F.col("size"))
    best = open_rows.where(off < F.col("gap")).groupBy("source").agg(F.min(F.struct(off.alias("off"), "place", "size", "tie")).alias("best"))
    best = best.select("source", F.struct("best.place", "best.size", "best.tie").alias("pick"))
    return written(of_source(sources, best, "left"), "mix-sources")


def decisions(thin: DataFrame, weights, max_epochs: float) -> DataFrame:
    """thin(source, size, place, tie) -> by source its size, target and whole repetitions, and which rows are taken once more.

    Those are the rows before ``cut`` in the seeded order; of the rows that are small enough for what a round
    had left those before that round's cut (``rounds``); and a last ``pick``. A row for each source with a
    few values for each round: a small table, which meets the documents without a shuffle of their texts.
    """
    rows = written(ahead(thin.withColumn("bucket", F.substring("place", 1, 3))), "mix-thin")
    plan = water_fill(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    plan = plan.withColumn("whole", F.floor("rate")).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")).drop("rate")
    placed = of_source(rows, plan.select("source", "budget")).withColumn("fits", (F.col("budget") > 0) & (upto(F.col("before")) <= F.col("budget")))
    rows = written(placed.select("source", "bucket", "place", "size", "tie", "fits"), "mix-places")
    first = rows.groupBy("source").agg(F.min(F.when(~F.col("fits"), key())).alias("cut"), F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0)).alias("used"))
    gaps = of_source(plan, first).select("*", (F.col("budget") - F.col("used")).alias("gap")).drop("used")
    gaps = written(gaps, "mix-sources")
    rounds = gaps.select("source", F.lit(None).cast("double").alias("gap"), F.col("cut")).limit(0)
    left = rows.where(~F.col("fits") & (F.col("size") > 0)).drop("fits")
    while True:
        left = written(of_source(left, gaps.select("source", "gap")).where("size <= gap"), "mix-left")
        if left.isEmpty():
            break
        took = upto(F.col("before")) <= F.col("gap")
        left = written(ahead(left).withColumn("took", took).drop("before"), "mix-round")
        step = left.groupBy("source").agg(F.first("gap").alias("gap"), F.min(F.when(~F.col("took"), key())).alias("cut"), F.sum(F.when(F.col("took"), F.col("size")).otherwise(0)).alias("more"))
        step = written(step, "mix-step")
        rounds = rounds.unionByName(step.drop("more"))
        gaps = of_source(gaps, step.select("source", "more"), "left").withColumn("gap", F.col("gap") - F.coalesce("more", F.lit(0))).drop("more")
        gaps = written(gaps, "mix-sources")
        left = left.where(~F.col("took")).drop("took", "gap")
    rounds = rounds.groupBy("source").agg(F.collect_list(F.struct("gap", "cut")).alias("rounds"))
    none = F.array().cast(rounds.schema["rounds"].dataType)
    sources = written(of_source(gaps, rounds, "left").withColumn("rounds", F.coalesce("rounds", none)), "mix-sources")
    return nearest(rows, sources)


def plan_mix(rows: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """rows with source, size, place and tie -> the same with source_size, target, copies and taken."""
    sources = decisions(rows.select("source", "size", "place", "tie"), weights, max_epochs)
    once_more = taken_in_order() | F.coalesce(F.col("pick") == key(), F.lit(False))
    rows = of_source(rows, sources).withColumn("copies", F.col("whole") + once_more.cast("long"))
    return rows.withColumn("taken", F.col("size") * F.col("copies")).drop("whole", "budget", "cut", "rounds", "pick", "gap")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, each document as often as it is taken; budgets are filled until no document fits."""
    return plan_mix(sized(docs), **options).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def op2_source_mix(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    thin = written(sized(docs).select("row.doc_id", "source", "size", "place", "tie"), "mix-sizes")
    return plan_mix(thin).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))) AS place FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM d GROUP BY source
), o AS (
  SELECT *, source_size * 3 AS cap, row_number() OVER (ORDER BY source_size * 3 / weight, source ASC NULLS LAST) AS k FROM s
), p AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS left_words,
    sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight FROM o
), f AS (
  SELECT *, cap * left_weight < weight * left_words AS clamped FROM p
), l AS (
  SELECT left_words AS lw, left_weight AS lg FROM f WHERE NOT clamped ORDER BY k LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN clamped THEN cap::DOUBLE ELSE weight * lw / lg END AS target FROM f LEFT JOIN l ON true
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t
), r AS (
  SELECT doc_id, size, d.source, place, source_size, target, whole, target - whole * source_size AS budget,
    row_number() OVER (PARTITION BY d.source ORDER BY place, size) AS n
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
), w AS (
  SELECT source, 0::BIGINT AS n, target - whole * source_size AS gap, false AS took FROM b
  UNION ALL
  SELECT r.source, r.n, CASE WHEN r.size <= w.gap THEN w.gap - r.size ELSE w.gap END, r.budget > 0 AND r.size <= w.gap FROM w JOIN r ON r.n = w.n + 1 AND r.source IS NOT DISTINCT FROM w.source
), g AS (
  SELECT r.*, w.took, min(w.gap) OVER (PARTITION BY r.source) AS gap FROM r JOIN w ON r.n = w.n AND r.source IS NOT DISTINCT FROM w.source
), q AS (
  SELECT *, NOT took AND size > 0 AND abs(gap - size) < gap AS near FROM g
), x AS (
  SELECT *, near AND row_number() OVER (PARTITION BY source, near ORDER BY abs(gap - size), place, n) = 1 AS pick FROM q
)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN took OR pick THEN 1 ELSE 0 END))::BIGINT AS taken FROM x
"""
