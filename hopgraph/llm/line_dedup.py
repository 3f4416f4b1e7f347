"""Line de-duplication over levelled sorted runs of line hashes.

``LineRuns`` keeps what has been seen as runs, tables bucketed and sorted by line
hash. Each new batch of lines is merge-anti-joined with the runs: hashes that no
run holds are new, and the batch is added as a run of its own. When a level has
``fanout`` runs, they are compacted into one run of the next level.

Batches are taken by descending document id, so the batch in which a line is
new holds the largest id with that line, which owns it. A run's row has the
hash, its owner (only from the batch in which it was new) and the documents it
was found in; compaction adds the counts up. After the last batch the lines with
enough documents are known, and every other document gives up its copies.

Defined results: a null or empty text is one empty line; rows with a null id are
one document, below all ids; rows that share an id are one document for counting
and each is rewritten; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopgraph.llm.common import BLANKS, ascii_lower, new_path, read_table, text_of, written

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 2
BUCKET_ROWS = 2_000_000
#: Stands for a null id: below all others.
NO_ID = -(2**63)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def key_hash(key: Column) -> Column:
    return F.unhex(F.md5(key))


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


class LineRuns:
    """A store of line hashes in levels of sorted runs."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, rows: int = 0):
        """rows: about how many hashes there will be; runs have a bucket for every ``BUCKET_ROWS`` of them, and at least as many as a shuffle has parts."""
        self.spark, self.fanout, self.levels = spark, fanout, []
        self.buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))
        self.made = []

    def _run(self, rows: DataFrame) -> DataFrame:
        """Write a run: rows of one hash in one bucket, each bucket sorted."""
        path = new_path(self.spark, "line-run")
        name = "line_run_" + path.rsplit("-", 1)[1]
        (
            rows.repartition(self.buckets, "hash").write.bucketBy(self.buckets, "hash").sortBy("hash")
            .option("path", path).saveAsTable(name, format="parquet")
        )
        self.made.append(name)
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def unseen(self, hashes: DataFrame) -> DataFrame:
        """Rows of ``hashes`` whose hash no run holds; both sides are bucketed alike, so the joins merge without a shuffle."""
        for run in self.runs():
            hashes = hashes.hint("merge").join(run.select("hash"), "hash", "left_anti")
        return hashes

    def add(self, batch: DataFrame) -> None:
        """batch(hash, doc_id): distinct pairs, of documents that no earlier batch had."""
        found = self._run(batch.groupBy("hash").agg(F.max("doc_id").alias("top"), F.count("*").alias("docs")))
        new = self.unseen(found).select("hash", F.col("top").alias("owner"), "docs")
        known = found
        if self.runs():
            known = found.hint("merge").join(new.select("hash"), "hash", "left_anti").select("hash", F.lit(None).cast("long").alias("owner"), "docs")
            new = new.unionByName(known)
        self._push(self._run(new), 0)

    def _push(self, run: DataFrame, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self._merged(self.levels[level])
            self.levels[level] = []
            self._push(self._run(merged), level + 1)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        rows = runs[0]
        for run in runs[1:]:
            rows = rows.unionByName(run)
        return rows.groupBy("hash").agg(F.max("owner").alias("owner"), F.sum("docs").alias("docs"))

    def totals(self) -> DataFrame:
        """hash, owner, docs over all runs."""
        return self._merged(self.runs())

    def forget(self) -> None:
        """Take the runs out of the session's catalogue (their files belong to the shared folder)."""
        for name in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def repeated_lines(docs: DataFrame, min_chars=MIN_CHARS, min_docs=MIN_DOCS, batches=BATCHES, fanout=FANOUT) -> DataFrame:
    """(doc_id, hashes): the line hashes that each document has to give up. doc_id: NO_ID for null."""
    spark = docs.sparkSession
    did = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    keys = F.transform(split_lines(text_of()), line_key)
    hashes = F.array_distinct(F.transform(F.filter(keys, lambda k: F.char_length(k) >= min_chars), key_hash))
    lines = docs.select(did.alias("doc_id"), F.explode(hashes).alias("hash"))
    lines = written(lines, "lines")
    cuts = []
    if batches > 1:
        cuts = lines.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    store = LineRuns(spark, fanout, lines.count())
    for k in range(batches - 1, -1, -1):
        part = lines
        if k < batches - 1 and cuts:
            part = part.where(F.col("doc_id") < cuts[k])
        if k > 0 and cuts:
            part = part.where(F.col("doc_id") >= cuts[k - 1])
        elif k > 0:
            continue
        store.add(part.distinct())
    common = written(store.totals().where(F.col("docs") >= min_docs).select("hash", "owner"), "common-lines")
    store.forget()
    return (
        lines.join(common, "hash").where("doc_id <> owner")
        .groupBy("doc_id").agg(F.collect_set("hash").alias("hashes"))
    )


def drop_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with ``kept_text``, ``n_lines`` and ``n_dropped`` beside its columns (as ``row``)."""
    min_chars = options.get("min_chars", MIN_CHARS)
    give = written(repeated_lines(docs, **options), "given-lines").withColumnRenamed("doc_id", "_id")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_of().alias("text"), F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("id"))
    # Merged at every size: what is given up grows with the corpus, so it isn't broadcast.
    rows = rows.join(give.hint("merge"), F.col("id") == F.col("_id"), "left").withColumn("lines", split_lines(F.col("text")))

    def stays(line):
        key = line_key(line)
        return ~F.coalesce(F.when(F.char_length(key) >= min_chars, F.array_contains(F.col("hashes"), key_hash(key))), F.lit(False))

    rows = rows.withColumn("kept", F.when(F.col("hashes").isNull(), F.col("lines")).otherwise(F.filter("lines", stays)))
    return rows.select("row", F.concat_ws("\n", "kept").alias("kept_text"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"))


def op3_line_dedup(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs).select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = """
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.*, c.owner IS NOT NULL AND k.doc_id <> c.owner AS gone FROM k LEFT JOIN c USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
