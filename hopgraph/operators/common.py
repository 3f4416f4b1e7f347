"""Helpers of the trace operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir, else one in the warehouse, or in a local session a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        local = spark.sparkContext.master.startswith("local")
        found = tempfile.mkdtemp(prefix="spark-shared-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/intermediate"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a table in the shared folder."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def renamed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def share(part: Column, whole: Column) -> Column:
    """part / whole in percent, null where whole is zero."""
    return F.when(whole > 0, F.round(100.0 * part / whole, 6))


def ranked(df: DataFrame, by: list[str], slice_of: Column, order: list, name: str = "k") -> DataFrame:
    """df with each row's number (from 0) within its group, and the group's size ``n``.

    ``slice_of`` grows with the first column of ``order``. Rows are sorted within a slice of a group only, and
    sums of the slices before, a small table, say where it begins: no task sorts a whole group.
    """
    df = df.withColumn("_slice", slice_of)
    sizes = df.groupBy(*by, "_slice").agg(F.count("*").alias("_size"))
    w = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_size").over(w.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*by, "_slice", before.alias("_before"), F.sum("_size").over(w).alias("n"))
    place = F.row_number().over(Window.partitionBy(*by, "_slice").orderBy(*order)) - 1
    return df.withColumn("_at", place).join(sizes, [*by, "_slice"]).withColumn(name, F.col("_at") + F.col("_before")).drop("_slice", "_at", "_before")
