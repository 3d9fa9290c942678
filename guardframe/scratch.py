"""Scratch space that all executors share, and prefix sums without one large partition."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; on one machine without it, a temporary one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="guardframe-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def removed(spark: SparkSession, *folders: str) -> None:
    """Deletes scratch tables that no later step reads; what is not there is no matter."""
    context = spark.sparkContext
    for folder in folders:
        place = context._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def durable(df: DataFrame) -> DataFrame:
    """The rows computed once, kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, folder: str, *by: str) -> DataFrame:
    """The rows computed once, as a packed table in the folder, which may have been there; `by` names columns that choose files."""
    df.write.mode("overwrite").partitionBy(*by).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def prefix_sum(df: DataFrame, order: list[Column | str], value: Column, name: str) -> DataFrame:
    """df with `name`: the sum of value over the rows before and including each, in an order that should be total.

    Rows are range-partitioned by the order and kept, so that partitions cannot differ
    between the two passes: one adds up each partition, the other runs within it. The
    table of partition sums has a row a partition.
    """
    ranged = durable(df.withColumn("_value", value).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part").agg(F.sum("_value").alias("_sum"))
    # one row for each shuffle partition
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    running = F.sum("_value").over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return (
        ranged.join(offsets, "_part")
        .withColumn(name, F.col("_before") + running)
        .drop("_part", "_before", "_value")
    )


def dense_index(df: DataFrame, order: list[Column | str], start: int = 0, name: str = "idx") -> DataFrame:
    """df with consecutive numbers from start on, in the order."""
    return prefix_sum(df, order, F.lit(1), name).withColumn(name, (F.col(name) + (start - 1)).cast("long"))
