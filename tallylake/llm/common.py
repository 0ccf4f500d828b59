"""Helpers that several operators of this package share."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallylake.session import shared_dir, shared_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The same rows read back from the shared checkpoint folder: a lost executor costs no earlier stage again."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, label: str) -> DataFrame:
    """The same rows read back from files below the shared folder, whose size Spark knows when it picks a join: a small table is
    broadcast without a shuffle of either side. The files stay, so this is for tables that are small beside the input."""
    place = shared_dir(df.sparkSession, label)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def release(spark: SparkSession) -> None:
    """Have Spark's context cleaner remove shuffles and checkpoints that nothing refers to any more.

    It does so when the driver's garbage is collected, which a driver with room to spare may put off until the disks are full. Called
    between the steps of jobs with many of them.
    """
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Batches handed to Python hold at most 8 MB, however long their texts are (Spark's own limit is 64 MB)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def running_offsets(counts: DataFrame, key: str, size: str, out: str, width: int = 1024) -> DataFrame:
    """``counts`` with ``out``: the sum of ``size`` over all smaller keys; keys are integers from 0, one row each.

    Two levels, so that no window sees more than ``width`` rows or one row per ``width`` keys.
    """
    block = F.floor(F.col(key) / width)
    totals = counts.groupBy(block.alias("_block")).agg(F.sum(size).alias("_total"))
    ahead = totals.select("_block", F.coalesce(
        F.sum("_total").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        counts.withColumn("_block", block).join(ahead, "_block")
        .withColumn(out, F.col("_ahead") + F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .drop("_block", "_ahead")
    )
