"""Long lists that are read page by page: sorted once into ranges of rows, with a count per range.

A page that starts far down a list opens the ranges that it covers and no other row: which ones these are follows from the counts, a row
per range. Without such an index an offset makes Spark sort, and keep, everything before the page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallylake.operators.retail import MAX_PAGE, MIN_PAGE, list_order
from tallylake.sources.lake import full_overwrite_sink

RANGE = "_range"
COUNTS = T.StructType([T.StructField(RANGE, T.IntegerType()), T.StructField("n", T.LongType())])


def write_list(df: DataFrame, entity: str, path: str, ranges: int | None = None) -> None:
    """Store an entity's list in its order, a folder per range (as many as there are shuffle partitions, or ``ranges``)."""
    order = list_order(entity)
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    full_overwrite_sink_by_range(dealt.withColumn(RANGE, F.spark_partition_id()), f"{path}/rows")
    spark = df.sparkSession
    counts = spark.read.schema(T.StructType([T.StructField(RANGE, T.IntegerType())])).parquet(f"{path}/rows").groupBy(RANGE).agg(F.count(F.lit(1)).alias("n"))
    full_overwrite_sink(counts.coalesce(1), f"{path}/counts")


def full_overwrite_sink_by_range(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(RANGE).parquet(path)


def read_page(spark: SparkSession, path: str, entity: str, schema: T.StructType, limit: int, offset: int) -> DataFrame:
    """The page of a stored list that ``page`` gives of the sorted frame."""
    limit, offset = min(max(limit, MIN_PAGE), MAX_PAGE), max(offset, 0)
    before, wanted, skipped = 0, [], 0
    for row in sorted(spark.read.schema(COUNTS).parquet(f"{path}/counts").collect()):
        if before < offset + limit and before + row["n"] > offset:
            if not wanted:
                skipped = before
            wanted.append(row[RANGE])
        before += row["n"]
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(RANGE, T.IntegerType())])).parquet(f"{path}/rows")
    return rows.filter(F.col(RANGE).isin(wanted)).drop(RANGE).orderBy(*list_order(entity)).offset(offset - skipped if wanted else 0).limit(limit)
