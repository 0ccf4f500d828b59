"""Tables that take change sets: hash buckets of the key, of which a change set rewrites only those that it touches.

Every bucket is a folder of the version that wrote it last, and a manifest per version names them (a row per bucket). Readers take the
newest manifest, so they see all of a change set or none of it, and a change set that is tried again writes its version anew. Tables of
one key and the same number of buckets touch the same buckets in one change set.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallylake.sources.lake import exists, full_overwrite_sink

MANIFEST = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("folder", T.StringType())])


@dataclass(frozen=True)
class KeyedTable:
    path: str
    schema: T.StructType
    key: str
    buckets: int = 16
    version: int = -1

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _folders(self, spark: SparkSession) -> dict[int, str]:
        """{bucket: folder} of this version, at most ``buckets``."""
        if self.version < 0:
            return {}
        return {r["bucket"]: r["folder"] for r in spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/version={self.version}").collect()}

    def _read(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        if not folders:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, list(self._folders(spark).values()))

    def _write(self, spark: SparkSession, rows: DataFrame, kept: dict[int, str]) -> KeyedTable:
        """The next version: ``rows``, and the kept buckets as they are."""
        after = replace(self, version=self.version + 1)
        own = f"{self.path}/version={after.version}"
        placed = rows.select(*self.schema.fieldNames()).withColumn("bucket", self._bucket()).hint("rebalance", "bucket")
        placed.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(own)
        new = {b: f"version={after.version}/bucket={b}" for b in range(self.buckets) if b not in kept and exists(spark, f"{own}/bucket={b}")}
        manifest = spark.createDataFrame(sorted({**kept, **new}.items()), MANIFEST)
        full_overwrite_sink(manifest.coalesce(1), f"{self.path}/manifest/version={after.version}")
        return after

    def create(self, rows: DataFrame) -> KeyedTable:
        return self._write(rows.sparkSession, rows, {})

    def touched(self, changes: DataFrame) -> list[int]:
        return sorted(r["bucket"] for r in changes.select(self._bucket().alias("bucket")).distinct().collect())

    def merge(self, changes: DataFrame, apply: Callable[[DataFrame], DataFrame], touched: list[int] | None = None) -> KeyedTable:
        """The next version after a change set: ``apply`` gets the rows of the buckets that ``changes`` touch and returns what they are then."""
        spark = changes.sparkSession
        touched = self.touched(changes) if touched is None else touched
        folders = self._folders(spark)
        rows = apply(self._read(spark, [f for b, f in folders.items() if b in touched]))
        return self._write(spark, rows, {b: f for b, f in folders.items() if b not in touched})

    def part(self, spark: SparkSession, touched: list[int]) -> DataFrame:
        """The rows of some buckets."""
        return self._read(spark, [f for b, f in self._folders(spark).items() if b in touched])


def merge_both(
    first: KeyedTable, second: KeyedTable, changes: DataFrame,
    apply_first: Callable[[DataFrame, DataFrame], DataFrame], apply_second: Callable[[DataFrame, DataFrame], DataFrame],
) -> tuple[KeyedTable, KeyedTable]:
    """Both tables after a change set. The functions get the rows of the touched buckets of both tables as they were before it."""
    if (first.key, first.buckets) != (second.key, second.buckets):
        raise ValueError("tables that are merged together need one key and one number of buckets")
    spark = changes.sparkSession
    touched = first.touched(changes)
    a, b = first.part(spark, touched), second.part(spark, touched)
    return first.merge(changes, lambda _: apply_first(a, b), touched), second.merge(changes, lambda _: apply_second(a, b), touched)
