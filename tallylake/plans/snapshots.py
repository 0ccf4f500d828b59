"""Silver tables as versioned snapshots that a run extends by what was landed since the last one.

A table is cut into parts, one per tenant and hash bucket of the business key. A version holds the parts that its run rewrote; its
manifest names, for every part, the folder of the version that wrote it last; a head row marks the version as complete. A run reads

* the bronze partitions of runs after the last snapshot (partition filter on ``run``), and
* of the snapshot only the parts that hold a key of those rows,

ranks both together and writes these parts anew. Ranking picks the largest row by a total order and adds up how many source rows it
stands for, so ranking the winner of the old rows against the new ones equals ranking them all. All other parts stay where they are.

A version is rebuilt from all bronze where there is no snapshot before it, where a later run has one already (an old run is
retried), or where the number of buckets was changed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallylake.operators.cleanse import LOST, latest_of_weighted
from tallylake.operators.quality import validation_errors
from tallylake.sources.lake import full_overwrite_sink, lake_table
from tallylake.specs import TRACE_COLUMNS, DatasetSpec

COPIES = "source_copies"
HEAD = T.StructType([T.StructField("buckets", T.IntegerType()), T.StructField("run", T.StringType())])
UNIT = T.StructType([T.StructField("tenant_id", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("folder", T.StringType())])


def snapshot_schema(spec: DatasetSpec) -> T.StructType:
    """Columns of a stored row: all of the dataset, its trace, what the row stands for, and the verdict on it."""
    text = [T.StructField(c, T.StringType()) for c in TRACE_COLUMNS]
    own = [T.StructField(LOST, T.ArrayType(T.StringType())), T.StructField(COPIES, T.LongType()),
           T.StructField("quality", T.StringType()), T.StructField("validation_error", T.StringType())]
    return T.StructType([*spec.schema.fields, *text, *own])


@dataclass(frozen=True)
class Snapshots:
    """The versions of one silver table below ``path``."""

    path: str
    spec: DatasetSpec
    buckets: int

    def _version(self, run_id: str) -> str:
        return f"{self.path}/version={run_id}"

    def _manifest(self, spark: SparkSession, run_id: str) -> DataFrame:
        return spark.read.schema(UNIT).parquet(f"{self.path}/manifest/run={run_id}")

    def heads(self, spark: SparkSession) -> list[tuple[str, int]]:
        """(run, buckets) of all complete versions, oldest first: a row per run."""
        rows = lake_table(spark, f"{self.path}/heads", HEAD)
        return sorted((r["run"], r["buckets"]) for r in rows.collect())

    def base(self, spark: SparkSession, run_id: str) -> str | None:
        """The version that ``run_id`` may extend, None if it has to be rebuilt."""
        others = [(run, n) for run, n in self.heads(spark) if run != run_id]
        if not others or others[-1][0] > run_id or others[-1][1] != self.buckets:
            return None
        return others[-1][0]

    def _read(self, spark: SparkSession, units: DataFrame) -> DataFrame:
        """The rows of some parts, by the folders that a manifest names (a name per part reaches the driver, no row)."""
        folders = [f"{self.path}/{r['folder']}" for r in units.select("folder").collect()]
        fields = [*snapshot_schema(self.spec).fields, T.StructField("bucket", T.IntegerType()), T.StructField("version", T.StringType())]
        if not folders:
            return spark.createDataFrame([], T.StructType(fields)).drop("version")
        return spark.read.schema(T.StructType(fields)).option("basePath", self.path).parquet(*folders).drop("version")

    def read(self, spark: SparkSession, run_id: str) -> DataFrame:
        """All rows of a version, none if there is no such one."""
        return self._read(spark, lake_table(spark, f"{self.path}/manifest/run={run_id}", UNIT)).drop("bucket")

    def unit(self) -> list:
        return ["tenant_id", F.pmod(F.xxhash64(*self.spec.keys), F.lit(self.buckets)).cast("int").alias("bucket")]

    def merged(self, spark: SparkSession, base: str | None, landed: Callable[[str | None], DataFrame], dealt: bool = False) -> DataFrame:
        """The rows of all parts that a run has to write. ``landed(base)`` gives typed bronze rows of the runs after ``base``, or of all.

        With ``dealt`` they are shuffled once, for ranking and for writing: by pieces of their part, whose ``bucket`` they keep. A task then
        holds rows of the few parts that its pieces belong to.
        """
        new = landed(base)
        stored = snapshot_schema(self.spec)
        filled = new.select(*[
            F.col(f.name).cast(f.dataType).alias(f.name) if f.name in new.columns else F.lit(1 if f.name == COPIES else None).cast(f.dataType).alias(f.name)
            for f in stored if f.name not in ("quality", "validation_error")])
        rows = filled
        if base is not None:
            touched = filled.select(*self.unit()).distinct().select(F.col("tenant_id").alias("_tenant"), F.col("bucket").alias("_bucket"))
            units = self._manifest(spark, base).join(
                touched, F.col("tenant_id").eqNullSafe(F.col("_tenant")) & (F.col("bucket") == F.col("_bucket")), "left_semi")
            rows = filled.unionByName(self._read(spark, units).select(*filled.columns))
        if not dealt:
            return latest_of_weighted(rows, self.spec, COPIES)
        # of each tenant twice as many pieces as there are tasks, so that tasks are even and yet write few files
        pieces = max(1, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        piece = F.pmod(F.shiftright(F.xxhash64(*self.spec.keys), 32), F.lit(pieces)).cast("int")
        placed = rows.withColumns({"bucket": self.unit()[1], "_piece": piece}).repartition("tenant_id", "bucket", "_piece")
        return latest_of_weighted(placed, self.spec, COPIES, ("bucket", "_piece")).drop("_piece")

    def write(self, spark: SparkSession, run_id: str, landed: Callable[[str | None], DataFrame], rebalance: bool = True) -> None:
        """Write the version of a run, then its manifest, then its head. A repeated run replaces all three."""
        base = self.base(spark, run_id)
        rows = self.merged(spark, base, landed, rebalance)
        lost = rows.select("*", F.col(LOST).alias("_lost"))
        checked = validation_errors(lost, self.spec).withColumnRenamed("_lost", LOST)
        bad = F.size("validation_errors") > 0
        checked = checked.withColumns({
            "quality": F.when(bad, "quarantined").otherwise("valid"),
            "validation_error": F.when(bad, F.array_join("validation_errors", "; "))})
        out = checked.select(*snapshot_schema(self.spec).fieldNames(), "bucket" if rebalance else self.unit()[1])
        out.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("tenant_id", "bucket").parquet(self._version(run_id), compression="zstd")
        written = lake_table(spark, self._version(run_id), T.StructType([f for f in UNIT if f.name != "folder"]))
        name = F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))  # as it stands on the store, partition values escaped
        own = written.select("tenant_id", F.col("bucket").cast("int").alias("bucket"),
                             F.regexp_extract(name, r".*/(version=[^/]*/tenant_id=[^/]*/bucket=[^/]*)/[^/]*$", 1).alias("folder")).distinct()
        if base is not None:
            mine = own.select(F.col("tenant_id").alias("_tenant"), F.col("bucket").alias("_bucket"))
            same = F.col("tenant_id").eqNullSafe(F.col("_tenant")) & (F.col("bucket") == F.col("_bucket"))
            own = own.unionByName(self._manifest(spark, base).join(mine, same, "left_anti"))
        full_overwrite_sink(own.coalesce(1), f"{self.path}/manifest/run={run_id}")  # a row per part
        full_overwrite_sink(spark.range(0, 1, 1, 1).select(F.lit(self.buckets).alias("buckets")), f"{self.path}/heads/run={run_id}")

