"""The bronze -> silver -> gold run over all tenants at once.

Every stage ends in a written table and the next one reads it back, so lineage stays short and a lost executor costs one
stage at most. The driver sees statuses and counts only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallylake.operators.cleanse import LOST, explode_order_items, orders_without_items
from tallylake.operators.enrich import sales_by_product
from tallylake.operators.quality import (
    failing,
    gold_checks,
    gold_failures,
    invalid_rate_gate,
    orphan_counts,
    publish_gate,
    quality_failures,
    quality_metrics,
    stage_rollup,
    without_tenants,
)
from tallylake.plans.gold import gold_pricing, gold_product_sales
from tallylake.plans.run_telemetry import Clock, run_events, run_metrics
from tallylake.plans.silver import silver_cast
from tallylake.plans.snapshots import Snapshots
from tallylake.session import release
from tallylake.sources.lake import (
    ALL_TENANTS,
    SourceName,
    bronze_metadata,
    full_overwrite_sink,
    ingest_all,
    lake_table,
    log_record_sink,
    log_records,
    partition_overwrite_sink,
    side_by_side,
)
from tallylake.specs import FOREIGN_KEYS, INVALID_RATE_LIMIT, spec

# sales_items comes out of the nested sales, so it is no bronze table
SILVER_DATASETS = (
    "products", "sales", "sales_items", "inventory", "promotions", "promotion_products", "suppliers", "customers", "stores", "categories",
)
# those of a lane are brought up one after the other, lanes side by side: what the largest have shuffled is never on disk together
SILVER_LANES = (
    ("sales_items", "sales", "promotion_products"), ("inventory", "promotions"), ("products", "suppliers", "categories"), ("customers", "stores"),
)
BRONZE_DATASETS = tuple(d for d in SILVER_DATASETS if d != "sales_items")


@dataclass(frozen=True)
class Run:
    root: str
    pipeline_id: str
    run_id: str
    stamp: str
    business_date: str
    tenant_id: str | None = None
    invalid_rate_limit: float = INVALID_RATE_LIMIT
    rebalance: bool = True
    buckets: int = 8  # parts of a silver table per tenant, of some hundred MB each; a change rewrites the table

    def path(self, layer: str, dataset: str) -> str:
        return f"{self.root}/{layer}/{dataset}"

    @property
    def one_tenant(self) -> str | None:
        return None if self.tenant_id in (None, ALL_TENANTS) else self.tenant_id

    def work(self, name: str) -> str:
        return f"{self.root}/work/{self.run_id}/{name}"


def run_bronze(spark: SparkSession, run: Run, sources: dict[SourceName, tuple[str, Callable[[], DataFrame]]]) -> DataFrame:
    """Land every source; partitioned by run too, so a second run of a day adds to the first instead of replacing it.

    A source may be of all tenants or, named (dataset, tenant), of one. A run for one tenant lands that tenant's records only; records of
    a known tenant are stamped with its name.
    """
    systems = {name: system for name, (system, _) in sources.items()}

    def write(name: SourceName, df: DataFrame) -> None:
        dataset, tenant = (name, run.one_tenant) if isinstance(name, str) else name
        if tenant and "tenant_id" in df.columns:
            df = df.filter(F.col("tenant_id").isNull() | (F.col("tenant_id") == tenant))
        tagged = bronze_metadata(df, run.pipeline_id, run.run_id, systems[name], run.stamp, tenant)
        tagged = tagged.withColumn("run", F.lit(run.run_id))
        partition_overwrite_sink(tagged, run.path("bronze", dataset), ("tenant_id", "ingestion_date", "run"), codec="zstd")

    return ingest_all(spark, sources, write)


def bronze_schema(dataset: str) -> T.StructType:
    """What a bronze table without any rows looks like."""
    fields = list(spec(dataset).schema)
    if dataset == "sales":
        fields.append(T.StructField("items", T.ArrayType(spec("sales_items").schema)))
    return T.StructType(fields + [T.StructField(c, T.StringType()) for c in ("ingestion_date", "run") if c not in spec(dataset).schema.fieldNames()])


def bronze_rows(spark: SparkSession, run: Run, dataset: str, after: str | None = None) -> DataFrame:
    """What was landed for a dataset by the runs after ``after``, or by all; the run is a partition, so older ones are not opened.

    A column has to come in one type from all sources of a dataset.
    """
    name = "sales" if dataset == "sales_items" else dataset
    rows = lake_table(spark, run.path("bronze", name), bronze_schema(name))
    rows = rows if after is None else rows.filter(F.col("run") > after)
    if dataset == "sales_items":
        return explode_order_items(rows)
    return orders_without_items(rows) if dataset == "sales" else rows


def snapshots(run: Run, dataset: str) -> Snapshots:
    return Snapshots(run.path("silver", dataset), spec(dataset), run.buckets)


def silver_written(spark: SparkSession, run: Run, dataset: str) -> DataFrame:
    """The silver table as of this run: good and quarantined rows side by side."""
    rows = snapshots(run, dataset).read(spark, run.run_id).drop(LOST)
    rows = rows.filter(F.col("tenant_id") == run.one_tenant) if run.one_tenant else rows
    return rows.withColumns({
        "validation_timestamp": F.when(F.col("quality") == "quarantined", F.lit(run.stamp)), "processing_date": F.lit(run.business_date)})


def silver_table(spark: SparkSession, run: Run, dataset: str, quality: str = "valid") -> DataFrame:
    """Valid (or quarantined) rows of the silver table as of this run."""
    rows = silver_written(spark, run, dataset).filter(F.col("quality") == quality)
    return rows.drop("quality", "source_copies", *(["validation_error", "validation_timestamp"] if quality == "valid" else []))


def run_silver(spark: SparkSession, run: Run, tenants: DataFrame) -> DataFrame:
    """Bring every dataset's snapshot up to this run, then measure what stands there.

    Only what was landed since the last snapshot is typed, and only the parts of the snapshot that it touches are ranked, checked and
    written (``snapshots.py``); good and quarantined rows are written side by side. Rows know how many source rows they stand for, so
    measuring reads the snapshot only.
    """
    def bring_up(lane: tuple[str, ...]) -> None:
        for name in lane:
            snapshots(run, name).write(
                spark, run.run_id, lambda after, name=name: silver_cast(bronze_rows(spark, run, name, after), name), run.rebalance)
            release(spark)

    side_by_side(spark, bring_up, list(SILVER_LANES))
    written = cache(lambda name: silver_written(spark, run, name))
    return reduce(DataFrame.unionByName, [_measure(name, written, tenants) for name in SILVER_DATASETS])


def _measure(name: str, written: Callable[[str], DataFrame], tenants: DataFrame) -> DataFrame:
    checked = written(name).select(
        "tenant_id", "source_copies", *[c for c, _, _ in FOREIGN_KEYS.get(name, ())],
        F.when(F.col("quality") == "valid", F.array().cast("array<string>")).otherwise(F.split("validation_error", "; ")).alias("validation_errors"),
    )
    orphans = None
    if name in FOREIGN_KEYS:
        parents = {p: written(p).filter("quality = 'valid'") for _, p, _ in FOREIGN_KEYS[name]}
        orphans = orphan_counts(checked.filter(F.size("validation_errors") == 0), spec(name), parents)
    return quality_metrics(checked, spec(name), orphans, tenants)


def run_gold(spark: SparkSession, run: Run, failed_tenants: DataFrame) -> DataFrame:
    """Build both gold tables for the tenants that passed silver and publish those that pass the gold checks.

    Returns the failure counts per tenant, written once. Unchecked rows only ever exist in the run's work folder.
    """
    silver = cache(lambda name: without_tenants(silver_table(spark, run, name), failed_tenants))
    totals = stored(spark, sales_by_product(silver("sales_items"), silver("sales")), run.work("totals"))
    release(spark)
    stamp = (run.pipeline_id, run.run_id, run.stamp)
    pricing = gold_pricing(
        silver("products"), silver("promotion_products"), silver("promotions"), silver("inventory"), totals, run.business_date, *stamp
    )
    staged = stored(spark, pricing, run.work("pricing"))
    release(spark)
    checks = stored(spark, gold_checks(staged, "tenant_id"), run.work("gold_checks"))
    failed = stored(spark, failing(checks).select("tenant_id"), run.work("gold_failed"))
    sales = gold_product_sales(silver("products"), silver("inventory"), totals, *stamp)
    for name, table in (("pricing", staged), ("product_sales", sales)):
        dated = publish_gate(table, failed).withColumn("business_date", F.lit(run.business_date))
        partition_overwrite_sink(dated, run.path("gold", name), ("tenant_id", "business_date"), run.rebalance)
        release(spark)
    return checks


def stored(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """The same rows read back from a written table, whose size Spark then knows."""
    full_overwrite_sink(rows, path)
    return spark.read.schema(rows.schema).parquet(path)


def _tried(stage: Callable[[], DataFrame]) -> tuple[DataFrame | None, str | None]:
    """The result of a stage, or the first line of what stopped it."""
    try:
        return stage(), None
    except Exception as error:  # noqa: BLE001 - becomes a FAILED status record
        return None, str(error).split("\n")[0]


def _tenants(spark: SparkSession, run: Run) -> DataFrame:
    """Every tenant with bronze data of any dataset; the tenant of a one-tenant run in any case."""
    names = [lake_table(spark, run.path("bronze", n), bronze_schema(n)).select("tenant_id") for n in BRONZE_DATASETS]
    known = reduce(DataFrame.unionByName, names)
    if run.one_tenant:
        known = spark.range(1).select(F.lit(run.one_tenant).alias("tenant_id"))
    return stored(spark, known.filter(F.col("tenant_id").isNotNull()).distinct(), run.work("tenants"))


def run_all(spark: SparkSession, run: Run, sources: dict[SourceName, tuple[str, Callable[[], DataFrame]]]) -> DataFrame:
    """The whole run; returns stage statuses and the overall status per tenant and writes them, with all metrics, as logs.

    A stage that fails becomes FAILED records with its reason, and the status is written all the same. A source of one tenant that
    fails stops that tenant only, one of all tenants stops all; gold is SKIPPED for tenants that bronze or silver stopped. Beside the
    quality and status logs the run writes its own telemetry (``run_telemetry.py``).
    """
    logs, clock = f"{run.root}/logs", Clock(run.stamp)
    with clock.stage("bronze"):
        ingested = stored(spark, run_bronze(spark, run, sources), run.work("ingested"))
        release(spark)
        tenants = _tenants(spark, run)
        # a few rows per source
        landed = stored(spark, tenants.crossJoin(ingested.withColumnRenamed("tenant_id", "_source_tenant")).filter(
            "_source_tenant IS NULL OR _source_tenant = tenant_id").drop("_source_tenant"), run.work("landed"))
    statuses = [landed.select("tenant_id", F.lit("bronze").alias("stage"), "dataset", "status", F.col("error_message").alias("reason"))]
    no_bronze = stored(spark, landed.filter("status <> 'SUCCESS'").select("tenant_id").distinct(), run.work("bronze_failed"))
    going = stored(spark, without_tenants(tenants, no_bronze), run.work("going"))

    def all_of(which: DataFrame, stage: str, status: str, reason: str | None) -> DataFrame:
        return which.select("tenant_id", F.lit(stage).alias("stage"), F.lit("all").alias("dataset"), F.lit(status).alias("status"),
                            F.lit(reason).cast("string").alias("reason"))

    statuses += [all_of(no_bronze, stage, "SKIPPED", "bronze failed") for stage in ("silver", "gold")]
    metrics, checks, silver_error, gold_error = None, None, None, None
    if not going.isEmpty():
        with clock.stage("silver"):
            metrics, silver_error = _tried(lambda: stored(spark, run_silver(spark, run, tenants), run.work("quality")))
        release(spark)
        if metrics is None:
            statuses += [all_of(going, "silver", "FAILED", silver_error), all_of(going, "gold", "SKIPPED", "silver failed")]
        else:
            log_record_sink(metrics.withColumns({"run_id": F.lit(run.run_id), "pipeline_id": F.lit(run.pipeline_id)}), logs, "quality")
            gate = without_tenants(invalid_rate_gate(metrics, run.invalid_rate_limit), no_bronze)
            statuses.append(gate.select("tenant_id", F.lit("silver").alias("stage"), "dataset", "status", quality_failures(gate).alias("reason")))
            failed = stored(spark, gate.filter("breached").select("tenant_id").distinct(), run.work("silver_failed"))
            stopped = stored(spark, failed.unionByName(no_bronze).distinct(), run.work("stopped"))
            with clock.stage("gold"):
                checks, gold_error = _tried(lambda: run_gold(spark, run, stopped))
            passed = without_tenants(tenants, stopped)
            skipped = failed.select("tenant_id", F.lit("SKIPPED").alias("status"), F.lit("silver failed").alias("reason"))
            if checks is None:
                judged = passed.select("tenant_id", F.lit("FAILED").alias("status"), F.lit(gold_error).alias("reason"))
            else:
                reasons = failing(checks).select("tenant_id", F.array_join(gold_failures(), "; ").alias("reason"))
                judged = passed.join(reasons, "tenant_id", "left").select(
                    "tenant_id", F.when(F.col("reason").isNull(), "SUCCESS").otherwise("FAILED").alias("status"), "reason")
            statuses.append(judged.unionByName(skipped).select("tenant_id", F.lit("gold").alias("stage"), F.lit("all").alias("dataset"), "status", "reason"))

    records = stored(spark, reduce(DataFrame.unionByName, statuses).withColumn("run_id", F.lit(run.run_id)), run.work("statuses"))
    reasons = records.filter("reason IS NOT NULL AND status = 'FAILED'").groupBy("run_id", "tenant_id").agg(*[
        F.sort_array(F.collect_set(F.when(F.col("stage") == s, F.col("reason")))).alias(f"{s}_failures") for s in ("bronze", "silver", "gold")
    ])  # a few per dataset
    empty = F.array().cast("array<string>")
    status = stored(spark, stage_rollup(records).join(reasons, ["run_id", "tenant_id"], "left").withColumns({
        **{f"{s}_failures": F.coalesce(f"{s}_failures", empty) for s in ("bronze", "silver", "gold")},
        "pipeline_id": F.lit(run.pipeline_id), "written_at": F.lit(run.stamp)}), run.work("status"))
    log_record_sink(status, logs, "status")
    clock.stop()
    bronze = [bronze_rows_by_tenant(spark, run, n) for n in BRONZE_DATASETS]
    gold = [gold_rows_by_tenant(spark, run, n) for n in ("pricing", "product_sales")] if checks is not None else []
    tags = {"pipeline_id": F.lit(run.pipeline_id), "run_id": F.lit(run.run_id)}
    events = run_events(records, status, clock, silver_error, gold_error).withColumns(tags)
    measured = run_metrics(landed, reduce(DataFrame.unionByName, bronze), metrics, checks, reduce(DataFrame.unionByName, gold) if gold else None, status, clock)
    partition_overwrite_sink(events, f"{run.root}/telemetry/events", ("run_id", "tenant_id"))
    partition_overwrite_sink(measured.withColumns(tags), f"{run.root}/telemetry/metrics", ("run_id", "tenant_id"))
    # the tenants' columns are declared, so text stays text
    return log_records(spark, logs, "status", status.schema).filter(F.col("run_id") == run.run_id)


def bronze_rows_by_tenant(spark: SparkSession, run: Run, dataset: str) -> DataFrame:
    """(dataset, tenant_id, n) of what this run landed; of its files only the row counts are read."""
    rows = lake_table(spark, run.path("bronze", dataset), bronze_schema(dataset)).filter(F.col("run") == run.run_id)
    return rows.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(dataset).alias("dataset"), "tenant_id", "n")


def gold_rows_by_tenant(spark: SparkSession, run: Run, table: str) -> DataFrame:
    """(dataset, tenant_id, n) of what this run published."""
    none = T.StructType([T.StructField(c, T.StringType()) for c in ("tenant_id", "business_date", "run_id")])
    rows = lake_table(spark, run.path("gold", table), none).filter((F.col("business_date") == run.business_date) & (F.col("run_id") == run.run_id))
    return rows.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(table).alias("dataset"), "tenant_id", "n")
