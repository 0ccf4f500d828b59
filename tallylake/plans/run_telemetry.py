"""What a run tells about itself: an event and a metric table that the telemetry operators read.

Events come in the order of the stages: start and end of the run, of each stage and of each dataset, and what failed on the way.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylake.operators.quality import GOLD_CHECKS
from tallylake.operators.telemetry import MONEY, metrics_from_logs

SERVICE = "tallylake"
STAGES = ("bronze", "silver", "gold")

# fixed values: metric names of the quality counts, as the dashboards and alert rules name them
SILVER_METRICS = {
    "silver_input_records": "input_record_count", "silver_valid_records": "valid_record_count", "silver_invalid_records": "invalid_record_count",
    "silver_duplicate_records": "duplicate_record_count", "silver_quarantine_records": "invalid_record_count",
    "input_record_count": "input_record_count", "valid_record_count": "valid_record_count", "invalid_record_count": "invalid_record_count",
    "duplicate_record_count": "duplicate_record_count", "null_violation_count": "null_violation_count",
    "business_rule_violation_count": "business_rule_violation_count",
    "referential_integrity_failure_count": "referential_integrity_failure_count", "quarantine_record_count": "invalid_record_count",
}


class Clock:
    """Begin and length of a run's stages, as seconds after its stamp."""

    def __init__(self, stamp: str) -> None:
        self.stamp, self.zero, self.end = stamp, time.perf_counter(), None
        self.spans: dict[str, tuple[float, float]] = {}

    def now(self) -> float:
        return time.perf_counter() - self.zero

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        begin = self.now()
        try:
            yield
        finally:
            self.spans[name] = (begin, self.now())

    def stop(self) -> None:
        self.end = self.now()

    def at(self, seconds: float) -> Column:
        return F.lit(self.stamp).cast("timestamp") + F.make_dt_interval(secs=F.lit(round(seconds, 6)))

    def at_end_of(self, stage: Column) -> Column:
        ends = [F.when(stage == name, self.at(span[1])) for name, span in self.spans.items()]
        return F.coalesce(*ends, self.at(self.end))


def _event(rows: DataFrame, ts: Column, event_type: Column, stage: Column, dataset: Column, status: Column, message: Column) -> DataFrame:
    level = F.when(event_type.endswith("_FAILURE"), "ERROR").when(event_type.endswith("_SKIPPED"), "WARN").otherwise("INFO")
    return rows.select(
        "tenant_id", ts.alias("ts"), event_type.alias("event_type"), level.alias("level"), stage.alias("stage"), dataset.alias("dataset"),
        status.alias("status"), message.alias("message"), F.lit(SERVICE).alias("service_name"))


def run_events(records: DataFrame, status: DataFrame, clock: Clock, silver_error: str | None, gold_error: str | None) -> DataFrame:
    """Events of a run from its stage records (tenant_id, stage, dataset, status, reason) and its status row per tenant."""
    tenants, text, pipeline = status.select("tenant_id", "overall_status"), F.lit, F.lit("pipeline")
    parts = [_event(tenants, clock.at(0), text("PIPELINE_START"), pipeline, pipeline, text("RUNNING"), text("Pipeline execution started"))]
    for stage, (begin, _) in clock.spans.items():
        started = records.filter((F.col("stage") == stage) & (F.col("status") != "SKIPPED"))
        parts.append(_event(started.select("tenant_id").distinct(), clock.at(begin), text(f"{stage.upper()}_START"), text(stage), text("all"),
                            text("RUNNING"), text(f"{stage.capitalize()} stage started")))
    reason = F.coalesce("reason", F.lit(""))
    ended = F.when(F.col("status") == "FAILED", "_FAILURE").when(F.col("status") == "SKIPPED", "_SKIPPED").otherwise("_END")
    parts.append(_event(records, clock.at_end_of(F.col("stage")), F.concat(F.upper("stage"), ended), F.col("stage"), F.col("dataset"), F.col("status"), reason))
    broken = {"API_FAILURE": F.col("stage") == "bronze"}
    if silver_error is not None:
        broken["S3_READ_FAILURE"] = F.col("stage") == "silver"
    if gold_error is not None:
        broken["S3_WRITE_FAILURE"] = F.col("stage") == "gold"
    for kind, of_stage in broken.items():
        rows = records.filter(of_stage & (F.col("status") == "FAILED"))
        parts.append(_event(rows, clock.at_end_of(F.col("stage")), text(kind), F.col("stage"), F.col("dataset"), F.col("status"), reason))
    good = F.col("overall_status") == "SUCCESS"
    parts.append(_event(tenants, clock.at(clock.end), F.when(good, "PIPELINE_END").otherwise("PIPELINE_FAILURE"), pipeline, pipeline,
                        F.col("overall_status"), F.when(good, "Pipeline execution completed").otherwise("Pipeline execution failed")))
    return reduce(DataFrame.unionByName, parts).withColumn("event_id", F.xxhash64("tenant_id", "event_type", "stage", "dataset", "ts"))


def run_metrics(
    landed: DataFrame, bronze: DataFrame, quality: DataFrame | None, checks: DataFrame | None, gold: DataFrame | None, status: DataFrame, clock: Clock
) -> DataFrame:
    """(tenant_id, ts, stage, dataset, name, value, service_name) of a run.

    ``landed`` has the outcome of every source per tenant, ``bronze`` and ``gold`` row counts (dataset, tenant_id, n), ``quality`` the quality
    log, ``checks`` the gold checks per tenant.
    """
    def rows(df: DataFrame, stage: str, dataset: Column, values: dict[str, Column]) -> DataFrame:
        wide = df.select("tenant_id", F.lit(stage).alias("stage"), dataset.alias("dataset"), *[v.cast(MONEY).alias(n) for n, v in values.items()])
        return metrics_from_logs(wide, ["tenant_id", "stage", "dataset"], list(values))

    dataset, one, failed = F.col("dataset"), F.lit(1), F.col("status") != "SUCCESS"
    counted = landed.select("dataset", "tenant_id").distinct().join(bronze, ["dataset", "tenant_id"], "left")
    n = F.coalesce("n", F.lit(0))
    parts = [
        rows(counted, "bronze", dataset, {"bronze_records_ingested": n, "bronze_records_written": n}),
        rows(landed, "bronze", dataset, {"api_request_count": one, "api_request_duration_seconds": F.col("duration_seconds"), "s3_write_duration_seconds": F.col("duration_seconds")}),
        rows(landed.filter(failed), "bronze", dataset, {"api_error_count": one}),
    ]
    for stage, (begin, end) in clock.spans.items():
        parts.append(rows(status, stage, F.lit("all"), {f"{stage}_duration_seconds": F.lit(end - begin)}))
    if quality is not None:
        parts.append(rows(quality, "silver", dataset, {name: F.col(count) for name, count in SILVER_METRICS.items()}))
        valid = quality.groupBy("tenant_id").agg(F.sum("valid_record_count").alias("v"))
        parts.append(rows(valid, "gold", F.lit("all"), {"gold_input_records": F.col("v")}))
    if gold is not None:
        parts.append(rows(gold, "gold", dataset, {"gold_output_records": F.col("n")}))
    if checks is not None:
        broken = reduce(Column.__add__, [(F.col(c) > 0).cast("int") for c in GOLD_CHECKS])
        parts.append(rows(checks, "gold", F.lit("pricing"), {"gold_validation_failures": broken}))
    good = F.col("overall_status") == "SUCCESS"
    parts.append(rows(status, "pipeline", F.lit("pipeline"), {"pipeline_run_count": one, "pipeline_duration_seconds": F.lit(clock.end)}))
    parts.append(rows(status.filter(good), "pipeline", F.lit("pipeline"), {"pipeline_success_count": one}))
    parts.append(rows(status.filter(~good), "pipeline", F.lit("pipeline"), {"pipeline_failure_count": one}))
    return reduce(DataFrame.unionByName, parts).withColumns({"ts": clock.at_end_of(F.col("stage")), "service_name": F.lit(SERVICE)})
