"""Structured Streaming forms of the telemetry and incident operators.

All jobs read a file source, keep their offsets in a checkpoint below the shared folder and write Parquet. With ``availableNow`` a job
works off what is there and stops, so it can be compared with its batch form; with another trigger the same job runs on.

No job holds event time back behind a watermark: files may come in any order, and a backfill must count like live data. Each batch is
reduced by itself (sums, first and last times, first event per key) and appended as one partition per batch id, overwritten
if the batch is repeated after a lost executor. Readers combine the partitions, so a late row changes the result when it comes and none
is dropped, whatever the number of files per batch. ``compact`` replaces old partitions by their combination.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallylake.operators.incidents import combine_reduced, merge_reduced_failures, reduce_failures
from tallylake.operators.telemetry import alerts_of_windows, bucket_edges, combine_edges, event_once, gaps_of_edges, signal_sums, signals, sum_windows
from tallylake.sources.lake import exists


def file_stream(spark: SparkSession, folder: str, name_pattern: str, schema: T.StructType, files_per_batch: int) -> DataFrame:
    """New Parquet files of a folder; a bounded number per batch keeps batches bounded."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name_pattern)
    return reader.option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_available(stream: DataFrame, target: str, output_mode: str = "append") -> None:
    """Write a stream to a Parquet folder until the input is used up."""
    query = (
        stream.writeStream.format("parquet").outputMode(output_mode)
        .option("path", f"{target}/data").option("checkpointLocation", f"{target}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_batches(stream: DataFrame, target: str, write: Callable[[DataFrame, int], None], output_mode: str = "append") -> None:
    """Hand every micro-batch of a stream to ``write`` until the input is used up."""
    query = (
        stream.writeStream.outputMode(output_mode).foreachBatch(write)
        .option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def batch_folder(target: str, batch_id: int) -> str:
    return f"{target}/data/batch_id={batch_id}"


def read_batches(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """All batches written so far, none if there was no input yet. Compacted ones come as one, numbered as their last one."""
    with_id = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    compacted = _read(spark, f"{target}/compacted", T.StructType([T.StructField("upto", T.LongType()), T.StructField("place", T.StringType())]))
    newest = None if compacted is None else compacted.orderBy(F.desc("upto")).first()
    logged = _read(spark, f"{target}/data", with_id)
    rows = spark.createDataFrame([], with_id) if logged is None else logged
    if newest is None:
        return rows
    old = spark.read.schema(schema).parquet(newest["place"]).withColumn("batch_id", F.lit(newest["upto"]))
    return rows.filter(F.col("batch_id") > newest["upto"]).unionByName(old)


def _read(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame | None:
    return spark.read.schema(schema).parquet(folder) if exists(spark, folder) else None


def compact(spark: SparkSession, target: str, schema: T.StructType, combine: Callable[[DataFrame], DataFrame], upto: int) -> None:
    """Write the combination of all batches up to ``upto`` as the new start of the log; later reads begin there.

    ``combine`` has to be the reader's own combination, of rows with ``batch_id``, so the result stays the same. The old partitions are
    left for the store's retention to remove.
    """
    place = f"{target}/compact-{upto}"
    combined = combine(read_batches(spark, target, schema).filter(F.col("batch_id") <= upto))
    combined.select(*schema.fieldNames()).write.mode("overwrite").parquet(place)
    spark.range(1).select(F.lit(upto).cast("long").alias("upto"), F.lit(place).alias("place")).write.mode("append").parquet(f"{target}/compacted")


def _append_batches(target: str, reduce: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        reduce(batch).write.mode("overwrite").parquet(batch_folder(target, batch_id))

    return write


def _reduced_log(stream: DataFrame, target: str, reduce: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Work off a stream, each batch reduced by itself, and read the log of all batches."""
    run_batches(stream, target, _append_batches(target, reduce))
    spark = stream.sparkSession
    return read_batches(spark, target, reduce(spark.createDataFrame([], stream.schema)).schema)


def event_windows(events: DataFrame, target: str, bucket: str = "5 minutes") -> DataFrame:
    """Event counts per tumbling window, tenant and type: partial counts per batch, summed when read."""
    keys = ["window_start", "tenant_id", "event_type"]

    def counts(batch: DataFrame) -> DataFrame:
        return batch.groupBy(F.window("ts", bucket).alias("w"), "tenant_id", "event_type").agg(F.count(F.lit(1)).alias("n_events")).select(
            F.col("w.start").alias("window_start"), "tenant_id", "event_type", "n_events")

    return _reduced_log(events, target, counts).groupBy(*keys).agg(F.sum("n_events").alias("n_events"))


def alerts(events: DataFrame, metrics: DataFrame, target: str) -> DataFrame:
    """Alerts of all rules per pipeline: 5-minute rules over tumbling windows, 10-minute rules over windows that slide by five minutes.

    Batches are reduced to sums per 5-minute window; both window lengths are sums of those.
    """
    return alerts_of_windows(sum_windows(_reduced_log(signals(events, metrics), target, signal_sums)), sliding=True)


def loss_of_signal(events: DataFrame, target: str, minutes: int, as_of: str | None = None) -> DataFrame:
    """Times at which tenants fell silent for longer than ``minutes``, those still silent at ``as_of`` included (None: the newest event).

    Batches are reduced to the first and last event of every bucket of that length, as ``silent_gaps`` does.
    """
    edges = combine_edges(_reduced_log(events, target, lambda batch: bucket_edges(batch, minutes)))
    return gaps_of_edges(edges, minutes, as_of, still_open=True).select("tenant_id", "silent_from")


def events_once(events: DataFrame, target: str, keys: tuple[str, ...] = ("run_id", "event_type")) -> DataFrame:
    """At most one event per key for all time: the earliest by (ts, event_id), whichever batch brings it.

    Each batch keeps its first event per key, readers the first of those; no batch looks at what was recorded before.
    """
    return event_once(_reduced_log(events, target, lambda batch: event_once(batch, keys)).drop("batch_id"), keys)


def increment(rows: DataFrame, target: str) -> DataFrame:
    """Incremental ingestion: the checkpoint remembers which files were read, no watermark file is needed."""
    run_available(rows, target)
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{target}/data")


def incident_upsert(changes: DataFrame, base: DataFrame, payloads: DataFrame, target: str) -> DataFrame:
    """Failure reports merged into the incident table.

    Each batch is reduced to one row per incident and appended to a change log; the current table is base plus log,
    merged when read. No batch ever rewrites the table; ``compact_changes`` keeps the log short.
    """
    log = combine_reduced(_reduced_log(changes, target, reduce_failures), "batch_id")
    return merge_reduced_failures(base, payloads, log)


def compact_changes(changes_schema: T.StructType, spark: SparkSession, target: str, upto: int) -> None:
    """Compact the change log of ``incident_upsert``."""
    schema = reduce_failures(spark.createDataFrame([], changes_schema)).schema
    compact(spark, target, schema, lambda log: combine_reduced(log, "batch_id"), upto)
