"""Streams over several files and restarts give what the batch form gives."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallylake.operators import incidents as inc
from tallylake.operators import telemetry as tel
from tallylake.session import shared_dir
from tallylake.sources import views
from tallylake.streaming import jobs


def split_events(spark, sf, tmp_path, files_per_batch=1, parts=5):
    """The event table as several files that arrive newest first, each with rows of all times, plus a function that opens it as a stream."""
    events = views.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = str(tmp_path / "in")
    for part in reversed(range(parts)):
        late = F.when(F.col("event_id") % 7 == 0, F.col("event_id") % parts).otherwise(F.floor((F.dayofmonth("ts") - 1) / F.lit(7)))
        events.filter(late == part).coalesce(1).write.mode("append").parquet(folder)

    def stream():
        return views.with_k(jobs.file_stream(spark, folder, "*.parquet", events.schema, files_per_batch))

    return views.with_k(events), stream


PER_BATCH = pytest.mark.parametrize("files_per_batch", [1, 2, 1000])


def same(a, b):
    columns = sorted(a.columns)
    assert sorted(b.columns) == columns
    assert a.select(columns).exceptAll(b.select(columns)).count() == 0
    assert b.select(columns).exceptAll(a.select(columns)).count() == 0


@PER_BATCH
def test_windows(spark, sf, tmp_path, files_per_batch):
    events, stream = split_events(spark, sf, tmp_path, files_per_batch)
    batch = views.as_telemetry(events).groupBy(F.window("ts", "1 day").alias("w"), "tenant_id", "event_type").agg(F.count(F.lit(1)).alias("n_events"))
    batch = batch.select(F.col("w.start").alias("window_start"), "tenant_id", "event_type", "n_events")
    same(jobs.event_windows(views.as_telemetry(stream()), shared_dir(spark, "t"), "1 day"), batch)


@PER_BATCH
def test_once_over_batches(spark, sf, tmp_path, files_per_batch):
    events, stream = split_events(spark, sf, tmp_path, files_per_batch)
    keys = ("run_id", "event_type")
    same(jobs.events_once(views.as_telemetry(stream()), shared_dir(spark, "t"), keys), tel.event_once(views.as_telemetry(events), keys))


@PER_BATCH
def test_alerts(spark, sf, tmp_path, files_per_batch):
    events, stream = split_events(spark, sf, tmp_path, files_per_batch)
    got = jobs.alerts(views.as_telemetry(stream()), views.as_metrics(stream()), shared_dir(spark, "t"))
    sums = tel.signal_sums(tel.signals(views.as_telemetry(events), views.as_metrics(events)))
    same(got, tel.alerts_of_windows(sums, sliding=True))
    assert {r.alert for r in got.select("alert").distinct().collect()} >= {"pipeline_failure"}


@PER_BATCH
def test_silence(spark, sf, tmp_path, files_per_batch):
    events, stream = split_events(spark, sf, tmp_path, files_per_batch)
    telemetry = views.as_telemetry(events)
    as_of = "2030-01-01 00:00:00"
    got = jobs.loss_of_signal(views.as_telemetry(stream()), shared_dir(spark, "t"), 240, as_of)
    gaps = tel.silent_gaps(telemetry, 240).select("tenant_id", "silent_from")
    still = telemetry.groupBy("tenant_id").agg(F.max("ts").alias("silent_from"))
    assert gaps.count() > 0
    same(got, gaps.union(still))


def test_alerts_of_one_pipeline_are_not_hidden_by_another(spark):
    events = spark.createDataFrame([], "ts timestamp, pipeline_id string, event_type string")
    metrics = spark.sql("""SELECT TIMESTAMP'2026-01-01 00:01:00' AS ts, p AS pipeline_id, name, CAST(v AS DECIMAL(18,4)) AS value FROM VALUES
        ('small', 'silver_invalid_records', 5), ('small', 'silver_input_records', 10),
        ('big', 'silver_invalid_records', 1), ('big', 'silver_input_records', 100000) AS t(p, name, v)""")
    assert {(r.pipeline_id, r.alert) for r in tel.alert_conditions(events, metrics).collect()} == {("small", "silver_invalid_ratio")}


def test_compacted_log_gives_the_same_table(spark, sf, tmp_path):
    events, stream = split_events(spark, sf, tmp_path)
    base, payloads = views.incidents(spark, sf).drop("recovery_confirmed"), views.incident_payloads(spark, sf)
    base = base.withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "updated_at")})
    target = shared_dir(spark, "t")
    before = jobs.incident_upsert(views.as_changes(stream()), base, payloads, target).collect()
    for upto in (1, 3):
        jobs.compact_changes(views.as_changes(events).schema, spark, target, upto)
    after = jobs.incident_upsert(views.as_changes(stream()), base, payloads, target).collect()
    assert sorted(map(str, before)) == sorted(map(str, after))


def test_upsert(spark, sf, tmp_path):
    events, stream = split_events(spark, sf, tmp_path)
    base, payloads = views.incidents(spark, sf).drop("recovery_confirmed"), views.incident_payloads(spark, sf)
    base = base.withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "updated_at")})
    got = jobs.incident_upsert(views.as_changes(stream()), base, payloads, shared_dir(spark, "t"))
    same(got, inc.upsert_failures(base, payloads, views.as_changes(events)))


def test_increment_resumes_from_its_checkpoint(spark, tmp_path):
    folder, target = str(tmp_path / "in"), shared_dir(spark, "t")
    rows = spark.range(5).select("id", F.lit("a").alias("v"))
    rows.write.parquet(folder)
    stream = lambda: jobs.file_stream(spark, folder, "*.parquet", rows.schema, 10)
    assert jobs.increment(stream(), target).count() == 5
    assert jobs.increment(stream(), target).count() == 5
    rows.write.mode("append").parquet(folder)
    assert jobs.increment(stream(), target).count() == 10


def test_late_rows(spark):
    df = spark.sql("""SELECT 't' AS tenant_id, TIMESTAMP'2026-01-01 00:00:00' AS ts, TIMESTAMP'2026-01-01 00:10:00' AS at
                      UNION ALL SELECT 't', TIMESTAMP'2026-01-01 00:00:00', TIMESTAMP'2026-01-01 00:10:01'""")
    assert tel.late_rows(df, "at").first().asDict() == {"tenant_id": "t", "late_rows": 1, "all_rows": 2}


def test_alert_thresholds_are_strict(spark):
    events = spark.createDataFrame([], "ts timestamp, pipeline_id string, event_type string")
    metrics = spark.sql("""SELECT TIMESTAMP'2026-01-01 00:01:00' AS ts, 'p' AS pipeline_id, 'silver_invalid_records' AS name, CAST(10 AS DECIMAL(18,4)) AS value
                           UNION ALL SELECT TIMESTAMP'2026-01-01 00:06:00', 'p', 'silver_input_records', 100
                           UNION ALL SELECT TIMESTAMP'2026-01-01 00:12:00', 'p', 'silver_invalid_records', 11""")
    got = {(r.alert, r.window_start.minute, r.observed) for r in tel.alert_conditions(events, metrics).collect()}
    assert got == {("silver_invalid_ratio", 10, 11.0), ("silver_invalid_absolute", 10, 11.0)}


def test_monitoring_without_data_warns(spark):
    events = spark.createDataFrame([], "ts timestamp, event_id bigint, pipeline_id string, service_name string, event_type string, status string")
    metrics = spark.createDataFrame([], "ts timestamp, pipeline_id string, tenant_id string, name string, value decimal(18,4)")
    rows = {r.check: (r.value, r.state) for r in tel.monitoring_checks(events, metrics, "s", "p", "t", "2026-01-01").collect()}
    assert rows["logs_arriving"] == ("0", "WARN") and rows["metrics_arriving"] == ("0", "WARN")
    assert rows["latest_status"] == ("<no rows>", "WARN") and rows["api_errors"] == ("0.0000", "OK")
