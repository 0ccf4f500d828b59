"""Telemetry queries, batch and streaming: inventory rows M and W."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylake.catalog.registry import query
from tallylake.catalog.views_sql import MONEY, lookback, ratio
from tallylake.operators import telemetry as tel
from tallylake.session import shared_dir
from tallylake.sources import views
from tallylake.sources.views import AS_OF, PIPELINE_ID, SERVICE_NAME
from tallylake.streaming import jobs

# the given events are sparse, so lookbacks are days where a busy pipeline would use minutes
DAYS_2, DAYS_10, DAYS_30 = 2 * 1440, 10 * 1440, 30 * 1440
HALF_DAY = 720


def total(*names: str) -> str:
    return ", ".join(f"CAST(coalesce(sum(value) FILTER (name = '{n}'), 0) AS {MONEY}) AS {n}" for n in names)


def among(*names: str) -> str:
    return "name IN (" + ", ".join(f"'{n}'" for n in names) + ")"


def five_minutes(column: str = "ts") -> str:
    return f"time_bucket(INTERVAL 5 MINUTES, {column}, TIMESTAMP '1970-01-01')"


@query("telemetry_arrival", "M1", f"""
    SELECT 'events' AS kind, count(*) AS arrived FROM v_telemetry WHERE {lookback(HALF_DAY)}
    UNION ALL SELECT 'metrics', count(*) FROM v_metrics WHERE {lookback(HALF_DAY)}""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return tel.telemetry_arrival(
        views.telemetry_events(spark, d), views.telemetry_metrics(spark, d), SERVICE_NAME, PIPELINE_ID, AS_OF, HALF_DAY
    )


@query("latest_status_by_run", "M2", f"""
    SELECT run_id, tenant_id, arg_max(status, (ts, event_id)) AS latest_status FROM v_telemetry
    WHERE event_type IN ('PIPELINE_END', 'PIPELINE_FAILURE') AND {lookback(DAYS_30)} GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return tel.latest_status_by_run(views.telemetry_events(spark, d), AS_OF, DAYS_30)


@query("events_by_type", "M3", f"SELECT tenant_id, event_type, count(*) AS n_events FROM v_telemetry WHERE {lookback(DAYS_30)} GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return tel.events_by_type(views.telemetry_events(spark, d), AS_OF, DAYS_30, "tenant_id")


@query("bronze_throughput_ts", "M4", f"""
    SELECT {five_minutes()} AS bucket_start, dataset, tenant_id, {total('bronze_records_written')} FROM v_metrics
    WHERE name = 'bronze_records_written' AND {lookback(DAYS_30)} GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return tel.bronze_throughput_ts(views.telemetry_metrics(spark, d), AS_OF, DAYS_30)


_SILVER = ("silver_input_records", "silver_invalid_records", "silver_quarantine_records")


@query("silver_quality_facets", "M5", f"""
    SELECT dataset, tenant_id, {total(*_SILVER)} FROM v_metrics WHERE {among(*_SILVER)} AND {lookback(DAYS_30)} GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return tel.silver_quality_facets(views.telemetry_metrics(spark, d), AS_OF, DAYS_30)


_GOLD = ("gold_output_records", "gold_validation_failures")


@query("gold_health", "M6", f"SELECT tenant_id, {total(*_GOLD)} FROM v_metrics WHERE {among(*_GOLD)} AND {lookback(DAYS_30)} GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return tel.gold_health(views.telemetry_metrics(spark, d), AS_OF, DAYS_30)


@query("latency_ts", "M7", f"""
    SELECT b AS bucket_start, tenant_id, {ratio('s', 'n')} AS avg_duration FROM (
      SELECT {five_minutes()} AS b, tenant_id, sum(value) AS s, count(value) AS n FROM v_metrics
      WHERE name = 'pipeline_duration_seconds' AND {lookback(DAYS_30)} GROUP BY ALL)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return tel.latency_ts(views.telemetry_metrics(spark, d), AS_OF, DAYS_30)


@query("api_errors", "M8", f"""
    SELECT dataset, tenant_id, coalesce(api_error_count, 0) AS api_error_count, coalesce(n, 0) AS api_failure_events FROM (
      SELECT dataset, tenant_id, {total('api_error_count')} FROM v_metrics WHERE name = 'api_error_count' AND {lookback(DAYS_30)} GROUP BY ALL)
    FULL JOIN (SELECT dataset, tenant_id, count(*) AS n FROM v_telemetry WHERE event_type = 'API_FAILURE' AND {lookback(DAYS_30)} GROUP BY ALL)
    USING (dataset, tenant_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return tel.api_errors(views.telemetry_metrics(spark, d), views.telemetry_events(spark, d), AS_OF, DAYS_30)


@query("failures_by_stage", "M8", f"""
    SELECT stage, dataset, tenant_id, count(*) AS n_failures FROM v_telemetry WHERE event_type = 'BRONZE_FAILURE' AND {lookback(DAYS_30)} GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return tel.failures_by(views.telemetry_events(spark, d), ("BRONZE_FAILURE",), ["stage", "dataset", "tenant_id"], AS_OF, DAYS_30)


_LATEST = "QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) <="


@query("run_drilldown", "M9", f"SELECT * FROM v_telemetry WHERE {lookback(DAYS_30)} {_LATEST} 20")
def _(spark: SparkSession, d: str) -> DataFrame:
    return tel.run_drilldown(views.telemetry_events(spark, d), AS_OF, DAYS_30, 20)


@query("run_timeline", "M9", f"""
    SELECT run_id, event_id, ts, event_type, level, stage, dataset, status, message FROM v_telemetry WHERE {lookback(DAYS_30)} {_LATEST} 500""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return tel.run_timeline(views.telemetry_events(spark, d), AS_OF, DAYS_30)


@query("latest_failing_run", "M10", f"""
    SELECT arg_max(run_id, (ts, event_id)) AS run_id FROM v_telemetry
    WHERE event_type IN ('PIPELINE_FAILURE', 'GOLD_FAILURE', 'SILVER_FAILURE', 'BRONZE_FAILURE') AND {lookback(DAYS_30)}""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return tel.latest_failing_run(views.telemetry_events(spark, d), AS_OF, DAYS_30)


_IMPACT = ("silver_invalid_records", "silver_quarantine_records", "gold_validation_failures")


@query("run_impact", "M11", f"""
    SELECT run_id, tenant_id, dataset, {total(*_IMPACT)} FROM v_metrics WHERE {among(*_IMPACT)} AND {lookback(DAYS_30)} GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return tel.run_impact(views.telemetry_metrics(spark, d), AS_OF, DAYS_30)


@query("records_processed", "M12", f"""
    SELECT {total('bronze_records_written', 'silver_valid_records', 'gold_output_records')} FROM v_metrics WHERE {lookback(DAYS_30)}""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return tel.records_processed(views.telemetry_metrics(spark, d), AS_OF, DAYS_30)


@query("run_overview", "M13", f"""
    SELECT total_runs, success_runs, failed_runs, latest_status, {ratio('s', 'n')} AS avg_duration FROM (
      SELECT count(*) FILTER (event_type = 'PIPELINE_START') AS total_runs, count(*) FILTER (event_type = 'PIPELINE_END' AND status = 'SUCCESS') AS success_runs,
        count(*) FILTER (event_type = 'PIPELINE_FAILURE') AS failed_runs,
        arg_max(status, (ts, event_id)) FILTER (event_type IN ('PIPELINE_END', 'PIPELINE_FAILURE')) AS latest_status
      FROM v_telemetry WHERE {lookback(DAYS_30)}),
      (SELECT sum(value) AS s, count(value) AS n FROM v_metrics WHERE name = 'pipeline_duration_seconds' AND {lookback(DAYS_30)})""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return tel.run_overview(views.telemetry_events(spark, d), views.telemetry_metrics(spark, d), AS_OF, DAYS_30)


def _signals() -> str:
    return f"""SELECT ts, pipeline_id, event_type AS name, CAST(1 AS {MONEY}) AS value FROM v_telemetry
      UNION ALL SELECT ts, pipeline_id, name, value FROM v_metrics"""


def _fired_sql(rule: tel.AlertRule, start: str, rows: str) -> str:
    """Alert rows of one rule; ``start`` is the window start of a row of ``rows``."""
    names = [f"'{n}'" for n in (rule.numerator, rule.denominator) if n]
    base = f"greatest(coalesce(sum(value) FILTER (name = '{rule.denominator}'), 0), 1)" if rule.denominator else "1"
    top = f"coalesce(sum(value) FILTER (name = '{rule.numerator}'), 0)"
    return f"""SELECT pipeline_id, w AS window_start, w + INTERVAL {rule.minutes} MINUTES AS window_end, '{rule.name}' AS alert, '{rule.level}' AS level,
        round(CAST(n AS DOUBLE) / CAST(b AS DOUBLE), 4) AS observed
      FROM (SELECT pipeline_id, {start} AS w, {top} AS n, {base} AS b FROM ({rows}) WHERE name IN ({', '.join(names)}) GROUP BY 1, 2)
      WHERE n > CAST(b AS DECIMAL(38,4)) * CAST({rule.threshold} AS DECIMAL(10,4))"""


@query("alert_conditions", "M14", " UNION ALL ".join(
    _fired_sql(r, f"time_bucket(INTERVAL {r.minutes} MINUTES, ts, TIMESTAMP '1970-01-01')", _signals()) for r in tel.ALERT_RULES))
def _(spark: SparkSession, d: str) -> DataFrame:
    return tel.alert_conditions(views.telemetry_events(spark, d), views.telemetry_metrics(spark, d))


@query("missing_success", "M14", f"""
    SELECT s AS window_start FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '{AS_OF}' - INTERVAL 2 HOURS, INTERVAL 2 HOURS)) AS s)
    WHERE s NOT IN (SELECT time_bucket(INTERVAL 2 HOURS, ts, TIMESTAMP '1970-01-01') FROM v_telemetry WHERE event_type = 'PIPELINE_END' AND status = 'SUCCESS')""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return tel.missing_success(views.telemetry_events(spark, d), "2024-01-01 00:00:00", AS_OF, 2)


@query("duration_anomalies", "M14", f"""
    SELECT b AS window_start, tenant_id, avg_duration FROM (SELECT b, tenant_id, {ratio('s', 'n')} AS avg_duration FROM (
      SELECT date_trunc('day', ts) AS b, tenant_id, sum(value) AS s, count(value) AS n FROM v_metrics WHERE name = 'pipeline_duration_seconds' GROUP BY ALL))
    WHERE avg_duration NOT BETWEEN 30 AND 60""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return tel.duration_anomalies(views.telemetry_metrics(spark, d), "30", "60")


def _sum_text(name: str, extra: str = "true") -> str:
    return f"CAST(CAST(coalesce(sum(value) FILTER (name = '{name}' AND {extra}), 0) AS {MONEY}) AS VARCHAR)"


@query("monitoring_checks", "M15", f"""
    WITH e AS (SELECT count(*) FILTER ({lookback(HALF_DAY)}) AS n, arg_max(status, (ts, event_id)) FILTER (event_type IN ('PIPELINE_END', 'PIPELINE_FAILURE')) AS s
               FROM v_telemetry WHERE {lookback(4 * HALF_DAY)}),
         m AS (SELECT count(*) FILTER ({lookback(HALF_DAY)}) AS n, {_sum_text('gold_validation_failures')} AS g, {_sum_text('api_error_count')} AS a,
                 {_sum_text('silver_invalid_records', "tenant_id = 'tenant_001'")} AS i FROM v_metrics WHERE {lookback(2 * HALF_DAY)})
    SELECT 'logs_arriving' AS "check", CAST(n AS VARCHAR) AS value, CASE WHEN n = 0 THEN 'WARN' ELSE 'OK' END AS state FROM e
    UNION ALL SELECT 'latest_status', coalesce(s, '<no rows>'), CASE WHEN s IS NULL THEN 'WARN' WHEN s = 'FAILED' THEN 'FAIL' ELSE 'OK' END FROM e
    UNION ALL SELECT 'metrics_arriving', CAST(n AS VARCHAR), CASE WHEN n = 0 THEN 'WARN' ELSE 'OK' END FROM m
    UNION ALL SELECT 'gold_validation_failures', g, 'OK' FROM m
    UNION ALL SELECT 'api_errors', a, 'OK' FROM m
    UNION ALL SELECT 'silver_invalid_records', i, 'OK' FROM m""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return tel.monitoring_checks(
        views.telemetry_events(spark, d), views.telemetry_metrics(spark, d), SERVICE_NAME, PIPELINE_ID, "tenant_001", AS_OF, HALF_DAY
    )


_MEASURES = ("input_record_count", "valid_record_count", "invalid_record_count")


@query("metrics_from_logs", "M16", " UNION ALL ".join(
    f"SELECT run_id, tenant_id, dataset, stage, '{m}' AS name, CAST({m} AS {MONEY}) AS value FROM v_quality_logs" for m in _MEASURES))
def _(spark: SparkSession, d: str) -> DataFrame:
    return tel.metrics_from_logs(views.quality_logs(spark, d), ["run_id", "tenant_id", "dataset", "stage"], list(_MEASURES))


@query("event_once", "W4", """
    SELECT * FROM v_telemetry QUALIFY row_number() OVER (PARTITION BY run_id, event_type ORDER BY ts, event_id) = 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return tel.event_once(views.telemetry_events(spark, d))


_GAP = 60

_GAPS = f"""
    SELECT tenant_id, ts AS silent_from, nxt AS silent_until FROM (
      SELECT tenant_id, ts, lead(ts) OVER (PARTITION BY tenant_id ORDER BY ts) AS nxt FROM v_telemetry) WHERE nxt - ts > INTERVAL {_GAP} MINUTES"""


@query("silent_gaps", "W3", _GAPS)
def _(spark: SparkSession, d: str) -> DataFrame:
    return tel.silent_gaps(views.telemetry_events(spark, d), _GAP)


@query("late_rows", "W", """
    SELECT tenant_id, count(*) FILTER (k > 10) AS late_rows, count(*) AS all_rows FROM v_telemetry GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = views.telemetry_events(spark, d).withColumn("arrived_at", F.expr("ts + make_dt_interval(0, 0, k)"))
    return tel.late_rows(rows, "arrived_at")


# --- streams ---------------------------------------------------------------------------------------------------------


FILES_PER_BATCH = 1000


def stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    return jobs.file_stream(spark, d, f"{name}.parquet", views.table(spark, d, name).schema, FILES_PER_BATCH)


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The event table as a stream, with zoned times."""
    return views.with_k(stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))


def telemetry_stream(spark: SparkSession, d: str) -> DataFrame:
    return views.as_telemetry(event_stream(spark, d))


@query("stream_event_windows", "W1", f"""
    SELECT {five_minutes()} AS window_start, tenant_id, event_type, count(*) AS n_events FROM v_telemetry GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return jobs.event_windows(telemetry_stream(spark, d), shared_dir(spark, "stream-windows"))


_SLIDING = f"""SELECT unnest([{five_minutes()} - INTERVAL 5 MINUTES, {five_minutes()}]) AS ts, pipeline_id, name, value FROM ({_signals()})"""
_TUMBLING = f"SELECT {five_minutes()} AS ts, pipeline_id, name, value FROM ({_signals()})"


@query("stream_alerts", "W2", " UNION ALL ".join(_fired_sql(r, "ts", _SLIDING if r.minutes == 10 else _TUMBLING) for r in tel.ALERT_RULES))
def _(spark: SparkSession, d: str) -> DataFrame:
    events = telemetry_stream(spark, d)
    metrics = views.as_metrics(event_stream(spark, d))
    return jobs.alerts(events, metrics, shared_dir(spark, "stream-alerts"))


@query("stream_loss_of_signal", "W3", f"""
    SELECT tenant_id, silent_from FROM (
      SELECT tenant_id, ts AS silent_from, lead(ts) OVER (PARTITION BY tenant_id ORDER BY ts) AS nxt, max(ts) OVER () AS newest FROM v_telemetry)
    WHERE coalesce(nxt, newest) - silent_from > INTERVAL {_GAP} MINUTES""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return jobs.loss_of_signal(telemetry_stream(spark, d), shared_dir(spark, "stream-silence"), _GAP)


@query("stream_event_once", "W4", """
    SELECT * FROM v_telemetry QUALIFY row_number() OVER (PARTITION BY run_id, event_type ORDER BY ts, event_id) = 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return jobs.events_once(telemetry_stream(spark, d), shared_dir(spark, "stream-once"))


@query("stream_increment", "W5", "SELECT * FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    return jobs.increment(stream(spark, d, "orders"), shared_dir(spark, "stream-increment"))
