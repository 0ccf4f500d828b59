"""Run telemetry: an event table (ts, run_id, tenant_id, event_type, status, ...) and a long metric table (ts, name, value, ...).

"Last N minutes" is always relative to an explicit as-of time, so a result can be repeated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallylake.functions.pricing import money_ratio
from tallylake.operators.cleanse import first_per_key

# --- fixed values: event types and alert thresholds ------------------------------------------------------------------

RUN_END_TYPES = ("PIPELINE_END", "PIPELINE_FAILURE")
STAGE_FAILURE_TYPES = ("PIPELINE_FAILURE", "GOLD_FAILURE", "SILVER_FAILURE", "BRONZE_FAILURE")
STORAGE_FAILURE_TYPES = ("S3_READ_FAILURE", "S3_WRITE_FAILURE")
DRILLDOWN_LIMIT = 200
TIMELINE_LIMIT = 500
TIMELINE_COLUMNS = ("ts", "event_type", "level", "stage", "dataset", "status", "message")


@dataclass(frozen=True)
class AlertRule:
    """Fires when sum(numerator) / max(sum(denominator), 1) over the window exceeds the threshold."""

    name: str
    level: str
    minutes: int
    numerator: str
    threshold: str
    denominator: str | None = None


ALERT_RULES = (
    AlertRule("pipeline_failure", "critical", 5, "PIPELINE_FAILURE", "0"),
    AlertRule("gold_validation_failures", "critical", 5, "gold_validation_failures", "0"),
    AlertRule("api_errors", "warning", 10, "api_error_count", "0"),
    AlertRule("silver_invalid_ratio", "critical", 10, "silver_invalid_records", "0.10", "silver_input_records"),
    AlertRule("silver_invalid_absolute", "warning", 10, "silver_invalid_records", "10"),
    AlertRule("storage_write_failure", "critical", 5, "S3_WRITE_FAILURE", "0"),
    AlertRule("duplicate_ratio", "warning", 10, "silver_duplicate_records", "0.10", "silver_input_records"),
    AlertRule("api_failure_ratio", "warning", 10, "api_error_count", "0.10", "api_request_count"),
)

# ---------------------------------------------------------------------------------------------------------------------

MONEY = "decimal(18,4)"


def in_lookback(df: DataFrame, as_of: str, minutes: int) -> DataFrame:
    """Rows of the last ``minutes`` before ``as_of``; plain comparisons of the time column, so they reach the scan."""
    kind = df.schema["ts"].dataType
    end = F.lit(as_of).cast(kind)
    start = (F.lit(as_of).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes))).cast(kind)
    return df.filter((F.col("ts") >= start) & (F.col("ts") < end))


def metric_sum(*names: str) -> list[Column]:
    """One conditional sum per metric name, 0 where the name does not occur."""
    return [
        F.coalesce(F.sum(F.when(F.col("name") == n, F.col("value"))), F.lit(0)).cast(MONEY).alias(n) for n in names
    ]


def named(metrics: DataFrame, *names: str) -> DataFrame:
    return metrics.filter(F.col("name").isin(*names))


def telemetry_arrival(events: DataFrame, metrics: DataFrame, service: str, pipeline_id: str, as_of: str, minutes: int = 30) -> DataFrame:
    logs = in_lookback(events.filter(F.col("service_name") == service), as_of, minutes)
    points = in_lookback(metrics.filter(F.col("pipeline_id") == pipeline_id), as_of, minutes)
    count = F.count(F.lit(1)).alias("arrived")
    return logs.agg(count).select(F.lit("events").alias("kind"), "arrived").unionByName(
        points.agg(count).select(F.lit("metrics").alias("kind"), "arrived")
    )


def latest_status_by_run(events: DataFrame, as_of: str, minutes: int = 120) -> DataFrame:
    ends = in_lookback(events.filter(F.col("event_type").isin(*RUN_END_TYPES)), as_of, minutes)
    return ends.groupBy("run_id", "tenant_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("latest_status"))


def events_by_type(events: DataFrame, as_of: str, minutes: int = 60, *facets: str) -> DataFrame:
    return in_lookback(events, as_of, minutes).groupBy(*facets, "event_type").agg(F.count(F.lit(1)).alias("n_events"))


def bronze_throughput_ts(metrics: DataFrame, as_of: str, minutes: int = 60, bucket: str = "5 minutes") -> DataFrame:
    name = "bronze_records_written"
    found = in_lookback(named(metrics, name), as_of, minutes)
    grouped = found.groupBy(F.window("ts", bucket).alias("w"), "dataset", "tenant_id").agg(*metric_sum(name))
    return grouped.select(F.col("w.start").alias("bucket_start"), "dataset", "tenant_id", name)


def silver_quality_facets(metrics: DataFrame, as_of: str, minutes: int = 60) -> DataFrame:
    names = ("silver_input_records", "silver_invalid_records", "silver_quarantine_records")
    return in_lookback(named(metrics, *names), as_of, minutes).groupBy("dataset", "tenant_id").agg(*metric_sum(*names))


def gold_health(metrics: DataFrame, as_of: str, minutes: int = 60) -> DataFrame:
    names = ("gold_output_records", "gold_validation_failures")
    return in_lookback(named(metrics, *names), as_of, minutes).groupBy("tenant_id").agg(*metric_sum(*names))


def latency_ts(metrics: DataFrame, as_of: str, minutes: int = 60, bucket: str = "5 minutes") -> DataFrame:
    found = in_lookback(named(metrics, "pipeline_duration_seconds"), as_of, minutes)
    grouped = found.groupBy(F.window("ts", bucket).alias("w"), "tenant_id").agg(
        money_ratio(F.sum("value"), F.count("value")).alias("avg_duration")
    )
    return grouped.select(F.col("w.start").alias("bucket_start"), "tenant_id", "avg_duration")


def api_errors(metrics: DataFrame, events: DataFrame, as_of: str, minutes: int = 60) -> DataFrame:
    """Error sum of the metrics beside the number of API_FAILURE events, per dataset and tenant."""
    keys = ["dataset", "tenant_id"]
    sums = in_lookback(named(metrics, "api_error_count"), as_of, minutes).groupBy(*keys).agg(*metric_sum("api_error_count"))
    counts = in_lookback(events.filter("event_type = 'API_FAILURE'"), as_of, minutes).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("api_failure_events")
    )
    return sums.join(counts, keys, "full").select(
        *keys,
        F.coalesce("api_error_count", F.lit(0)).cast(MONEY).alias("api_error_count"),
        F.coalesce("api_failure_events", F.lit(0).cast("bigint")).alias("api_failure_events"),
    )


def failures_by(events: DataFrame, types: tuple[str, ...], facets: list[str], as_of: str, minutes: int) -> DataFrame:
    """Count of the given failure events per facet (tenant, dataset, stage, ...)."""
    return in_lookback(events.filter(F.col("event_type").isin(*types)), as_of, minutes).groupBy(*facets).agg(
        F.count(F.lit(1)).alias("n_failures")
    )


def run_drilldown(events: DataFrame, as_of: str, minutes: int = 1440, limit: int = DRILLDOWN_LIMIT) -> DataFrame:
    """The newest ``limit`` events of every run, all columns."""
    recent = in_lookback(events, as_of, minutes)
    return first_per_key(recent, ["run_id"], [F.col("ts").desc(), F.col("event_id").desc()], limit)


def run_timeline(events: DataFrame, as_of: str, minutes: int = 1440, limit: int = TIMELINE_LIMIT) -> DataFrame:
    return run_drilldown(events, as_of, minutes, limit).select("run_id", "event_id", *TIMELINE_COLUMNS)


def latest_failing_run(events: DataFrame, as_of: str, minutes: int = 360) -> DataFrame:
    failed = in_lookback(events.filter(F.col("event_type").isin(*STAGE_FAILURE_TYPES)), as_of, minutes)
    return failed.agg(F.max_by("run_id", F.struct("ts", "event_id")).alias("run_id"))


def run_impact(metrics: DataFrame, as_of: str, minutes: int = 1440) -> DataFrame:
    names = ("silver_invalid_records", "silver_quarantine_records", "gold_validation_failures")
    found = in_lookback(named(metrics, *names), as_of, minutes)
    return found.groupBy("run_id", "tenant_id", "dataset").agg(*metric_sum(*names))


def records_processed(metrics: DataFrame, as_of: str, minutes: int = 1440) -> DataFrame:
    names = ("bronze_records_written", "silver_valid_records", "gold_output_records")
    return in_lookback(named(metrics, *names), as_of, minutes).agg(*metric_sum(*names))


def run_overview(events: DataFrame, metrics: DataFrame, as_of: str, minutes: int = 1440) -> DataFrame:
    """One row: runs started, succeeded, failed, their mean duration and the latest end status."""
    ended = F.col("event_type").isin(*RUN_END_TYPES)
    runs = in_lookback(events, as_of, minutes).agg(
        F.count_if(F.col("event_type") == "PIPELINE_START").alias("total_runs"),
        F.count_if((F.col("event_type") == "PIPELINE_END") & (F.col("status") == "SUCCESS")).alias("success_runs"),
        F.count_if(F.col("event_type") == "PIPELINE_FAILURE").alias("failed_runs"),
        F.max_by(F.when(ended, F.col("status")), F.when(ended, F.struct("ts", "event_id"))).alias("latest_status"),
    )
    durations = in_lookback(named(metrics, "pipeline_duration_seconds"), as_of, minutes).agg(
        money_ratio(F.sum("value"), F.count("value")).alias("avg_duration")
    )
    # two single rows become one without a join: each column is known in one of them only
    both = runs.unionByName(durations, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


# --- alerts ----------------------------------------------------------------------------------------------------------


def _signal_names() -> list[str]:
    return sorted({n for r in ALERT_RULES for n in (r.numerator, r.denominator) if n})


def signals(events: DataFrame, metrics: DataFrame) -> DataFrame:
    """Events (each counts 1) and metrics of all pipelines in one long shape, reduced to the names some alert rule reads."""
    counted = events.select("ts", "pipeline_id", F.col("event_type").alias("name"), F.lit(1).cast(MONEY).alias("value"))
    measured = metrics.select("ts", "pipeline_id", "name", F.col("value").cast(MONEY).alias("value"))
    return counted.unionByName(measured).filter(F.col("name").isin(*_signal_names()))


def signal_sums(signal_rows: DataFrame) -> DataFrame:
    """Sums of every signal per pipeline and 5-minute window, one column each."""
    grouped = signal_rows.groupBy("pipeline_id", F.window("ts", "5 minutes").alias("w")).agg(*metric_sum(*_signal_names()))
    return grouped.select("pipeline_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *_signal_names())


def sum_windows(sums: DataFrame) -> DataFrame:
    """One row per pipeline and window from partial sums."""
    return sums.groupBy("pipeline_id", "window_start", "window_end").agg(*[F.sum(n).cast(MONEY).alias(n) for n in _signal_names()])


def alerts_of_windows(five: DataFrame, sliding: bool) -> DataFrame:
    """Alert rows of all rules from 5-minute sums; 10-minute windows tumble, or slide by five minutes."""
    window = F.window("window_start", "10 minutes", "5 minutes") if sliding else F.window("window_start", "10 minutes")
    ten = five.groupBy("pipeline_id", window.alias("w")).agg(*[F.sum(n).cast(MONEY).alias(n) for n in _signal_names()])
    ten = ten.select("pipeline_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *_signal_names())
    return fired(five, 5).unionByName(fired(ten, 10))


def fired(sums: DataFrame, minutes: int) -> DataFrame:
    """Alert rows of the rules of one window length."""
    alerts = []
    for r in (r for r in ALERT_RULES if r.minutes == minutes):
        total = F.col(r.numerator)
        base = F.greatest(F.col(r.denominator), F.lit(1)) if r.denominator else F.lit(1)
        # compared as amounts, so that a ratio of exactly the threshold does not fire
        breach = total > base * F.lit(r.threshold).cast("decimal(10,4)")
        observed = F.round(total.cast("double") / base.cast("double"), 4)
        alerts.append(F.when(breach, F.struct(F.lit(r.name).alias("alert"), F.lit(r.level).alias("level"), observed.alias("observed"))))
    exploded = sums.withColumn("a", F.explode(F.array_compact(F.array(*alerts))))
    return exploded.select("pipeline_id", "window_start", "window_end", "a.alert", "a.level", "a.observed")


def alert_conditions(events: DataFrame, metrics: DataFrame) -> DataFrame:
    """Alert rows of all rules per pipeline over tumbling windows.

    Raw telemetry is summed once into 5-minute windows; the 10-minute windows are sums of those few rows.
    """
    return alerts_of_windows(signal_sums(signals(events, metrics)), sliding=False)


def missing_success(events: DataFrame, start: str, end: str, hours: int = 2) -> DataFrame:
    """Windows of the expected run interval without a successful completion, silent windows included."""
    kind = events.schema["ts"].dataType
    width = f"{hours} hours"
    done = events.filter("event_type = 'PIPELINE_END' AND status = 'SUCCESS'").groupBy(
        F.window("ts", width).alias("w")
    ).agg(F.count(F.lit(1)).alias("completions")).select(F.col("w.start").alias("window_start"), "completions")
    slots = events.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(start).cast(kind), (F.lit(end).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours))).cast(kind),
                             F.make_dt_interval(hours=F.lit(hours)))).alias("window_start")
    )
    return slots.join(done, "window_start", "left_anti")


def duration_anomalies(metrics: DataFrame, low: str, high: str, bucket: str = "1 day") -> DataFrame:
    """Windows per tenant whose mean run duration lies outside the expected range."""
    grouped = named(metrics, "pipeline_duration_seconds").groupBy(F.window("ts", bucket).alias("w"), "tenant_id").agg(
        money_ratio(F.sum("value"), F.count("value")).alias("avg_duration")
    )
    expected = F.col("avg_duration").between(F.lit(low).cast(MONEY), F.lit(high).cast(MONEY))
    return grouped.filter(~expected).select(F.col("w.start").alias("window_start"), "tenant_id", "avg_duration")


def monitoring_checks(
    events: DataFrame, metrics: DataFrame, service: str, pipeline_id: str, tenant_id: str, as_of: str, unit_minutes: int = 30
) -> DataFrame:
    """Six health checks as (check, value, state); each source is read once for all its checks."""
    def recent(minutes: int) -> Column:
        return F.col("ts") >= (F.lit(as_of).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes)))

    ours = in_lookback(events.filter(F.col("pipeline_id") == pipeline_id), as_of, 4 * unit_minutes)
    ended = F.col("event_type").isin(*RUN_END_TYPES)
    log_row = ours.agg(
        F.count_if(recent(unit_minutes) & (F.col("service_name") == service)).alias("logs"),
        F.max_by(F.when(ended, F.col("status")), F.when(ended, F.struct("ts", "event_id"))).alias("status"),
    )
    points = in_lookback(metrics.filter(F.col("pipeline_id") == pipeline_id), as_of, 2 * unit_minutes)

    def total(name: str, extra: Column | None = None) -> Column:
        test = F.col("name") == name if extra is None else (F.col("name") == name) & extra
        return F.coalesce(F.sum(F.when(test, F.col("value"))), F.lit(0)).cast(MONEY).cast("string")

    metric_row = points.agg(
        F.count_if(recent(unit_minutes)).alias("points"),
        total("gold_validation_failures").alias("gold"),
        total("api_error_count").alias("api"),
        total("silver_invalid_records", F.col("tenant_id") == tenant_id).alias("invalid"),
    )

    def required(name: str, count: str) -> Column:
        state = F.when(F.col(count) == 0, "WARN").otherwise("OK")
        return F.struct(F.lit(name).alias("check"), F.col(count).cast("string").alias("value"), state.alias("state"))

    def shown(name: str, value: str) -> Column:
        return F.struct(F.lit(name).alias("check"), F.col(value).alias("value"), F.lit("OK").alias("state"))

    status_state = F.when(F.col("status").isNull(), "WARN").when(F.col("status") == "FAILED", "FAIL").otherwise("OK")
    status = F.struct(
        F.lit("latest_status").alias("check"), F.coalesce("status", F.lit("<no rows>")).alias("value"), status_state.alias("state")
    )
    log_checks = log_row.select(F.inline(F.array(required("logs_arriving", "logs"), status)))
    metric_checks = metric_row.select(F.inline(F.array(
        required("metrics_arriving", "points"), shown("gold_validation_failures", "gold"),
        shown("api_errors", "api"), shown("silver_invalid_records", "invalid"),
    )))
    return log_checks.unionByName(metric_checks)


def metrics_from_logs(records: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Wide quality or status records to long metric rows (name, value)."""
    typed = records.withColumns({m: F.col(m).cast(MONEY) for m in measures})
    return typed.unpivot(keys, measures, "name", "value")


def event_once(events: DataFrame, keys: tuple[str, ...] = ("run_id", "event_type")) -> DataFrame:
    """At most one event per key: the first one counts, later ones are ignored."""
    return first_per_key(events, keys, [F.col("ts").asc(), F.col("event_id").asc()])


def bucket_edges(events: DataFrame, minutes: int) -> DataFrame:
    """First and last event time of each tenant in every bucket of ``minutes``."""
    bucket = F.window("ts", f"{minutes} minutes")
    edges = events.groupBy("tenant_id", bucket.alias("w")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    return edges.select("tenant_id", F.col("w.start").alias("bucket"), "first", "last")


def combine_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("tenant_id", "bucket").agg(F.min("first").alias("first"), F.max("last").alias("last"))


def gaps_of_edges(edges: DataFrame, minutes: int, as_of: str | None = None, still_open: bool = False) -> DataFrame:
    """Gaps between bucket edges; with ``still_open`` also the last one of a tenant, if ``as_of`` (None: the newest event) is that far on.

    The window runs over the bucket edges of one tenant: one row per bucket, bounded by the time span and not by the number of events.
    """
    following = F.lead("first").over(Window.partitionBy("tenant_id").orderBy("last"))
    if still_open:
        now = edges.agg(F.max("last").alias("now")) if as_of is None else edges.sparkSession.range(1).select(
            F.lit(as_of).cast(edges.schema["last"].dataType).alias("now"))
        edges = edges.withColumn("until", following).crossJoin(now)  # one row
    else:
        edges = edges.withColumn("until", following).withColumn("now", F.lit(None).cast(edges.schema["last"].dataType))
    end = F.coalesce("until", "now")
    gaps = edges.filter(end - F.col("last") > F.make_dt_interval(mins=F.lit(minutes)))
    return gaps.select("tenant_id", F.col("last").alias("silent_from"), F.col("until").alias("silent_until"))


def silent_gaps(events: DataFrame, minutes: int) -> DataFrame:
    """Times in which a tenant sent nothing for longer than ``minutes``.

    Events are first reduced to the first and last of every bucket of that length: inside one bucket no gap can be long
    enough, so only bucket edges are compared, and a busy tenant costs one row per bucket.
    """
    return gaps_of_edges(bucket_edges(events, minutes), minutes)


def late_rows(events: DataFrame, arrived_column: str, delay_minutes: int = 10) -> DataFrame:
    """Count per tenant of rows that arrived more than ``delay_minutes`` after their time; streams count them all the same."""
    late = F.col(arrived_column) - F.col("ts") > F.make_dt_interval(mins=F.lit(delay_minutes))
    return events.groupBy("tenant_id").agg(F.count_if(late).alias("late_rows"), F.count(F.lit(1)).alias("all_rows"))
