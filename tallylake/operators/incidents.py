"""Incident tables as set operations: what a service does row by row, done once per batch of changes.

Every change batch is reduced to one row per incident before it meets the base table, so results equal applying the
changes one after the other in time order (ties by ``event_id``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylake.functions import text
from tallylake.operators.cleanse import first_per_key
from tallylake.operators.retail import where_given

# --- fixed values ----------------------------------------------------------------------------------------------------

HISTORY_STATES = ("DIAGNOSED", "AWAITING_APPROVAL", "APPROVED", "REJECTED")
HISTORY_MIN, HISTORY_DEFAULT, HISTORY_MAX = 1, 5, 50
RELATED_LIMIT = 5
RECENT_LIMIT = 50
LOG_TAIL = 200

ALLOWED_ACTIONS = {
    "spark": (
        "retry_pipeline", "rerun_failed_stage", "increase_executor_memory", "increase_executor_cores",
        "increase_shuffle_partitions", "reduce_partition_size", "handle_data_skew", "fix_schema_mapping",
        "verify_source_connection", "verify_target_connection", "repair_input_path",
    ),
    "synapse": ("retry_pipeline", "verify_source_connection", "verify_target_connection"),
}

INCIDENT_COLUMNS = (
    "incident_id", "tenant_id", "platform_id", "pipeline", "severity", "status", "problem", "source", "created_at",
    "updated_at",
)

# ---------------------------------------------------------------------------------------------------------------------

_TIME = ("changed_at", "event_id")


def _last(value: Column | str) -> Column:
    return F.max_by(value, F.struct(*_TIME))


def _first(value: Column | str) -> Column:
    return F.min_by(value, F.struct(*_TIME))


def _last_visible(value: str) -> Column:
    """Last value that is neither NULL nor blank."""
    seen = text.blank_to_null(value).isNotNull()
    return F.max_by(F.when(seen, F.col(value)), F.when(seen, F.struct(*_TIME)))


# --- reads -----------------------------------------------------------------------------------------------------------


def incident_filter(
    incidents: DataFrame, tenant_id: str | None = None, platform_id: str | None = None, status: str | None = None,
    severity: str | None = None,
) -> DataFrame:
    return where_given(incidents, tenant_id=tenant_id, platform_id=platform_id, status=status, severity=severity)


def incident_search(incidents: DataFrame, query: str, status: str = "ALL", severity: str = "ALL") -> DataFrame:
    """Rows whose id, pipeline, tenant or platform contains the query, ignoring case."""
    found = where_given(
        incidents, status=None if status == "ALL" else status, severity=None if severity == "ALL" else severity
    )
    wanted = query.strip().lower()
    if not wanted:
        return found
    return found.filter(F.contains(searched_text(), F.lit(wanted)))


def searched_text() -> Column:
    """What :func:`incident_search` looks into."""
    return F.lower(F.concat_ws(" ", "incident_id", "pipeline", "tenant_id", "platform_id"))


def incomplete_runs(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("completed_at").isNull())


def overdue_runs(runs: DataFrame, now: str) -> DataFrame:
    """Failed outcome rows for the runs that did not report before their deadline."""
    late = incomplete_runs(runs).filter(F.col("deadline_at") <= F.lit(now).cast(runs.schema["deadline_at"].dataType))
    return late.select(
        "workflow_run_id",
        text.incident_id_for_run("workflow_run_id").alias("incident_id"),
        "tenant_id", "platform_id", "pipeline",
        F.lit("FAILED").alias("outcome"),
        F.concat(F.lit("Pipeline run "), F.coalesce("run_id", F.lit("None")), F.lit(" did not report status within the deadline")).alias("details"),
    )


def incidents_with_payload(incidents: DataFrame, payloads: DataFrame) -> DataFrame:
    joined = incidents.join(payloads.select("incident_id", "failure_payload"), "incident_id", "left")
    return joined.withColumn("failure_payload", F.coalesce("failure_payload", F.lit("{}")))


def latest_per(rows: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """Newest row per key (latest diagnosis, latest plan)."""
    return first_per_key(rows, [key], [F.col(time).desc(), F.col(tie).desc()])


def failure_history(runs: DataFrame, diagnoses: DataFrame, plans: DataFrame, last: int = HISTORY_DEFAULT) -> DataFrame:
    """The last runs per (tenant, pipeline) that went through diagnosis, with their latest diagnosis and plan."""
    n = min(max(last, HISTORY_MIN), HISTORY_MAX)
    chosen = first_per_key(
        runs.filter(F.col("state").isin(*HISTORY_STATES)),
        ["tenant_id", "pipeline"],
        [F.col("started_at").desc(), F.col("workflow_run_id").desc()],
        n,
    ).select("tenant_id", "pipeline", "workflow_run_id", "incident_id", "started_at", "state")
    known = latest_per(diagnoses, "workflow_run_id", "created_at", "diagnosis_id").select("workflow_run_id", "root_cause", "confidence")
    planned = latest_per(plans, "workflow_run_id", "created_at", "plan_id").select("workflow_run_id", "actions", "approval_status")
    joined = chosen.join(known, "workflow_run_id", "left").join(planned, "workflow_run_id", "left")
    return joined.select(
        "tenant_id", "pipeline", "workflow_run_id", "incident_id", "started_at", "state",
        F.coalesce("root_cause", F.lit("")).alias("root_cause"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("actions", F.lit("[]")).alias("remediation_actions"),
        F.coalesce("approval_status", F.lit("")).alias("approval_status"),
    )


def distinct_scopes(incidents: DataFrame, column: str, labels: DataFrame | None = None) -> DataFrame:
    """Tenants or platforms that have incidents, with a given label (id, label) or one made from the id."""
    scopes = incidents.select(F.col(column).alias("id")).distinct()
    if labels is not None:
        scopes = scopes.join(labels.select("id", "label"), "id", "left")
    else:
        scopes = scopes.withColumn("label", F.lit(None).cast("string"))
    return scopes.select("id", F.coalesce("label", text.humanize("id")).alias("label")).orderBy("id")


def catalog_merge(incident_scopes: DataFrame, retail_scopes: DataFrame) -> DataFrame:
    """All scopes of both catalogs by id; where both know one, the retail label wins."""
    left = incident_scopes.select("id", F.col("label").alias("_incident"))
    right = retail_scopes.select("id", F.col("label").alias("_retail"))
    merged = left.join(right, "id", "full")
    return merged.select("id", F.coalesce("_retail", "_incident").alias("label")).orderBy("id")


def remediation_allowlist(actions: DataFrame) -> DataFrame:
    """Verdict per proposed action (incident_id, adapter, action, explanation, risk).

    The allow-list is a fixed table of a dozen names, so it is an expression on the row, not a join.
    """
    pairs = [F.struct(F.lit(a), F.lit(x)) for a, names in ALLOWED_ACTIONS.items() for x in names]
    allowed = F.coalesce(F.struct("adapter", "action").isin(*pairs), F.lit(False))
    complete = (F.coalesce("explanation", F.lit("")) != "") & (F.coalesce("risk", F.lit("")) != "")
    reason = F.when(
        ~allowed,
        F.concat(F.lit("Action '"), F.col("action"), F.lit("' is not allowed for adapter '"), F.col("adapter"), F.lit("'")),
    ).when(~complete, F.lit("Missing explanation or risk fields"))
    return actions.withColumns({"valid": allowed & complete, "reason": F.coalesce(reason, F.lit(""))})


def incident_owner_check(requests: DataFrame, incidents: DataFrame) -> DataFrame:
    """Each requested (incident, tenant, platform) with found / not found."""
    keys = ["incident_id", "tenant_id", "platform_id"]
    owned = incidents.select(*keys).distinct().withColumn("_hit", F.lit(True))  # a repeated incident must not repeat requests
    return requests.join(owned, keys, "left").withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def incident_kpis(incidents: DataFrame) -> DataFrame:
    """Seven dashboard counters per tenant and platform."""
    status = F.col("_status")
    rows = incidents.withColumn("_status", text.effective_status("status", "recovery_confirmed"))
    return rows.groupBy("tenant_id", "platform_id").agg(
        F.count(F.lit(1)).alias("total_incidents"),
        F.count_if(~status.isin(*text.CLOSED_STATUSES)).alias("open_incidents"),
        F.count_if(status == "INVESTIGATING").alias("investigating"),
        F.count_if(status == "AWAITING_APPROVAL").alias("awaiting_approval"),
        F.count_if(status == "REMEDIATING").alias("remediating"),
        F.count_if(status == "RESOLVED").alias("resolved"),
        F.count_if(status == "ESCALATED").alias("escalated"),
    )


def resolution_ratio(incidents: DataFrame) -> DataFrame:
    """Percent of a pipeline's incidents that are resolved with confirmed recovery; incidents without pipeline are left out."""
    done = text.effective_status("status", "recovery_confirmed") == "RESOLVED"
    return incidents.filter("pipeline <> ''").groupBy("tenant_id", "platform_id", "pipeline").agg(
        F.count_if(done).alias("resolved"),
        F.count(F.lit(1)).alias("returned"),
        F.round(F.lit(100.0) * F.count_if(done) / F.count(F.lit(1)), 4).alias("health"),
    )


def sort_incidents(incidents: DataFrame, mode: str = "Newest first") -> DataFrame:
    """Severity, Incident ID, Pipeline, Oldest first, or newest first for anything else."""
    orders = {
        "Severity": [text.severity_rank("severity").asc(), F.col("incident_id").asc()],
        "Incident ID": [F.col("incident_id").asc()],
        "Pipeline": [F.lower("pipeline").asc(), F.col("incident_id").asc()],
        "Oldest first": [F.col("created_at").asc(), F.col("incident_id").asc()],
    }
    return incidents.orderBy(*orders.get(mode, [F.col("created_at").desc(), F.col("incident_id").desc()]))


def recent_incidents(incidents: DataFrame, limit: int = RECENT_LIMIT, offset: int = 0) -> DataFrame:
    return incidents.orderBy(F.col("created_at").desc(), F.col("incident_id").desc()).offset(max(offset, 0)).limit(limit)


def related_incidents(incidents: DataFrame, place: str, limit: int = RELATED_LIMIT) -> DataFrame:
    """For every incident the newest ``limit`` of its scope, itself removed *after* the limit (so 4 or 5 rows).

    The newest rows are an array per scope, written to ``place`` first: Spark then knows that they are few and sends them to the
    incidents, which stay where they are. Joining a row per scope back never pairs up a scope.
    """
    scope = ["tenant_id", "platform_id"]
    newest = first_per_key(incidents, scope, [F.col("created_at").desc(), F.col("incident_id").desc()], limit)
    entry = F.struct(F.col("incident_id").alias("related_id"), F.col("problem").alias("summary"), F.col("created_at").alias("detected_at"))
    newest = newest.groupBy(*scope).agg(F.collect_list(entry).alias("_newest"))  # ``limit`` at most
    newest.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(place)
    stored = incidents.sparkSession.read.schema(newest.schema).parquet(place)
    return incidents.select(*scope, "incident_id").join(stored, scope).select(*scope, "incident_id", F.inline("_newest")).filter("incident_id <> related_id")


def chronological(entries: DataFrame, time_text: str, position: str, *lead: str) -> DataFrame:
    """Ascending instant; text without a zone is UTC, text that is no time goes last in its original order."""
    instant = F.col(time_text).try_cast("timestamp")
    return entries.withColumn("instant", instant).orderBy(*lead, F.col("instant").asc_nulls_last(), F.col(position).asc())


def log_tail(lines: DataFrame, keys: list[str], limit: int = LOG_TAIL) -> DataFrame:
    """Newest ``limit`` lines per key, oldest first, blank ones removed after the limit; the last one is the error.

    Groups are cut to ``limit`` lines before the shuffle, so the array is bounded however long the log is.
    """
    tail = first_per_key(lines, keys, [F.col("ts").desc(), F.col("event_id").desc()], limit)
    line = F.struct("ts", "event_id", "message")
    ordered = tail.groupBy(*keys).agg(F.sort_array(F.collect_list(line)).alias("_lines"))
    kept = F.filter(F.transform("_lines", lambda x: x["message"]), lambda m: m.isNotNull() & (m != ""))
    last = F.coalesce(F.try_element_at(F.col("logs"), F.lit(-1)), F.lit(""))
    return ordered.withColumn("logs", kept).withColumn("error_message", last).drop("_lines")


def incident_timeline(incidents: DataFrame, agent_events: DataFrame) -> DataFrame:
    """Detection, current status and agent events of every incident as one list of entries."""
    entry = ["incident_id", "position", "label", "message", "at"]
    detected = incidents.select(
        "incident_id", F.lit(0).cast("bigint").alias("position"), F.lit("Detected").alias("label"),
        F.coalesce(F.nullif("problem", F.lit("")), F.lit("Failure detected")).alias("message"), F.col("created_at").alias("at"),
    )
    current = incidents.select(
        "incident_id", F.lit(1).cast("bigint").alias("position"), F.lit("Current status").alias("label"),
        F.col("status").alias("message"), F.col("updated_at").alias("at"),
    )
    steps = agent_events.join(incidents.select("incident_id"), "incident_id", "left_semi").select(
        "incident_id", (F.col("event_id") + 2).alias("position"), F.concat_ws(": ", "agent", "event_type").alias("label"),
        F.lit("").alias("message"), F.col("created_at").alias("at"),
    )
    union = reduce(DataFrame.unionByName, [detected.select(*entry), current.select(*entry), steps.select(*entry)])
    return union.orderBy("incident_id", F.col("at").asc_nulls_last(), "position")


# --- JSON shapes -----------------------------------------------------------------------------------------------------

RUN_DETAILS = """outcome string, diagnosis struct<failure_location string, root_cause string, recent_logs array<string>,
    remedies array<struct<action string, explanation string, priority string, risk string>>, message_for_ui string>"""

LOG_ENTRIES = """array<struct<timestamp string, created_at string, level string, source string, message string,
    fields map<string,string>, attributes map<string,string>>>"""


def flatten_run_history(incidents: DataFrame, payloads: DataFrame, max_logs: int = 20) -> DataFrame:
    """Recorded pipeline runs with outcome, diagnosis, first log lines and remedies out of their JSON details."""
    runs = incidents_with_payload(incidents.filter("source = 'PIPELINE_RUN'"), payloads)
    d = F.col("d.diagnosis")
    remedies = F.transform(
        d["remedies"],
        lambda r: F.struct(*[text.first_non_blank(r[c]).alias(c) for c in ("action", "explanation", "priority", "risk")]),
    )
    return runs.withColumn("d", F.from_json("failure_payload", RUN_DETAILS)).select(
        "incident_id", "pipeline", "status", "created_at",
        text.first_non_blank("d.outcome").alias("outcome"),
        text.first_non_blank(d["failure_location"]).alias("failure_location"),
        text.first_non_blank(d["root_cause"]).alias("root_cause"),
        F.coalesce(text.first_items(d["recent_logs"], max_logs), F.array().cast("array<string>")).alias("recent_logs"),
        F.coalesce(remedies, F.array().cast("array<struct<action:string,explanation:string,priority:string,risk:string>>")).alias("remedies"),
        text.first_non_blank(d["message_for_ui"]).alias("message_for_ui"),
    )


def normalize_log_entries(rows: DataFrame, body: str, *keys: str) -> DataFrame:
    """JSON arrays of log entries to rows, accepting both spellings of the time and attribute keys."""
    entries = rows.select(*keys, F.posexplode(F.from_json(body, LOG_ENTRIES)).alias("position", "e"))
    return entries.select(
        *keys, "position",
        F.coalesce("e.timestamp", "e.created_at", F.lit("")).alias("timestamp"),
        F.coalesce("e.level", F.lit("UNKNOWN")).alias("level"),
        F.coalesce("e.source", F.lit("")).alias("source"),
        F.coalesce("e.message", F.lit("")).alias("message"),
        F.to_json(F.coalesce("e.fields", "e.attributes", F.create_map().cast("map<string,string>"))).alias("fields_json"),
    )


# --- writes ----------------------------------------------------------------------------------------------------------


FAILURE_FIELDS = ("tenant_id", "platform_id", "pipeline", "severity", "problem", "failure_payload")


def reduce_failures(changes: DataFrame) -> DataFrame:
    """One row per incident: latest fields, last visible source, and when it was first and last reported."""
    visible = text.blank_to_null("source").isNotNull()
    return changes.groupBy("incident_id").agg(
        *[_last(c).alias(c) for c in FAILURE_FIELDS],
        F.coalesce(_last_visible("source"), F.lit("")).alias("source"),
        F.max(F.when(visible, F.col("changed_at"))).alias("source_at"),
        F.min("changed_at").alias("first_at"),
        F.max("changed_at").alias("last_at"),
    )


def combine_reduced(parts: DataFrame, order: str) -> DataFrame:
    """Reduced rows of several batches to one per incident; ``order`` settles equal times."""
    return parts.groupBy("incident_id").agg(
        *[F.max_by(c, F.struct("last_at", order)).alias(c) for c in FAILURE_FIELDS],
        F.coalesce(F.max_by(F.when(F.col("source_at").isNotNull(), F.col("source")), F.struct("source_at", order)), F.lit("")).alias("source"),
        F.max("source_at").alias("source_at"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
    )


def upsert_failures(base: DataFrame, payloads: DataFrame, changes: DataFrame) -> DataFrame:
    """Incident table after a batch of failure reports, see :func:`merge_reduced_failures`."""
    return merge_reduced_failures(base, payloads, reduce_failures(changes))


def merge_reduced_failures(base: DataFrame, payloads: DataFrame, change: DataFrame) -> DataFrame:
    """Incidents with payload after a batch of failure reports.

    New incidents start as DETECTED; known ones take the new fields, keep their creation time (and their source if the
    report has none), go back to DETECTED and lose the result payload.
    """
    change = change.select("incident_id", *[F.col(c).alias(f"_{c}") for c in change.columns if c != "incident_id"])
    joined = base.join(payloads, "incident_id", "left").join(change, "incident_id", "full")
    changed = F.col("_last_at").isNotNull()

    def after(name: str) -> Column:
        return F.when(changed, F.col(f"_{name}")).otherwise(F.col(name))

    return joined.select(
        "incident_id",
        after("tenant_id").alias("tenant_id"),
        after("platform_id").alias("platform_id"),
        after("pipeline").alias("pipeline"),
        F.when(changed, text.normalize_severity("_severity")).otherwise(F.col("severity")).alias("severity"),
        F.when(changed, F.lit("DETECTED")).otherwise(F.col("status")).alias("status"),
        after("problem").alias("problem"),
        F.coalesce(F.nullif("_source", F.lit("")), "source", F.lit("")).alias("source"),
        F.coalesce("created_at", "_first_at").alias("created_at"),
        F.coalesce("_last_at", "updated_at").alias("updated_at"),
        F.coalesce(after("failure_payload"), F.lit("{}")).alias("failure_payload"),
        F.when(changed, F.lit("{}")).otherwise(F.coalesce("agent_result_payload", F.lit("{}"))).alias("agent_result_payload"),
    )


def incidents_from_runs(base: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Incidents after a batch of completed runs: FAILED is a HIGH / DETECTED incident, anything else LOW / RESOLVED."""
    change = outcomes.groupBy("incident_id").agg(
        *[_first(c).alias(f"_{c}") for c in ("tenant_id", "platform_id", "pipeline")],
        _first("outcome").alias("_first_outcome"),
        _last("outcome").alias("_outcome"),
        _last_visible("details").alias("_details"),
        F.min("changed_at").alias("_first_at"),
        F.max("changed_at").alias("_last_at"),
    )
    joined = base.join(change, "incident_id", "full")
    changed, failed = F.col("_last_at").isNotNull(), F.col("_outcome") == "FAILED"
    default = F.when(F.col("_first_outcome") == "FAILED", "Pipeline run failed").otherwise("Pipeline run succeeded")
    return joined.select(
        "incident_id",
        *[F.coalesce(c, f"_{c}").alias(c) for c in ("tenant_id", "platform_id", "pipeline")],
        F.when(changed, F.when(failed, "HIGH").otherwise("LOW")).otherwise(F.col("severity")).alias("severity"),
        F.when(changed, F.when(failed, "DETECTED").otherwise("RESOLVED")).otherwise(F.col("status")).alias("status"),
        F.coalesce("_details", "problem", default).alias("problem"),
        F.coalesce("source", F.lit("PIPELINE_RUN")).alias("source"),
        F.coalesce("created_at", "_first_at").alias("created_at"),
        F.coalesce("_last_at", "updated_at").alias("updated_at"),
    )


def json_with(payload: Column, key: str, value: Column) -> Column:
    """JSON object text with one key at its top replaced or added; text that is no object counts as an empty one."""
    fields = F.coalesce(F.try_parse_json(payload).try_cast("map<string,variant>"), F.create_map().cast("map<string,variant>"))
    others = F.map_filter(fields, lambda name, _: name != key)
    return F.to_json(F.map_concat(others, F.create_map(F.lit(key), value.cast("variant"))))


def _last_results(results: DataFrame) -> DataFrame:
    deletes = (F.col("outcome") != "FAILED") & F.coalesce("validated_resolved", F.lit(False))
    return results.groupBy("incident_id").agg(
        F.bool_or(deletes).alias("_deleted"), _last("outcome").alias("_outcome"), _last("result").alias("_result"), F.max("changed_at").alias("_last_at"))


def payloads_after_results(payloads: DataFrame, base: DataFrame, results: DataFrame) -> DataFrame:
    """Payloads after agent results: those of validated successes leave the table with their incidents, others keep the last result.
    An incident without a payload gets one; results of unknown incidents have no effect."""
    change = _last_results(results).join(base.select("incident_id"), "incident_id", "left_semi")
    joined = payloads.join(change, "incident_id", "full").filter(~F.coalesce("_deleted", F.lit(False)))
    result = F.to_json(F.struct(F.col("_outcome").alias("outcome"), F.col("_result").alias("result")))
    return joined.select(
        "incident_id", F.coalesce("failure_payload", F.lit("{}")).alias("failure_payload"),
        F.when(F.col("_last_at").isNotNull(), result).otherwise(F.coalesce("agent_result_payload", F.lit("{}"))).alias("agent_result_payload"))


def payloads_after_status(payloads: DataFrame, base: DataFrame, changes: DataFrame) -> DataFrame:
    """Payloads after status changes: the last diagnosis given becomes part of the incident's failure payload."""
    given = changes.groupBy("incident_id").agg(_last_visible("diagnosis").alias("_diagnosis")).filter("_diagnosis IS NOT NULL")
    joined = payloads.join(given.join(base.select("incident_id"), "incident_id", "left_semi"), "incident_id", "full")
    failure = F.coalesce("failure_payload", F.lit("{}"))
    return joined.select(
        "incident_id", F.when(F.col("_diagnosis").isNotNull(), json_with(failure, "diagnosis", F.col("_diagnosis"))).otherwise(failure).alias("failure_payload"),
        F.coalesce("agent_result_payload", F.lit("{}")).alias("agent_result_payload"))


def apply_agent_results(base: DataFrame, results: DataFrame) -> DataFrame:
    """Incidents after agent results: validated successes leave the table, failures escalate, other successes wait for validation."""
    joined = base.join(_last_results(results), "incident_id", "left").filter(~F.coalesce("_deleted", F.lit(False)))
    changed = F.col("_last_at").isNotNull()
    status = F.when(F.col("_outcome") == "FAILED", "ESCALATED").when(changed, "VALIDATING").otherwise(F.col("status"))
    return joined.select(
        *[c for c in base.columns if c not in ("status", "updated_at")],
        status.alias("status"),
        F.coalesce("_last_at", "updated_at").alias("updated_at"),
        F.col("_result").alias("agent_result"),
    )


def apply_status_changes(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Latest status per incident and the last diagnosis text given; changes of unknown incidents have no effect."""
    last = changes.groupBy("incident_id").agg(
        _last("status").alias("_status"), F.max("changed_at").alias("_last_at"), _last_visible("diagnosis").alias("diagnosis")
    )
    joined = base.join(last, "incident_id", "left")
    return joined.select(
        *[c for c in base.columns if c not in ("status", "updated_at")],
        F.coalesce("_status", "status").alias("status"),
        F.coalesce("_last_at", "updated_at").alias("updated_at"),
        "diagnosis",
    )


def apply_plan_decisions(plans: DataFrame, decisions: DataFrame) -> DataFrame:
    """Plans with the last decision on the newest plan of each incident; older plans keep their state."""
    newest = latest_per(plans, "incident_id", "created_at", "plan_id").select("plan_id", F.col("incident_id"))
    last = latest_per(decisions, "incident_id", "decided_at", "event_id").select("incident_id", "approved", "decided_by", "decided_at")
    decided = newest.join(last, "incident_id").drop("incident_id")
    joined = plans.join(decided, "plan_id", "left")
    status = F.when(F.col("approved"), "APPROVED").when(~F.col("approved"), "REJECTED").otherwise(F.col("approval_status"))
    return joined.select(
        *[c for c in plans.columns if c != "approval_status"],
        status.alias("approval_status"),
        F.col("decided_by").alias("approved_by"),
        F.col("decided_at").alias("approved_at"),
    )


def idempotent_run_insert(runs: DataFrame) -> DataFrame:
    """One run per idempotency key, the first wins; a run without key is its own group, so missing keys form no hot group."""
    key = F.nullif("idempotency_key", F.lit(""))
    keyed = runs.withColumns({"_kind": key.isNull(), "_key": F.coalesce(key, F.col("workflow_run_id"))})
    kept = first_per_key(keyed, ["_kind", "_key"], [F.col("started_at").asc(), F.col("workflow_run_id").asc()])
    return kept.drop("_kind", "_key")


def run_state_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("state", "current_agent").agg(F.count(F.lit(1)).alias("n_runs"))
