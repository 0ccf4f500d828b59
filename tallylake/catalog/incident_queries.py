"""Incident tables, texts and memory: inventory rows F12-F15, J12-J16, A6-A8, G4, T3-T7, U1, C4-C22, I, N and W6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylake.catalog.registry import query
from tallylake.catalog.telemetry_queries import stream
from tallylake.catalog.views_sql import EFFECTIVE, SEVERITY, VIEWS, pick
from tallylake.functions import nested_json, text
from tallylake.operators import incidents as inc
from tallylake.operators import similarity as sim
from tallylake.session import shared_dir
from tallylake.sources import trigrams, views
from tallylake.sources.keyed import KeyedTable, merge_both

from tallylake.streaming import jobs

INCIDENT = "incident_id, tenant_id, platform_id, pipeline, severity, status, problem, source, created_at, updated_at, recovery_confirmed"

# fixed values: words that occur in the given documents, grouped as signatures
TEXT_PATTERNS = {
    "license_text": ("license", "apache", "mit "),
    "contact_data": ("email", "@"),
    "web_text": ("http", "www.", "<html"),
}

VIEWS["v_payloads"] = f"""
SELECT 'INC-' || event_id AS incident_id, {pick(('FAILED', ' failed', 'PASSED', 'success', 'odd'), 'k % 5')} AS outcome,
  'stage_' || (k % 4) AS failure_location, 'cause ' || user_id AS root_cause, k, user_id
FROM v_events WHERE event_type = 'error' AND event_id % 3 <> 0"""


# --- F, J ------------------------------------------------------------------------------------------------------------


@query("incident_filter", "F12", f"SELECT {INCIDENT} FROM v_incidents WHERE tenant_id = 'tenant_001' AND platform_id = 'SPARK' AND severity = 'CRITICAL'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return inc.incident_filter(views.incidents(spark, d), tenant_id="tenant_001", platform_id="SPARK", severity="CRITICAL")


@query("incident_search", "F13", f"""
    SELECT {INCIDENT} FROM v_incidents WHERE severity = 'MEDIUM'
      AND contains(lower(concat_ws(' ', incident_id, pipeline, tenant_id, platform_id)), 'flow_3 tenant_00')""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return inc.incident_search(views.incidents(spark, d), " FLOW_3 Tenant_00 ", severity="MEDIUM")


@query("incident_search_indexed", "F13", f"""
    SELECT {INCIDENT} FROM v_incidents WHERE severity = 'MEDIUM' AND contains(lower(concat_ws(' ', incident_id, pipeline, tenant_id, platform_id)), '7 flow_3 ten')""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A search by the trigram postings of all incidents."""
    rows, place = views.incidents(spark, d), shared_dir(spark, "trigrams")
    trigrams.write_index(rows, "incident_id", inc.searched_text(), place)
    return inc.incident_filter(trigrams.search(rows, "incident_id", inc.searched_text(), place, " 7 FLOW_3 Ten"), severity="MEDIUM")


@query("incomplete_runs", "F14", "SELECT * FROM v_runs WHERE completed_at IS NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return inc.incomplete_runs(views.workflow_runs(spark, d))


@query("overdue_runs", "F15", """
    SELECT workflow_run_id, 'INC-' || upper(substr(workflow_run_id, 1, 8)) AS incident_id, tenant_id, platform_id, pipeline, 'FAILED' AS outcome,
      'Pipeline run ' || run_id || ' did not report status within the deadline' AS details
    FROM v_runs WHERE completed_at IS NULL AND deadline_at <= TIMESTAMP '2024-01-20 00:00:00'""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return inc.overdue_runs(views.workflow_runs(spark, d), "2024-01-20 00:00:00")


@query("incidents_with_payload", "J12", f"""
    SELECT i.incident_id, i.status, p.outcome, p.incident_id IS NOT NULL AS has_payload FROM v_incidents i LEFT JOIN v_payloads p USING (incident_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = inc.incidents_with_payload(views.incidents(spark, d), views.incident_payloads(spark, d))
    return rows.select(
        "incident_id", "status", F.get_json_object("failure_payload", "$.outcome").alias("outcome"),
        (F.col("failure_payload") != "{}").alias("has_payload"),
    )


@query("failure_history", "J13", """
    SELECT tenant_id, pipeline, r.workflow_run_id, incident_id, started_at, state, coalesce(root_cause, '') AS root_cause,
      coalesce(confidence, 0.0) AS confidence, coalesce(actions, '[]') AS remediation_actions, coalesce(approval_status, '') AS approval_status
    FROM (SELECT * FROM v_runs WHERE state IN ('DIAGNOSED', 'AWAITING_APPROVAL', 'APPROVED', 'REJECTED')
          QUALIFY row_number() OVER (PARTITION BY tenant_id, pipeline ORDER BY started_at DESC, workflow_run_id DESC) <= 50) r
    LEFT JOIN (SELECT workflow_run_id, root_cause, confidence FROM v_diagnoses
               QUALIFY row_number() OVER (PARTITION BY workflow_run_id ORDER BY created_at DESC, diagnosis_id DESC) = 1) USING (workflow_run_id)
    LEFT JOIN (SELECT workflow_run_id, actions, approval_status FROM v_plans
               QUALIFY row_number() OVER (PARTITION BY workflow_run_id ORDER BY created_at DESC, plan_id DESC) = 1) USING (workflow_run_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return inc.failure_history(views.workflow_runs(spark, d), views.diagnoses(spark, d), views.plans(spark, d), 500)


def retail_tenants(spark: SparkSession, d: str) -> DataFrame:
    tenants = views.customers(spark, d).select("tenant_id").distinct()
    return tenants.select(
        F.col("tenant_id").alias("id"), F.concat(F.lit("Retailer "), F.substring("tenant_id", 8, 3)).alias("label")
    )


_LABEL = "list_aggregate([upper(w[1]) || lower(w[2:]) FOR w IN string_split(replace(replace({0}, '_', ' '), '-', ' '), ' ') IF w <> ''], 'string_agg', ' ')"


@query("catalog_merge", "J14", f"""
    SELECT id, coalesce(r.label, i.label) AS label FROM (SELECT DISTINCT tenant_id AS id, {_LABEL.format('tenant_id')} AS label FROM v_incidents) i
    FULL JOIN (SELECT DISTINCT tenant_id AS id, 'Retailer ' || substr(tenant_id, 8, 3) AS label FROM v_customers) r USING (id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return inc.catalog_merge(inc.distinct_scopes(views.incidents(spark, d), "tenant_id"), retail_tenants(spark, d))


_ALLOWED = ", ".join(f"('{a}', '{x}')" for a, xs in inc.ALLOWED_ACTIONS.items() for x in xs)


@query("remediation_allowlist", "J15", f"""
    SELECT incident_id, adapter, action, explanation, risk, allowed AND complete AS valid,
      CASE WHEN NOT allowed THEN 'Action ''' || action || ''' is not allowed for adapter ''' || adapter || ''''
           WHEN NOT complete THEN 'Missing explanation or risk fields' ELSE '' END AS reason
    FROM (SELECT p.*, a.x IS NOT NULL AS allowed, coalesce(explanation, '') <> '' AND coalesce(risk, '') <> '' AS complete
          FROM v_proposed p LEFT JOIN (VALUES {_ALLOWED}) a(a, x) ON p.adapter = a.a AND p.action = a.x)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return inc.remediation_allowlist(views.proposed_actions(spark, d))


@query("incident_owner_check", "J16", """
    SELECT c.event_id, c.incident_id, c.tenant_id, c.platform_id, i.incident_id IS NOT NULL AS found
    FROM v_incident_changes c LEFT JOIN v_incidents i USING (incident_id, tenant_id, platform_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    requests = views.incident_changes(spark, d).select("event_id", "incident_id", "tenant_id", "platform_id")
    return inc.incident_owner_check(requests, views.incidents(spark, d))


# --- A, G, T, U ------------------------------------------------------------------------------------------------------


@query("incident_kpis", "A6", f"""
    SELECT tenant_id, platform_id, count(*) AS total_incidents, count(*) FILTER (s NOT IN ('RESOLVED', 'REJECTED', 'ESCALATED')) AS open_incidents,
      count(*) FILTER (s = 'INVESTIGATING') AS investigating, count(*) FILTER (s = 'AWAITING_APPROVAL') AS awaiting_approval,
      count(*) FILTER (s = 'REMEDIATING') AS remediating, count(*) FILTER (s = 'RESOLVED') AS resolved, count(*) FILTER (s = 'ESCALATED') AS escalated
    FROM (SELECT *, {EFFECTIVE} AS s FROM v_incidents) GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return inc.incident_kpis(views.incidents(spark, d))


@query("resolution_ratio", "A7", f"""
    SELECT tenant_id, platform_id, pipeline, count(*) FILTER (s = 'RESOLVED') AS resolved, count(*) AS returned,
      round(100.0::DOUBLE * count(*) FILTER (s = 'RESOLVED') / count(*), 4) AS health
    FROM (SELECT *, {EFFECTIVE} AS s FROM v_incidents) WHERE pipeline <> '' GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return inc.resolution_ratio(views.incidents(spark, d))


@query("distinct_scopes", "A8", f"""
    SELECT DISTINCT platform_id AS id, CASE WHEN platform_id = 'SPARK' THEN 'Spark cluster' ELSE {_LABEL.format('platform_id')} END AS label FROM v_incidents""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = views.incidents(spark, d)
    labels = rows.filter("platform_id = 'SPARK'").select(F.col("platform_id").alias("id"), F.lit("Spark cluster").alias("label")).distinct()
    return inc.distinct_scopes(rows, "platform_id", labels)


def _latest_sql(view: str, tie: str, columns: str) -> str:
    return f"SELECT {columns} FROM {view} QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY created_at DESC, {tie} DESC) = 1"


@query("latest_diagnosis", "G4", _latest_sql("v_diagnoses", "diagnosis_id", "incident_id, diagnosis_id, root_cause, confidence, created_at"))
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = inc.latest_per(views.diagnoses(spark, d), "incident_id", "created_at", "diagnosis_id")
    return rows.select("incident_id", "diagnosis_id", "root_cause", "confidence", "created_at")


@query("latest_plan", "G4", _latest_sql("v_plans", "plan_id", "incident_id, plan_id, actions, created_at"))
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = inc.latest_per(views.plans(spark, d), "incident_id", "created_at", "plan_id")
    return rows.select("incident_id", "plan_id", "actions", "created_at")


@query("incident_sort_modes", "T3", """
    SELECT 'Severity' AS mode, incident_id, CAST(CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END AS VARCHAR) AS sorted_by FROM v_incidents
    UNION ALL SELECT 'Incident ID', incident_id, incident_id FROM v_incidents
    UNION ALL SELECT 'Pipeline', incident_id, lower(pipeline) FROM v_incidents
    UNION ALL SELECT 'Oldest first', incident_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') FROM v_incidents
    UNION ALL SELECT 'Newest first', incident_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') FROM v_incidents""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = views.incidents(spark, d)
    stamp = F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")
    shown = {
        "Severity": text.severity_rank("severity").cast("string"), "Incident ID": F.col("incident_id"), "Pipeline": F.lower("pipeline"),
        "Oldest first": stamp, "Newest first": stamp,
    }
    return views.union_all([
        inc.sort_incidents(rows, mode).select(F.lit(mode).alias("mode"), "incident_id", key.alias("sorted_by")) for mode, key in shown.items()
    ])


@query("recent_incidents", "T4", f"SELECT {INCIDENT} FROM v_incidents ORDER BY created_at DESC, incident_id DESC LIMIT 50 OFFSET 50")
def _(spark: SparkSession, d: str) -> DataFrame:
    return inc.recent_incidents(views.incidents(spark, d), offset=50)


@query("related_incidents", "T4", """
    SELECT i.tenant_id, i.platform_id, i.incident_id, n.incident_id AS related_id, n.problem AS summary, n.created_at AS detected_at
    FROM v_incidents i JOIN (SELECT * FROM v_incidents
      QUALIFY row_number() OVER (PARTITION BY tenant_id, platform_id ORDER BY created_at DESC, incident_id DESC) <= 5) n USING (tenant_id, platform_id)
    WHERE i.incident_id <> n.incident_id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return inc.related_incidents(views.incidents(spark, d), shared_dir(spark, "newest"))


@query("chronological", "T5", """
    SELECT event_id, CASE k % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL 2 HOURS WHEN 2 THEN date_trunc('second', ts) END AS instant
    FROM v_telemetry""")
def _(spark: SparkSession, d: str) -> DataFrame:
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    written = F.when(F.expr("k % 4 = 0"), F.concat(iso, F.lit("Z"))).when(F.expr("k % 4 = 1"), F.concat(iso, F.lit("+02:00")))
    written = written.when(F.expr("k % 4 = 2"), iso).otherwise(F.lit("bad"))
    rows = views.telemetry_events(spark, d).select("event_id", written.alias("written"))
    return inc.chronological(rows, "written", "event_id").select("event_id", "instant")


@query("log_tail", "T6", """
    SELECT tenant_id, dataset, string_agg(message, '|' ORDER BY ts, event_id) FILTER (message <> '') AS logs,
      coalesce(arg_max(message, (ts, event_id)) FILTER (message <> ''), '') AS error_message
    FROM (SELECT * FROM v_telemetry WHERE ts >= TIMESTAMP '2024-01-05'
          QUALIFY row_number() OVER (PARTITION BY tenant_id, dataset ORDER BY ts DESC, event_id DESC) <= 200) GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    lines = views.telemetry_events(spark, d).filter(F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz"))
    return inc.log_tail(lines, ["tenant_id", "dataset"]).select("tenant_id", "dataset", F.array_join("logs", "|").alias("logs"), "error_message")


@query("array_tails", "T7", """
    SELECT incident_id, array_to_string(logs[-100:], '|') AS last_100, array_to_string(logs[-10:], '|') AS last_10, array_to_string(logs[:20], '|') AS first_20 FROM v_texts""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return views.incident_texts(spark, d).select(
        "incident_id", F.array_join(text.last_items("logs", 100), "|").alias("last_100"),
        F.array_join(text.last_items("logs", 10), "|").alias("last_10"), F.array_join(text.first_items("logs", 20), "|").alias("first_20"),
    )


@query("incident_timeline", "U1", """
    SELECT incident_id, 0 AS position, 'Detected' AS label, problem AS message, created_at AS at FROM v_incidents
    UNION ALL SELECT incident_id, 1, 'Current status', status, updated_at FROM v_incidents
    UNION ALL SELECT incident_id, event_id + 2, agent || ': ' || event_type, '', created_at FROM v_agent_events SEMI JOIN v_incidents USING (incident_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return inc.incident_timeline(views.incidents(spark, d), views.agent_events(spark, d))


# --- C: scalars ------------------------------------------------------------------------------------------------------


@query("normalize_severity", "C4", f"SELECT incident_id, {SEVERITY} AS severity FROM v_incidents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return views.incidents(spark, d).select("incident_id", text.normalize_severity("severity").alias("severity"))


@query("first_non_blank", "C5", """
    SELECT event_id, CASE WHEN k % 3 <> 0 THEN 'ALERTS' WHEN k % 2 = 0 THEN 'k' || k ELSE 'UNKNOWN' END AS chosen FROM (SELECT *, CAST(substr(problem, 8) AS INTEGER) AS k FROM v_incident_changes)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.substring("problem", 8, 5).cast("int")
    other = F.when(k % 2 == 0, F.concat(F.lit(" k"), k, F.lit("\t"))).otherwise(F.lit(" \n "))
    return views.incident_changes(spark, d).select("event_id", text.first_non_blank("source", F.lit(None).cast("string"), other, default="UNKNOWN").alias("chosen"))


@query("strip_log_keys", "C6", """
    SELECT 'INC-' || conv_id AS incident_id, turn AS position, '{"id":' || conv_id || ',"deep":[{"role":"' || role || '"}]}' AS cleaned, role AS kept FROM conversations""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = views.incident_logs(spark, d)
    payload = F.to_json(F.struct(
        F.substring("incident_id", 5, 20).cast("bigint").alias("id"), F.col("message").alias("LOGS"),
        F.array(F.struct(F.col("source").alias("role"), F.col("message").alias("raw_logs"))).alias("deep"),
    ))
    flat = F.create_map(F.lit("role"), "source", F.lit("Log_Entries"), "message")
    return rows.select(
        "incident_id", F.col("position").cast("bigint").alias("position"), nested_json.strip_log_keys_json(payload).alias("cleaned"),
        F.array_join(F.map_values(nested_json.strip_log_keys_map(flat)), "|").alias("kept"),
    )


@query("normalize_outcome", "C7", """
    SELECT incident_id, CASE WHEN upper(trim(outcome)) IN ('PASSED', 'PASS', 'SUCCESS', 'SUCCEEDED') THEN 'PASSED'
      WHEN upper(trim(outcome)) IN ('FAILED', 'FAIL', 'ERROR') THEN 'FAILED' ELSE '' END AS outcome FROM v_payloads""")
def _(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.get_json_object("failure_payload", "$.outcome")
    return views.incident_payloads(spark, d).select("incident_id", text.normalize_outcome(outcome).alias("outcome"))


@query("humanize", "C8", f"SELECT incident_id, {_LABEL.format('status')} AS label FROM v_incidents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return views.incidents(spark, d).select("incident_id", text.humanize("status").alias("label"))


@query("run_id_fields", "C9", """
    SELECT event_id, k % 3 <> 2 AS valid, CASE WHEN k % 3 = 0 THEN date_trunc('second', ts) END AS started_at FROM v_telemetry""")
def _(spark: SparkSession, d: str) -> DataFrame:
    real = F.concat(F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_"), F.lpad(F.hex("k"), 6, "0"))
    run_id = F.when(F.expr("k % 3 = 0"), F.lower(real)).when(F.expr("k % 3 = 1"), F.lit("20241399_250000_00ff00")).otherwise(F.upper(F.concat(real, F.lit("G"))))
    rows = views.telemetry_events(spark, d).select("event_id", run_id.alias("id"))
    return rows.select("event_id", text.run_id_is_valid("id").alias("valid"), text.run_started_at("id").alias("started_at"))


@query("incident_id_for_run", "C10", "SELECT workflow_run_id, 'INC-' || upper(substr(workflow_run_id, 1, 8)) AS incident_id FROM v_runs")
def _(spark: SparkSession, d: str) -> DataFrame:
    return views.workflow_runs(spark, d).select("workflow_run_id", text.incident_id_for_run("workflow_run_id").alias("incident_id"))


@query("stage_duration", "C11", """
    SELECT workflow_run_id, CASE WHEN completed_at IS NOT NULL THEN greatest(0.0, (epoch_us(completed_at) - epoch_us(deadline_at)) / 1000000.0) END AS seconds FROM v_runs""")
def _(spark: SparkSession, d: str) -> DataFrame:
    runs = views.workflow_runs(spark, d)
    seconds = F.when(F.col("completed_at").isNotNull(), text.stage_duration("deadline_at", "completed_at"))
    return runs.select("workflow_run_id", seconds.alias("seconds"))


@query("clamp_confidence", "C12", "SELECT diagnosis_id, greatest(0.0, least(1.0, confidence)) AS confidence FROM v_diagnoses")
def _(spark: SparkSession, d: str) -> DataFrame:
    return views.diagnoses(spark, d).select("diagnosis_id", text.clamp01("confidence").alias("confidence"))


@query("confidence_evidence_rule", "C13", "SELECT diagnosis_id, incident_id, confidence FROM v_diagnoses WHERE confidence >= 0.7 AND no_evidence")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = views.diagnoses(spark, d)
    return rows.filter(text.confident_without_evidence("confidence", "evidence")).select("diagnosis_id", "incident_id", "confidence")


@query("incident_query_text", "C14", """
    SELECT incident_id, concat_ws(chr(10), 'Pipeline: ' || pipeline, 'Adapter: ' || adapter, 'Failed stage: ' || coalesce(failed_stage, 'unknown'),
      'Failed task: ' || coalesce(failed_task, 'unknown'), 'Error: ' || error_message, 'Logs:', array_to_string(logs[-10:], chr(10)),
      'Details: source=' || source || ', chars=' || n_chars) AS query_text FROM v_texts""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return views.incident_texts(spark, d).select("incident_id", text.similarity_query_text().alias("query_text"))


@query("incident_document", "C14", """
    SELECT incident_id, concat_ws(chr(10) || chr(10), 'Pipeline: ' || pipeline, 'Adapter: ' || adapter, 'Failed stage: ' || coalesce(failed_stage, 'unknown'),
      'Error:' || chr(10) || error_message, 'Logs:' || chr(10) || CASE WHEN text = '' THEN '(none)' ELSE text END,
      'Details:' || chr(10) || 'source=' || source || chr(10) || 'chars=' || n_chars,
      'Diagnosis:' || chr(10) || root_cause || ' (failure location: ' || failure_location || ')',
      CASE WHEN has_remedies THEN 'Recommended remediation:' || chr(10) || 'retry_pipeline; repair_input_path' END) AS document FROM v_texts""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return views.incident_texts(spark, d).select("incident_id", text.memory_document().alias("document"))


_WS = " || ".join(f"chr({ord(c)})" for c in text.WHITESPACE)


@query("normalize_log_lines", "C15", f"""
    SELECT incident_id, array_to_string([trim(x, {_WS}) FOR x IN logs IF trim(x, {_WS}) <> ''], '|') AS lines FROM v_texts""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return views.incident_texts(spark, d).select("incident_id", F.array_join(text.non_blank_lines("logs"), "|").alias("lines"))


@query("effective_status", "C17", f"SELECT incident_id, {EFFECTIVE} AS status FROM v_incidents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return views.incidents(spark, d).select("incident_id", text.effective_status("status", "recovery_confirmed").alias("status"))


@query("progress_flags", "C18", """
    SELECT incident_id, status IN ('DIAGNOSED', 'REMEDIATION_PROPOSED', 'AWAITING_APPROVAL', 'REMEDIATING', 'VALIDATING', 'RESOLVED', 'REJECTED', 'ESCALATED') AS diagnosis_ready,
      CASE WHEN status IN ('VALIDATING', 'RESOLVED') THEN 'Succeeded' WHEN status = 'ESCALATED' THEN 'Failed' ELSE 'Not started' END AS progress,
      CASE WHEN status IN ('RESOLVED', 'ESCALATED') THEN status ELSE '' END AS outcome, status = 'RESOLVED' AS recovered FROM v_incidents""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return views.incidents(spark, d).select(
        "incident_id", text.diagnosis_ready("status").alias("diagnosis_ready"), text.execution_progress("status").alias("progress"),
        text.recovery_outcome("status").alias("outcome"), (F.col("status") == "RESOLVED").alias("recovered"),
    )


@query("resolve_adapter", "C19", "SELECT workflow_run_id, 'spark' AS adapter FROM v_runs UNION ALL SELECT incident_id, lower(platform_id) FROM v_incidents")
def _(spark: SparkSession, d: str) -> DataFrame:
    runs = views.workflow_runs(spark, d).select("workflow_run_id", text.resolve_adapter("platform_id").alias("adapter"))
    return runs.union(views.incidents(spark, d).select("incident_id", text.resolve_adapter("platform_id")))


@query("flatten_run_history", "C20", f"""
    SELECT i.incident_id, pipeline, status, created_at, coalesce(trim(outcome), '') AS outcome, coalesce(failure_location, '') AS failure_location,
      coalesce(root_cause, '') AS root_cause, CASE WHEN p.k IS NULL THEN '' ELSE array_to_string(['line ' || x FOR x IN generate_series(1, least(p.k % 30 + 1, 20))], '|') END AS recent_logs,
      CASE WHEN p.k IS NULL THEN '' ELSE 'retry_pipeline,again,P1,low|act_' || p.k || ',,P2,high' END AS remedies,
      CASE WHEN p.k IS NULL THEN '' ELSE 'see log' END AS message_for_ui
    FROM v_incidents i LEFT JOIN v_payloads p USING (incident_id) WHERE i.source = 'PIPELINE_RUN'""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = inc.flatten_run_history(views.incidents(spark, d), views.incident_payloads(spark, d))
    shown = F.transform("remedies", lambda r: F.concat_ws(",", r["action"], r["explanation"], r["priority"], r["risk"]))
    return rows.withColumns({"recent_logs": F.array_join("recent_logs", "|"), "remedies": F.array_join(shown, "|")})


@query("normalize_log_entries", "C21", """
    SELECT event_id, 0 AS position, 'T' || event_id AS timestamp, CASE WHEN k % 2 = 0 THEN level ELSE 'UNKNOWN' END AS level, '' AS source, message,
      '{"run":"' || run_id || '"}' AS fields_json FROM v_telemetry
    UNION ALL SELECT event_id, 1, '', 'UNKNOWN', stage, '', '{}' FROM v_telemetry""")
def _(spark: SparkSession, d: str) -> DataFrame:
    def q(name: str) -> str:
        return f"'\"', {name}, '\"'"

    body = F.expr(f"""concat('[', CASE WHEN k % 2 = 0
        THEN concat('{{"timestamp":"T', event_id, '","level":', {q('level')}, ',"message":', {q('message')}, ',"fields":{{"run":', {q('run_id')}, '}}}}')
        ELSE concat('{{"created_at":"T', event_id, '","message":', {q('message')}, ',"attributes":{{"run":', {q('run_id')}, '}}}}') END,
        ',{{"source":', {q('stage')}, '}}]')""")
    return inc.normalize_log_entries(views.telemetry_events(spark, d).select("event_id", body.alias("body")), "body", "event_id")


@query("incident_summary_text", "C22", """
    SELECT incident_id, 'The ' || adapter || ' pipeline failed during ' || failure_location || '. The most probable cause is ' || coalesce(root_cause, 'unknown') || '.' AS summary FROM v_texts""")
def _(spark: SparkSession, d: str) -> DataFrame:
    cause = F.coalesce("root_cause", F.lit("unknown"))
    return views.incident_texts(spark, d).select("incident_id", text.incident_summary("adapter", "failure_location", cause).alias("summary"))


# --- I: change sets --------------------------------------------------------------------------------------------------

_LASTF = "arg_max({0}, (changed_at, event_id))"
_CHANGED = f"""SELECT incident_id, {', '.join(_LASTF.format(c) + ' AS ' + c for c in ('tenant_id', 'platform_id', 'pipeline', 'severity', 'problem', 'failure_payload'))},
  coalesce(arg_max(source, (changed_at, event_id)) FILTER (source <> ''), '') AS source, min(changed_at) AS first_at, max(changed_at) AS last_at
  FROM v_incident_changes GROUP BY 1"""
_SEV = SEVERITY.replace("severity", "c.severity")
_UPSERT = f"""
    SELECT incident_id, CASE WHEN n THEN c.tenant_id ELSE b.tenant_id END AS tenant_id, CASE WHEN n THEN c.platform_id ELSE b.platform_id END AS platform_id,
      CASE WHEN n THEN c.pipeline ELSE b.pipeline END AS pipeline, CASE WHEN n THEN {_SEV} ELSE b.severity END AS severity,
      CASE WHEN n THEN 'DETECTED' ELSE b.status END AS status, CASE WHEN n THEN c.problem ELSE b.problem END AS problem,
      coalesce(nullif(c.source, ''), b.source, '') AS source, coalesce(b.created_at, first_at) AS created_at, coalesce(last_at, b.updated_at) AS updated_at,
      CASE WHEN n THEN c.failure_payload WHEN p.incident_id IS NOT NULL THEN 'recorded' ELSE '{{}}' END AS failure_payload, '{{}}' AS agent_result_payload
    FROM v_incidents b FULL JOIN (SELECT *, true AS n FROM ({_CHANGED})) c USING (incident_id) LEFT JOIN v_payloads p USING (incident_id)"""


def short_payload(rows: DataFrame) -> DataFrame:
    """Long recorded payloads as one word; their content is compared in ``flatten_run_history``."""
    return rows.withColumn("failure_payload", F.when(F.length("failure_payload") > 20, "recorded").otherwise(F.col("failure_payload")))


@query("upsert_failures", "I1", _UPSERT)
def _(spark: SparkSession, d: str) -> DataFrame:
    base = views.incidents(spark, d).drop("recovery_confirmed")
    return short_payload(inc.upsert_failures(base, views.incident_payloads(spark, d), views.incident_changes(spark, d)))


@query("incident_from_run", "I2", """
    SELECT incident_id, coalesce(b.tenant_id, c.tenant_id) AS tenant_id, coalesce(b.platform_id, c.platform_id) AS platform_id, coalesce(b.pipeline, c.pipeline) AS pipeline,
      CASE WHEN last_at IS NULL THEN severity WHEN o = 'FAILED' THEN 'HIGH' ELSE 'LOW' END AS severity,
      CASE WHEN last_at IS NULL THEN status WHEN o = 'FAILED' THEN 'DETECTED' ELSE 'RESOLVED' END AS status,
      coalesce(c.details, b.problem, CASE WHEN fo = 'FAILED' THEN 'Pipeline run failed' ELSE 'Pipeline run succeeded' END) AS problem,
      coalesce(source, 'PIPELINE_RUN') AS source, coalesce(created_at, first_at) AS created_at, coalesce(last_at, updated_at) AS updated_at
    FROM v_incidents b FULL JOIN (SELECT incident_id, arg_min(tenant_id, (changed_at, event_id)) AS tenant_id, arg_min(platform_id, (changed_at, event_id)) AS platform_id,
        arg_min(pipeline, (changed_at, event_id)) AS pipeline, arg_min(outcome, (changed_at, event_id)) AS fo, arg_max(outcome, (changed_at, event_id)) AS o,
        arg_max(details, (changed_at, event_id)) FILTER (details <> '') AS details, min(changed_at) AS first_at, max(changed_at) AS last_at
      FROM v_run_outcomes GROUP BY 1) c USING (incident_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return inc.incidents_from_runs(views.incidents(spark, d), views.run_outcomes(spark, d))


@query("apply_agent_results", "I3", """
    SELECT i.* EXCLUDE (event_id, user_id, k) REPLACE (CASE WHEN o = 'FAILED' THEN 'ESCALATED' WHEN o IS NOT NULL THEN 'VALIDATING' ELSE status END AS status,
      coalesce(last_at, updated_at) AS updated_at), r AS agent_result
    FROM v_incidents i LEFT JOIN (SELECT incident_id, bool_or(outcome <> 'FAILED' AND validated_resolved) AS gone, arg_max(outcome, (changed_at, event_id)) AS o,
      arg_max(result, (changed_at, event_id)) AS r, max(changed_at) AS last_at FROM v_agent_results GROUP BY 1) USING (incident_id)
    WHERE NOT coalesce(gone, false)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return inc.apply_agent_results(views.incidents(spark, d), views.agent_results(spark, d))


@query("apply_status_changes", "I4", """
    SELECT i.* EXCLUDE (event_id, user_id, k) REPLACE (coalesce(s, status) AS status, coalesce(last_at, updated_at) AS updated_at), g AS diagnosis
    FROM v_incidents i LEFT JOIN (SELECT incident_id, arg_max(status, (changed_at, event_id)) AS s, max(changed_at) AS last_at,
      arg_max(diagnosis, (changed_at, event_id)) FILTER (diagnosis IS NOT NULL) AS g FROM v_status_changes GROUP BY 1) USING (incident_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return inc.apply_status_changes(views.incidents(spark, d), views.status_changes(spark, d))


_RESULTS = """(SELECT incident_id, bool_or(outcome <> 'FAILED' AND validated_resolved) AS gone, arg_max(outcome, (changed_at, event_id)) AS o,
      arg_max(result, (changed_at, event_id)) AS r FROM v_agent_results SEMI JOIN v_incidents USING (incident_id) GROUP BY 1)"""
_DIAGNOSES = """(SELECT incident_id, arg_max(diagnosis, (changed_at, event_id)) AS g FROM v_status_changes SEMI JOIN v_incidents USING (incident_id)
      WHERE diagnosis IS NOT NULL GROUP BY 1)"""


def payload_fields(payloads: DataFrame) -> DataFrame:
    """What a payload says, apart from the order of its JSON keys."""
    return payloads.select(
        "incident_id", F.get_json_object("failure_payload", "$.outcome").alias("outcome"),
        F.coalesce(F.get_json_object("failure_payload", "$.diagnosis.root_cause"), F.get_json_object("failure_payload", "$.diagnosis")).alias("diagnosis"),
        F.get_json_object("agent_result_payload", "$.outcome").alias("agent_outcome"), F.get_json_object("agent_result_payload", "$.result").alias("agent_result"))


@query("agent_result_payloads", "I3", f"""
    SELECT incident_id, outcome, CASE WHEN p.user_id IS NOT NULL THEN ' cause ' || user_id || ' ' END AS diagnosis, o AS agent_outcome, r AS agent_result
    FROM v_payloads p FULL JOIN {_RESULTS} USING (incident_id) WHERE NOT coalesce(gone, false)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return payload_fields(inc.payloads_after_results(views.incident_payloads(spark, d), views.incidents(spark, d), views.agent_results(spark, d)))


@query("diagnosis_payloads", "I4", f"""
    SELECT incident_id, outcome, coalesce(g, CASE WHEN p.user_id IS NOT NULL THEN ' cause ' || user_id || ' ' END) AS diagnosis,
      CAST(NULL AS VARCHAR) AS agent_outcome, CAST(NULL AS VARCHAR) AS agent_result
    FROM v_payloads p FULL JOIN {_DIAGNOSES} USING (incident_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return payload_fields(inc.payloads_after_status(views.incident_payloads(spark, d), views.incidents(spark, d), views.status_changes(spark, d)))


@query("bucketed_incident_merge", "I3 I4", f"""
    SELECT i.incident_id, i.tenant_id, coalesce(s, CASE WHEN o = 'FAILED' THEN 'ESCALATED' WHEN o IS NOT NULL THEN 'VALIDATING' ELSE status END) AS status,
      coalesce(last_change, last_result, i.updated_at) AS updated_at, outcome,
      coalesce(g, CASE WHEN p.user_id IS NOT NULL THEN ' cause ' || p.user_id || ' ' END) AS diagnosis, o AS agent_outcome, r AS agent_result
    FROM v_incidents i LEFT JOIN (SELECT incident_id, max(changed_at) AS last_result FROM v_agent_results GROUP BY 1) USING (incident_id)
    LEFT JOIN {_RESULTS} USING (incident_id) LEFT JOIN (SELECT incident_id, arg_max(status, (changed_at, event_id)) AS s, max(changed_at) AS last_change
      FROM v_status_changes GROUP BY 1) USING (incident_id)
    LEFT JOIN {_DIAGNOSES} USING (incident_id) LEFT JOIN v_payloads p USING (incident_id) WHERE NOT coalesce(gone, false)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Agent results and then status changes as two change sets on bucketed incident and payload tables."""
    base, payloads = views.incidents(spark, d), views.incident_payloads(spark, d)
    root = shared_dir(spark, "incidents")
    rows = KeyedTable(f"{root}/incidents", base.schema, "incident_id").create(base)
    texts = KeyedTable(f"{root}/payloads", payloads.schema, "incident_id").create(payloads)
    results, changes = views.agent_results(spark, d), views.status_changes(spark, d)
    rows, texts = merge_both(rows, texts, results, lambda i, p: inc.apply_agent_results(i, results), lambda i, p: inc.payloads_after_results(p, i, results))
    rows, texts = merge_both(rows, texts, changes, lambda i, p: inc.apply_status_changes(i, changes), lambda i, p: inc.payloads_after_status(p, i, changes))
    return rows.read(spark).select("incident_id", "tenant_id", "status", "updated_at").join(
        payload_fields(texts.read(spark)), "incident_id", "left")


@query("apply_plan_decisions", "I5", """
    SELECT p.* REPLACE (CASE WHEN approved THEN 'APPROVED' WHEN NOT approved THEN 'REJECTED' ELSE approval_status END AS approval_status),
      decided_by AS approved_by, decided_at AS approved_at
    FROM v_plans p LEFT JOIN (SELECT plan_id, approved, decided_by, decided_at FROM
      (SELECT * FROM v_plans QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY created_at DESC, plan_id DESC) = 1)
      JOIN (SELECT * FROM v_plan_decisions QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY decided_at DESC, event_id DESC) = 1) USING (incident_id)) USING (plan_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return inc.apply_plan_decisions(views.plans(spark, d), views.plan_decisions(spark, d))


@query("idempotent_run_insert", "I6", """
    SELECT * FROM v_runs WHERE idempotency_key IS NULL
    UNION ALL (SELECT * FROM v_runs WHERE idempotency_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY started_at, workflow_run_id) = 1)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return inc.idempotent_run_insert(views.workflow_runs(spark, d))


@query("run_state_counts", "I7", "SELECT state, current_agent, count(*) AS n_runs FROM v_runs GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return inc.run_state_counts(views.workflow_runs(spark, d))


# --- N: memory -------------------------------------------------------------------------------------------------------


@query("similar_incidents", "N1", """
    SELECT tenant_id, query_id, incident_id, adapter, pipeline, root_cause, similarity FROM (
      SELECT *, round(greatest(0.0, least(1.0, 1.0 - distance)), 4) AS similarity FROM (
        SELECT q.tenant_id, q.incident_id AS query_id, q.adapter AS wanted, m.incident_id, m.adapter, m.pipeline, m.root_cause,
          round(1.0 - list_cosine_similarity(q.embedding, m.embedding), 9) AS distance
        FROM v_memory q JOIN v_memory m USING (tenant_id))
      QUALIFY row_number() OVER (PARTITION BY tenant_id, query_id ORDER BY distance, incident_id) <= 15)
    QUALIFY row_number() OVER (PARTITION BY tenant_id, query_id ORDER BY adapter = wanted DESC, similarity DESC, distance, incident_id) <= 5""")
def _(spark: SparkSession, d: str) -> DataFrame:
    memory = views.incident_memory(spark, d)
    queries = memory.select("tenant_id", F.col("incident_id").alias("query_id"), "adapter", "embedding")
    return sim.similar_incidents(queries, memory)


@query("memory_upsert", "N2", """
    SELECT tenant_id, incident_id, document, 'status=' || status || ',value=' || value AS metadata, written_at FROM v_memory_writes
    QUALIFY row_number() OVER (PARTITION BY tenant_id, incident_id ORDER BY written_at DESC, event_id DESC) = 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = sim.memory_upsert(views.memory_writes(spark, d))
    return rows.select("tenant_id", "incident_id", "document", text.key_value_pairs("metadata", ",").alias("metadata"), "written_at")


@query("memory_get", "N3", """
    SELECT tenant_id, incident_id, adapter, root_cause FROM v_memory SEMI JOIN (SELECT 'tenant_00' || (doc_id % 3 + 1) AS tenant_id, 'INC-' || doc_id AS incident_id FROM documents) USING (tenant_id, incident_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    wanted = views.incident_texts(spark, d).select("tenant_id", "incident_id")
    return sim.memory_get(views.incident_memory(spark, d), wanted).select("tenant_id", "incident_id", "adapter", "root_cause")


def _scan_sql(patterns: dict[str, tuple[str, ...]]) -> str:
    parts = []
    for name, words in patterns.items():
        hits = " + ".join(f"CAST(contains(lower(body), '{w.lower()}') AS INTEGER)" for w in words)
        parts.append(f"SELECT tenant_id, incident_id, '{name}' AS pattern, {hits} AS hits, round(({hits}) / {len(words)}, 4) AS hit_ratio FROM bodies")
    return f"""SELECT * FROM (WITH bodies AS (SELECT tenant_id, incident_id, error_message || chr(10) || text AS body FROM v_texts)
      {' UNION ALL '.join(parts)}) WHERE hits > 0"""


ALL_PATTERNS = {**TEXT_PATTERNS, **sim.FAILURE_PATTERNS["spark"], **sim.FAILURE_PATTERNS["synapse"]}


@query("failure_pattern_scan", "N4", _scan_sql(ALL_PATTERNS))
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = views.incident_texts(spark, d).withColumn("body", F.concat_ws("\n", "error_message", "text"))
    return sim.failure_pattern_scan(rows, "body", ALL_PATTERNS)


# --- W6: the upsert as a stream --------------------------------------------------------------------------------------


@query("stream_incident_upsert", "W6", _UPSERT)
def _(spark: SparkSession, d: str) -> DataFrame:
    changes = views.as_changes(views.with_k(stream(spark, d, "events")))
    base = views.incidents(spark, d).drop("recovery_confirmed")
    return short_payload(jobs.incident_upsert(changes, base, views.incident_payloads(spark, d), shared_dir(spark, "stream-upsert")))
