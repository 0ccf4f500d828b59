"""Incident change sets against the row-by-row procedure, and the smaller incident rules."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tallylake.functions import nested_json, text
from tallylake.operators import incidents as inc

T0 = datetime(2026, 1, 1)
BASE = "incident_id string, tenant_id string, platform_id string, pipeline string, severity string, status string, problem string, source string, created_at timestamp_ntz, updated_at timestamp_ntz"
CHANGE = "event_id bigint, incident_id string, tenant_id string, platform_id string, pipeline string, severity string, problem string, source string, failure_payload string, changed_at timestamp_ntz"
OUTCOME = "event_id bigint, incident_id string, tenant_id string, platform_id string, pipeline string, outcome string, details string, changed_at timestamp_ntz"
RESULT = "event_id bigint, incident_id string, outcome string, validated_resolved boolean, result string, changed_at timestamp_ntz"


def base_rows(rng):
    return [(f"i{n}", "t", "SPARK", "p", "LOW", rng.choice(["DIAGNOSED", "RESOLVED"]), "old", rng.choice(["A", ""]), T0, T0) for n in range(6)]


def test_upsert_equals_row_by_row(spark):
    rng = random.Random(1)
    base = base_rows(rng)
    changes = [
        (e, f"i{rng.randrange(12)}", f"t{rng.randrange(3)}", "SYN", f"p{e}", rng.choice([" high", "odd", "LOW"]), f"c{e}", rng.choice(["", " ", "B", "C"]), f"f{e}",
         T0 + timedelta(minutes=rng.randrange(20)))
        for e in range(60)
    ]
    table = {r[0]: dict(zip([f.split()[0] for f in BASE.split(", ")], r)) | {"failure_payload": "{}", "agent_result_payload": "{}"} for r in base}
    table["i0"]["agent_result_payload"] = "done"
    for e, i, tenant, platform, pipeline, severity, problem, source, payload, at in sorted(changes, key=lambda c: (c[-1], c[0])):
        row = table.setdefault(i, {"incident_id": i, "created_at": at, "source": ""})
        clean = severity.strip().upper()
        row |= {"tenant_id": tenant, "platform_id": platform, "pipeline": pipeline, "problem": problem, "status": "DETECTED", "updated_at": at,
                "severity": clean if clean in text.SEVERITY_RANK else "MEDIUM", "source": source if source.strip() else row["source"],
                "failure_payload": payload, "agent_result_payload": "{}"}
    payloads = spark.createDataFrame([("i0", "{}", "done")], "incident_id string, failure_payload string, agent_result_payload string")
    got = inc.upsert_failures(spark.createDataFrame(base, BASE), payloads, spark.createDataFrame(changes, CHANGE))
    assert {r.incident_id: r.asDict() for r in got.collect()} == table
    # the same in three batches through reduced rows
    parts = [inc.reduce_failures(spark.createDataFrame(changes[n::3], CHANGE)).withColumn("batch_id", F.lit(n)) for n in range(3)]
    merged = inc.combine_reduced(parts[0].union(parts[1]).union(parts[2]), "batch_id")
    twice = inc.merge_reduced_failures(spark.createDataFrame(base, BASE), payloads, merged)
    same = ("created_at", "updated_at", "status")
    assert {r.incident_id: tuple(r[c] for c in same) for r in twice.collect()} == {k: tuple(v[c] for c in same) for k, v in table.items()}


def test_run_outcomes_equal_row_by_row(spark):
    rng = random.Random(2)
    base = base_rows(rng)
    outcomes = [(e, f"i{rng.randrange(12)}", f"t{e}", "SYN", f"p{e}", rng.choice(["FAILED", "PASSED"]), rng.choice(["", "d%d" % e]), T0 + timedelta(minutes=rng.randrange(20))) for e in range(40)]
    names = [f.split()[0] for f in BASE.split(", ")]
    table = {r[0]: dict(zip(names, r)) for r in base}
    for e, i, tenant, platform, pipeline, outcome, details, at in sorted(outcomes, key=lambda c: (c[-1], c[0])):
        failed = outcome == "FAILED"
        state = {"severity": "HIGH" if failed else "LOW", "status": "DETECTED" if failed else "RESOLVED", "updated_at": at}
        if i in table:
            table[i] |= state | {"problem": details or table[i]["problem"]}
        else:
            table[i] = {"incident_id": i, "tenant_id": tenant, "platform_id": platform, "pipeline": pipeline, "source": "PIPELINE_RUN", "created_at": at,
                        "problem": details or ("Pipeline run failed" if failed else "Pipeline run succeeded")} | state
    got = inc.incidents_from_runs(spark.createDataFrame(base, BASE), spark.createDataFrame(outcomes, OUTCOME))
    assert {r.incident_id: r.asDict() for r in got.collect()} == table


def test_agent_results_equal_row_by_row(spark):
    rng = random.Random(3)
    base = base_rows(rng)
    results = [(e, f"i{rng.randrange(9)}", rng.choice(["FAILED", "SUCCESS"]), rng.random() < 0.15, f"r{e}", T0 + timedelta(minutes=rng.randrange(20))) for e in range(25)]
    state = {r[0]: (r[5], r[9]) for r in base}
    for _, i, outcome, validated, _, at in sorted(results, key=lambda c: (c[-1], c[0])):
        if i not in state:
            continue
        if outcome == "FAILED":
            state[i] = ("ESCALATED", at)
        elif validated:
            del state[i]
        else:
            state[i] = ("VALIDATING", at)
    got = inc.apply_agent_results(spark.createDataFrame(base, BASE), spark.createDataFrame(results, RESULT))
    assert {r.incident_id: (r.status, r.updated_at) for r in got.collect()} == state


def test_idempotent_insert_keeps_keyless_runs(spark):
    runs = [("a", "k", 1), ("b", "k", 0), ("c", None, 0), ("d", None, 0), ("e", "", 0), ("c", "x", 0)]
    df = spark.createDataFrame(runs, "workflow_run_id string, idempotency_key string, started_at int")
    assert sorted((r.workflow_run_id, r.idempotency_key or "") for r in inc.idempotent_run_insert(df).collect()) == [
        ("b", "k"), ("c", ""), ("c", "x"), ("d", ""), ("e", "")]


def test_chronological(spark):
    rows = [(0, "later", "2026-01-01T10:00:00Z"), (1, "earlier", "2026-01-01T11:00:00+02:00"), (2, "unknown", "bad"), (3, "unknown2", None), (4, "utc", "2026-01-01T09:30:00")]
    df = spark.createDataFrame(rows, "n int, value string, at string")
    assert [r.value for r in inc.chronological(df, "at", "n").collect()] == ["earlier", "utc", "later", "unknown", "unknown2"]


def test_sort_modes(spark):
    rows = [("b", "Zeta", "LOW", 2), ("a", "alpha", "odd", 1), ("c", "Beta", "CRITICAL", 3), ("d", "beta", None, 3)]
    df = spark.createDataFrame(rows, "incident_id string, pipeline string, severity string, created_at int")
    order = {m: "".join(r.incident_id for r in inc.sort_incidents(df, m).collect()) for m in ("Severity", "Incident ID", "Pipeline", "Oldest first", "Newest first", "?")}
    assert order == {"Severity": "cbad", "Incident ID": "abcd", "Pipeline": "acdb", "Oldest first": "abcd", "Newest first": "dcba", "?": "dcba"}


def test_log_tail_limits_before_dropping_blanks(spark):
    df = spark.createDataFrame([("p", n, n, m) for n, m in enumerate(["x", "a", "", "b", ""])], "k string, ts int, event_id int, message string")
    row = inc.log_tail(df, ["k"], 4).first()
    assert (row.logs, row.error_message) == (["a", "b"], "b")
    assert inc.log_tail(df.filter("message = ''"), ["k"]).first()["error_message"] == ""


def test_related_removes_itself_after_the_limit(spark, tmp_path):
    df = spark.createDataFrame([(f"i{n}", "t", "p", "x", n) for n in range(7)], "incident_id string, tenant_id string, platform_id string, problem string, created_at int")
    counts = {r.incident_id: r["count"] for r in inc.related_incidents(df, str(tmp_path)).groupBy("incident_id").count().collect()}
    assert counts == {"i0": 5, "i1": 5, **{f"i{n}": 4 for n in range(2, 7)}}


def test_allowlist(spark):
    rows = [("spark", "retry_pipeline", "e", "r"), ("spark", "delete_production_database", "e", "r"), ("synapse", "handle_data_skew", "e", "r"), ("spark", "retry_pipeline", "", "r"), ("none", "retry_pipeline", "e", "r")]
    got = inc.remediation_allowlist(spark.createDataFrame(rows, "adapter string, action string, explanation string, risk string")).collect()
    assert [r.valid for r in got] == [True, False, False, False, False]
    assert got[1].reason == "Action 'delete_production_database' is not allowed for adapter 'spark'"
    assert got[3].reason == "Missing explanation or risk fields"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_scalars(spark):
    lit = F.lit
    assert [value(spark, text.normalize_severity(lit(x))) for x in (" high\n", None, "x")] == ["HIGH", "MEDIUM", "MEDIUM"]
    assert value(spark, text.first_non_blank(lit(None).cast("string"), lit(" \t"), lit(" a "), default="d")) == "a"
    assert [value(spark, text.humanize(lit(x))) for x in ("tenant_a-WEST", "__", "")] == ["Tenant A West", "__", ""]
    assert [value(spark, text.normalize_outcome(lit(x))) for x in (" succeeded", "error", "odd", None)] == ["PASSED", "FAILED", "", ""]
    assert [value(spark, text.run_id_is_valid(lit(x))) for x in ("20260920_101112_0fada4", "20260920_101112_0FADA4", None)] == [True, False, False]
    assert value(spark, text.run_started_at(lit("20260920_101112_0fada4"))) == datetime(2026, 9, 20, 10, 11, 12)
    assert value(spark, text.run_started_at(lit("20261399_101112_0fada4"))) is None
    assert value(spark, text.stage_duration(lit("2026-01-01 00:00:00"), lit("2026-01-01 00:00:01.23456"))) == 1.2346
    assert value(spark, text.stage_duration(lit("2026-01-02"), lit("2026-01-01"))) == 0.0
    assert [value(spark, text.clamp01(lit(x))) for x in (1.5, -0.1, 0.3, None)] == [1.0, 0.0, 0.3, None]
    assert [value(spark, text.resolve_adapter(lit(x))) for x in (" Synapse", "adf", None)] == ["synapse", "spark", "spark"]
    assert value(spark, text.non_blank_lines(F.array(lit("  padded line  "), lit(""), lit("clean")))) == ["padded line", "clean"]
    assert value(spark, text.last_items(F.array(lit(1), lit(2), lit(3)), 2)) == [2, 3]
    assert value(spark, text.last_items(F.array(lit(1)), 2)) == [1]
    assert [value(spark, text.identifier_is_clean(lit(x))) for x in ("a b", " a", "a\x01", "", None)] == [True, False, False, False, False]
    assert value(spark, text.effective_status(lit("RESOLVED"), lit(None).cast("boolean"))) == "VALIDATING"


def test_query_text_and_document(spark):
    row = spark.sql("""SELECT 'p' AS pipeline, 'spark' AS adapter, '' AS failed_stage, 't' AS failed_task, 'boom' AS error_message, array('a', 'b') AS logs,
        map('k', 'v', 'n', NULL) AS details, 'why' AS root_cause, 'here' AS failure_location, array('x', 'y') AS remedies""")
    got = row.select(text.similarity_query_text(2).alias("q"), text.memory_document().alias("d")).first()
    assert got.q == "Pipeline: p\nAdapter: spark\nFailed stage: unknown\nFailed task: t\nError: boom\nLogs:\na\nb\nDetails: k=v, n=None"
    assert got.d == ("Pipeline: p\n\nAdapter: spark\n\nFailed stage: unknown\n\nError:\nboom\n\nLogs:\na\nb\n\nDetails:\nk=v\nn=None\n\n"
                     "Diagnosis:\nwhy (failure location: here)\n\nRecommended remediation:\nx; y")


def test_strip_log_keys(spark):
    rows = ['{"a":1,"Logs":[1],"b":{"raw_logs":"x","c":[{"LOG":1,"d":"é"}]}}', "no json", None, "[1,2]"]
    df = spark.createDataFrame([(r,) for r in rows], "j string")
    got = [r.v for r in df.select(nested_json.strip_log_keys_json("j").alias("v")).collect()]
    assert got == ['{"a":1,"b":{"c":[{"d":"é"}]}}', "no json", None, "[1,2]"]
