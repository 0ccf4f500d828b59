"""Tables that take change sets, and the payload side of incident changes."""

from __future__ import annotations

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from tallylake.operators import incidents as inc
from tallylake.sources.keyed import KeyedTable, merge_both

ROWS = "incident_id string, status string"


def files(path):
    return {f: (os.path.getmtime(f), os.path.getsize(f)) for f in glob.glob(f"{path}/version=*/bucket=*/*.parquet")}


def test_a_change_set_rewrites_touched_buckets_only(spark, tmp_path):
    rows = spark.range(500).select(F.concat(F.lit("i"), "id").alias("incident_id"), F.lit("old").alias("status"))
    table = KeyedTable(str(tmp_path / "t"), rows.schema, "incident_id", 8).create(rows)
    before = files(table.path)
    changes = spark.createDataFrame([("i7", "new"), ("fresh", "new")], ROWS)

    def apply(part):
        assert 0 < part.count() < 500
        known = part.join(changes.select("incident_id", F.col("status").alias("_to")), "incident_id", "full")
        return known.select("incident_id", F.coalesce("_to", "status").alias("status"))

    after = table.merge(changes, apply)
    assert {f: v for f, v in files(table.path).items() if "/version=0/" in f} == before
    written = {f.split("/")[-2] for f in files(table.path) if "/version=1/" in f}
    assert written == {f"bucket={b}" for b in table.touched(changes)} and len(written) <= 2
    got = {r.incident_id: r.status for r in after.read(spark).collect()}
    assert len(got) == 501 and got["i7"] == got["fresh"] == "new" and got["i8"] == "old"
    assert table.read(spark).count() == 500  # the version before is as it was
    again = table.merge(changes, apply)
    assert again == after and {r.incident_id: r.status for r in again.read(spark).collect()} == got


def test_a_bucket_that_becomes_empty_is_gone(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("b", "x")], ROWS)
    table = KeyedTable(str(tmp_path / "t"), rows.schema, "incident_id", 64).create(rows)
    left = table.merge(rows.where("incident_id = 'a'"), lambda part: part.limit(0))
    assert [r.incident_id for r in left.read(spark).collect()] == ["b"]
    assert left.merge(rows.where("incident_id = 'b'"), lambda part: part.limit(0)).read(spark).isEmpty()
    assert KeyedTable(str(tmp_path / "none"), rows.schema, "incident_id").read(spark).isEmpty()
    with pytest.raises(ValueError):
        merge_both(table, KeyedTable("p", rows.schema, "incident_id", 8), rows, None, None)


@pytest.mark.parametrize("payload", ['{"a": {"b": [1, 2]}, "diagnosis": {"old": 1}, "c": "x\\"y"}', '{"diagnosis": null}', "{}", "no json", "[1]", None, ""])
def test_one_key_of_a_json_object(spark, payload):
    got = spark.createDataFrame([(payload, 'why "so"')], "p string, d string").select(inc.json_with(F.col("p"), "diagnosis", F.col("d"))).first()[0]
    try:
        want = json.loads(payload)
    except (TypeError, ValueError):
        want = {}
    assert json.loads(got) == {**(want if isinstance(want, dict) else {}), "diagnosis": 'why "so"'}


def test_payloads_follow_their_incidents(spark):
    base = spark.createDataFrame([("gone",), ("failed",), ("bare",), ("calm",)], "incident_id string")
    payloads = spark.createDataFrame([(i, json.dumps({"k": i}), "{}") for i in ("gone", "failed", "calm")], "incident_id string, failure_payload string, agent_result_payload string")
    results = spark.createDataFrame(
        [("gone", "SUCCESS", True, "r1", "2024-01-01", 1), ("gone", "FAILED", False, "r2", "2024-01-02", 2), ("failed", "SUCCESS", False, "r3", "2024-01-01", 3),
         ("failed", "FAILED", False, "r4", "2024-01-02", 4), ("bare", "SUCCESS", None, "r5", "2024-01-01", 5), ("unknown", "FAILED", False, "r6", "2024-01-01", 6)],
        "incident_id string, outcome string, validated_resolved boolean, result string, changed_at string, event_id long")
    after = {r.incident_id: r for r in inc.payloads_after_results(payloads, base, results).collect()}
    assert set(after) == {"failed", "bare", "calm"}
    assert json.loads(after["failed"].agent_result_payload) == {"outcome": "FAILED", "result": "r4"} and after["bare"].failure_payload == "{}"
    assert after["calm"].agent_result_payload == "{}"
    changes = spark.createDataFrame([("calm", None, "2024-01-03", 1), ("calm", "cause", "2024-01-02", 2), ("bare", "other", "2024-01-01", 3), ("unknown", "x", "2024-01-01", 4)],
                                    "incident_id string, diagnosis string, changed_at string, event_id long")
    said = {r.incident_id: json.loads(r.failure_payload) for r in inc.payloads_after_status(payloads, base, changes).collect()}
    assert said == {"gone": {"k": "gone"}, "failed": {"k": "failed"}, "calm": {"k": "calm", "diagnosis": "cause"}, "bare": {"diagnosis": "other"}}
