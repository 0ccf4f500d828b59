"""Similarity search against brute force, over many small blocks and a dominating tenant."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallylake.operators import similarity as sim

MEMORY = "tenant_id string, incident_id string, adapter string, root_cause string, embedding array<float>"


def corpus(n=240, dim=6, seed=5):
    """Two thirds in one tenant, with exact copies of one vector and a zero vector."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        vector = [1.0, 2.0, 0.0, 0.0, 0.0, 1.0] if i % 6 == 0 else [rng.gauss(0, 1) for _ in range(dim)]
        rows.append(("big" if i % 3 else "small", f"INC-{i}", rng.choice(["spark", "synapse"]), f"c{i}", [0.0] * dim if i == 7 else vector))
    return rows


def brute(queries, memory, k):
    out = {}
    for tenant, qid, adapter, _, q in queries:
        found = []
        for t, mid, a, _, m in memory:
            if t != tenant:
                continue
            x, y = np.asarray(q, dtype=np.float32).astype(float), np.asarray(m, dtype=np.float32).astype(float)
            size = np.linalg.norm(x) * np.linalg.norm(y)
            distance = round(1.0 - (float(x @ y) / size if size else 0.0), 9)
            found.append((distance, mid, a))
        nearest = sorted(found)[: 3 * k]
        ranked = sorted(nearest, key=lambda r: (r[2] != adapter, -round(min(1.0, max(0.0, 1.0 - r[0])), 4), r[0], r[1]))
        out[tenant, qid] = {r[1]: round(min(1.0, max(0.0, 1.0 - r[0])), 4) for r in ranked[:k]}
    return out


@pytest.mark.parametrize(("q_block", "m_block", "k"), [(4096, 16384, 5), (7, 11, 3)])
def test_equals_brute_force(spark, q_block, m_block, k):
    rows = corpus()
    memory = spark.createDataFrame(rows, MEMORY)
    queries = memory.filter("incident_id LIKE '%1' OR incident_id LIKE '%6' OR incident_id = 'INC-7'").withColumnRenamed("incident_id", "query_id")
    wanted = [r for r in rows if r[1][-1] in "16" or r[1] == "INC-7"]
    got = {}
    for r in sim.similar_incidents(queries, memory, k, q_block, m_block).collect():
        got.setdefault((r.tenant_id, r.query_id), {})[r.incident_id] = r.similarity
    assert got == brute(wanted, rows, k)


def test_empty_memory_and_unknown_tenant(spark):
    rows = corpus(12)
    memory = spark.createDataFrame(rows, MEMORY)
    queries = memory.withColumnRenamed("incident_id", "query_id")
    assert sim.similar_incidents(queries, memory.limit(0)).count() == 0
    assert sim.similar_incidents(queries.withColumn("tenant_id", F.lit("other")), memory).count() == 0


def test_memory_upsert_and_get_stay_in_the_tenant(spark):
    writes = spark.createDataFrame([("a", "i", "old", 1, 1), ("a", "i", "new", 2, 2), ("b", "i", "other", 3, 1)],
                                   "tenant_id string, incident_id string, document string, event_id int, written_at int")
    memory = sim.memory_upsert(writes)
    assert {(r.tenant_id, r.document) for r in memory.collect()} == {("a", "new"), ("b", "other")}
    wanted = spark.createDataFrame([("c", "i"), ("a", "i")], "tenant_id string, incident_id string")
    assert [r.document for r in sim.memory_get(memory, wanted).collect()] == ["new"]


def test_known_signatures(spark):
    rows = [
        ("t", "oom", "java.lang.OutOfMemoryError: Java heap space\nExecutorLostFailure"),
        ("t", "path", "java.io.FileNotFoundException: Path does not exist: /data"),
        ("t", "skew", "Task 5 running far longer"),
    ]
    df = spark.createDataFrame(rows, "tenant_id string, incident_id string, body string")
    got = {(r.incident_id, r.pattern): (r.hits, r.hit_ratio) for r in sim.failure_pattern_scan(df, "body", sim.FAILURE_PATTERNS["spark"]).collect()}
    assert got["oom", "executor_out_of_memory"] == (3, 1.0)
    assert got["oom", "executor_lost"] == (1, 0.3333)
    assert got["path", "input_path_missing"] == (2, 0.6667)
    assert not any(i == "skew" for i, _ in got)
    azure = sim.failure_pattern_scan(df.withColumn("body", F.lit("Activity TIMEDOUT, linked service down")), "body", sim.FAILURE_PATTERNS["synapse"])
    assert {r.pattern for r in azure.collect()} == {"pipeline_timeout", "linked_service_failure"}


def test_metadata_as_text(spark):
    df = spark.sql("SELECT named_struct('a', 1, 'b', array('x'), 'c', true) AS m")
    assert df.select(sim.metadata_as_text("m").alias("t")).first()["t"] == {"a": "1", "b": '["x"]', "c": "true"}
