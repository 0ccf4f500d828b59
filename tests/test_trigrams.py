"""Search by trigram postings finds what a scan finds."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallylake.sources import trigrams, views
from tallylake.operators import incidents as inc

TEXTS = ["Alpha beta", "alphabet", "be", "", None, "aaaa", "aaa", "Ärger über ÄRGER", "x%y_z", "the quick brown fox", "quick the brown", "a\nb c"]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rows = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(TEXTS)], "id string, body string")
    path = str(tmp_path_factory.mktemp("trigrams"))
    trigrams.write_index(rows, "id", F.lower("body"), path)
    return rows, path


@pytest.mark.parametrize("term", ["alpha", "ALPHABET", "bet", "be", "a", "", "  ", "aaaa", "aaa", "ärger", "%y_", "quick brown", "the quick brown fox jumps", "zzz", "\nb ", "x" * 50])
def test_same_rows_as_a_scan(indexed, term):
    rows, path = indexed
    want = {f"k{i}" for i, t in enumerate(TEXTS) if not term.strip() or t is not None and term.strip().lower() in t.lower()}
    assert {r.id for r in trigrams.search(rows, "id", F.lower("body"), path, term).collect()} == want


def test_only_the_rarest_postings_are_read(spark, sf, tmp_path):
    rows = views.incidents(spark, sf)
    trigrams.write_index(rows, "incident_id", inc.searched_text(), str(tmp_path))
    first = rows.orderBy("incident_id").first().incident_id
    held = trigrams.candidates(rows, "incident_id", str(tmp_path), first.lower())
    assert 0 < held.count() < rows.count() / 5
    text = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [folder" in text and "PushedFilters: [In(trigram" in text
