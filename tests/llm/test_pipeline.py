from __future__ import annotations

import os

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from tallylake.llm.queries import ORACLE, QUERIES
from tests.llm.helpers import deleted_lines, documents, jaccard_components

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Each stage's input and output on the smallest tables."""
    out, docs = {}, spark.read.parquet(f"{sf}/documents.parquet")
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(folder / name))
        out[name] = (docs, spark.read.parquet(str(folder / name)))
        docs = out[name][1]
    return out


def test_stages_keep_columns_and_whole_rows(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns
        kept = {r["doc_id"] for r in after.collect()}
        assert kept <= {r["doc_id"] for r in before.collect()} and kept
        if name != "lines":
            assert after.exceptAll(before).isEmpty()


def test_lines_and_groups_against_brute_force(stages):
    before, after = [{r["doc_id"]: r["text"] for r in frame.collect()} for frame in stages["lines"]]
    assert after == {i: t for i, t in deleted_lines(before, 50).items() if t.strip() or t == before[i]}
    before, after = [{r["doc_id"]: r["text"] for r in frame.collect()} for frame in stages["near_duplicates"]]
    assert set(after) == set(jaccard_components(before).values())


def test_packing_takes_every_document(stages):
    before, after = stages["packing"]
    assert {r["doc_id"] for r in before.collect()} == {r["doc_id"] for r in after.collect()}


def test_empty_tables_and_odd_rows(spark, tmp_path):
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(None, "ein text ohne nummer"), (1, None), (2, ""), (3, "same words here"), (3, "same words here"), (4, "Same words here"), (5, "12 34")]
    for n, docs in enumerate((documents(spark, []), documents(spark, rows))):
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{n}-{name}")
            stage(spark, docs, str(tmp_path)).write.parquet(path)
            docs = spark.read.parquet(path)
        # what has no letters goes, and of the rest one row of each text, with the five shingles of "same words here" one text
        assert sorted((r["doc_id"] or 0, r["piece"]) for r in docs.collect()) == ([] if n == 0 else [(0, 0), (3, 0)])


def test_unlike_texts_under_one_id_all_stay(spark):
    long = "a text of many words that has a near copy further on in the table, told by its shingles of five words"
    rows = [(1, long), (1, "quite another text under the same number"), (2, long + " ok"), (3, "a third text"), (3, "a third text"), (1, "short"), (None, "short"), (4, " ")]
    kept = corpus_pipeline.keep_one_of_each_group(spark, documents(spark, rows), "")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted(
        [(1, long), (1, "quite another text under the same number"), (3, "a third text"), (1, "short"), (0, "short"), (4, " ")])


def test_language_stage_without_labels_keeps_texts_with_letters(spark):
    docs = documents(spark, [(1, "ein text"), (2, "12 + 3 !"), (3, None), (4, ""), (None, "é")]).withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.keep_known_languages(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "é"), (1, "ein text")]


def test_every_operator_has_a_query():
    assert [n for n in range(1, 14) if not any(k.startswith(f"op{n}_") for k in QUERIES)] == []


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_against_sql(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    con = duckdb.connect()
    for file in os.listdir(sf):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{file}')")
    want = con.execute(ORACLE[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    key = lambda frame: frame[columns].sort_values(columns).astype(str).values.tolist()
    assert key(got) == key(want)
