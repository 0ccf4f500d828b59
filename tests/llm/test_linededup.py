from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallylake.llm import linededup
from tests.llm.helpers import deleted_lines, documents


def run(spark, texts, min_words):
    rows = linededup.dedup_lines(documents(spark, list(texts.items())), min_words).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    return {r["doc_id"]: r["text"] for r in rows}


@pytest.mark.parametrize("seed", range(4))
def test_against_all_runs(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randint(0, 30)}" for _ in range(rng.randint(0, 4))) for _ in range(8)]
    texts = {}
    for i in range(25):
        lines = [rng.choice(pool) for _ in range(rng.randint(1, 14))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), f"unique {i}")
        texts[i] = "\n".join(lines)
    assert run(spark, texts, 5) == deleted_lines(texts, 5)


def test_copies_passages_and_short_lines(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    texts = {
        1: f"start one\n{passage}\nend one", 2: f"start two\n{passage}\nend two", 3: f"start one\n{passage}\nend one",
        4: "common line\nown words", 5: "common line\nother words", 6: f"{passage}\n{passage}",
    }
    got = run(spark, texts, 50)
    assert got == {**texts, 2: "start two\nend two", 3: "", 6: ""}


def test_overlapping_repeats_keep_the_first_copy(spark):
    texts = {1: "\n".join(["a b"] * 7)}
    assert run(spark, texts, 6)[1] == deleted_lines(texts, 6)[1] == "\n".join(["a b"] * 3)


def test_one_line_in_most_documents(spark):
    line = " ".join(f"x{i}" for i in range(60))
    texts = {i: f"own {i}\n{line}" for i in range(150)}
    got = run(spark, texts, 50)
    assert got[0] == texts[0] and all(got[i] == f"own {i}" for i in range(1, 150))


def test_defined_cases(spark):
    long = "\n".join(f"line {i} of a long text" for i in range(3000))
    docs = documents(spark, [(None, long), (1, None), (2, ""), (3, long), (4, long), (4, long), (5, "\n\n")])
    docs = docs.withColumn("n_removed", F.lit("clash")).withColumn("rank", F.lit(1))
    got = [(r["doc_id"], r["text"], r["n_removed"]) for r in linededup.dedup_lines(docs, 50).collect()]
    assert sorted(got, key=str) == sorted(
        [(None, long, 0), (1, None, 0), (2, "", 0), (3, long, 0), (4, "", 3000), (4, "", 3000), (5, "\n\n", 0)], key=str)
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_rows_repeated_in_full_enter_the_rounds_once(spark):
    run_of_lines = [f"w{i}" for i in range(40)]
    first, later = "\n".join(["own a", *run_of_lines, "end a"]), "\n".join(["own b", *run_of_lines, "", "end b"])
    docs = documents(spark, [(1, first)] * 20 + [(2, later)] * 20 + [(3, "only once\n\nhere")] * 20)
    lines = linededup._lines(docs, 40)
    assert lines.count() == 42 + 43 + 3
    rounds = linededup.prefix_doubling(lines, 40)
    assert [step.count() for step in rounds] == [82, 78, 74, 66, 50, 18]
    got = sorted((r["doc_id"], r["text"], r["n_removed"]) for r in linededup.dedup_lines(docs, 40).collect())
    assert got == [(1, first, 0)] * 20 + [(2, "own b\n\nend b", 40)] * 20 + [(3, "only once\n\nhere", 0)] * 20
