from __future__ import annotations

import numpy as np
import pytest

from tallylake.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def table(spark, vectors):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 0, "clash") for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA)


def exact(vectors, query, top):
    own = np.asarray(dict(vectors)[query], dtype=np.float32).astype(float)
    scored = [(-float((np.asarray(v, dtype=np.float32).astype(float) * own).sum()), i) for i, v in vectors if i != query]
    return [(i, -s) for s, i in sorted(scored)[:top]]


@pytest.mark.parametrize("clustered", [True, False])
def test_recall_and_exact_scores(spark, clustered):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 24)) * (3 if clustered else 0)
    vectors = [(i, centres[i % 30] + rng.normal(size=24)) for i in range(900)]
    settings = ann.Settings(centroid_rows=60, block_rows=100, block_queries=20)
    got = ann.search(table(spark, vectors), settings).toPandas()
    hits = 0
    for query, rows in got.groupby("query_id"):
        rows = rows.sort_values("rank")
        assert list(rows["rank"]) == list(range(1, 21))
        want = dict(exact(vectors, query, 20))
        hits += len(set(rows["vec_id"]) & set(want))
        for vec_id, score in zip(rows["vec_id"], rows["score"], strict=True):
            assert vec_id not in want or abs(score - want[vec_id]) < 1e-9
    assert got["query_id"].nunique() == 45 and hits / (45 * 20) >= 0.9


def test_copies_and_ties_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(6)
    vectors = [(i, [1.0, 0, 0, 0]) for i in range(100)] + [(i, rng.normal(size=4) * 0.1) for i in range(100, 160)]
    got = ann.search(table(spark, vectors)).toPandas()
    for query in (0, 20, 80, 100, 140):
        rows = got[got["query_id"] == query].sort_values("rank")
        want = exact(vectors, query, 20)
        assert list(rows["vec_id"]) == [i for i, _ in want]
        assert np.allclose(rows["score"], [s for _, s in want], atol=1e-12)


def test_vectors_that_take_no_part(spark):
    bad = [(20, None), (40, [0.0, 0, 0]), (60, [1.0, None, 0]), (80, [float("nan"), 0, 1]), (100, [float("inf"), 0, 0]), (120, [1.0, 1.0]), (140, [])]
    good = [(0, [1.0, 2, 3]), (1, [0.5, 0, 0]), (2, [-1.0, 0, 0]), (None, [9.0, 9, 9])]
    got = ann.search(table(spark, bad + good)).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 0.5), (0, 2, -1.0)]
    assert ann.search(table(spark, [])).count() == 0
    assert ann.search(table(spark, bad)).count() == 0


def test_bounds_hold_the_true_inner_products():
    rng = np.random.default_rng(7)
    block = ann.CodedBlock(rng.normal(size=(500, 32)), rng.normal(size=32) * 0.2, ann.rotation(32, 1))
    queries = rng.normal(size=(40, 32))
    estimate, width = block.estimate(queries, 3.0)
    inside = np.abs(estimate - queries @ block.vectors.T) <= width
    assert inside.mean() > 0.99 and block.codes.shape == (500, 4)
