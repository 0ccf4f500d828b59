from __future__ import annotations

import numpy as np
import pytest

from tallylake.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, n string"


def table(spark, vectors):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], "clash", None) for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA)


def plain(vectors, components=8):
    """{component: explained}, whitened rows and deviations by numpy."""
    x = np.floor(1024 * np.array([np.asarray(v, dtype=np.float32) for v in vectors], dtype=float)).astype(np.int64) + 100_000
    n, apart = len(x), len(x) * x - x.sum(axis=0)
    centred = apart / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    order = [i for i in np.argsort(-values)[:components] if values[i] > 1e-12 * values.max()]
    return values[order] / np.trace(covariance), centred @ vectors[:, order] / np.sqrt(values[order]), (apart.astype(object) ** 2).sum(axis=1)


def compare(got, vectors, ids):
    explained, whitened, deviation = plain(vectors)
    k = len(explained)
    got = got.sort_values(["vec_id", "component"])
    assert len(got) == k * len(vectors) and set(got["component"]) == set(range(1, k + 1)) and set(got["n"]) == {len(vectors)}
    own = got["whitened"].to_numpy().reshape(-1, k)
    order = np.argsort(ids, kind="stable")
    signs = np.sign((own * whitened[order]).sum(axis=0))
    assert np.abs(own - signs * whitened[order]).max() < 1e-6
    assert got["deviation"].to_numpy().reshape(-1, k)[:, 0].tolist() == [int(d) for d in deviation[order]]
    assert np.allclose(got["explained"].to_numpy()[:k], explained, rtol=1e-9) and got["identity_error"].max() < 1e-6


def test_against_numpy_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    monkeypatch.setattr(whitening, "SPLIT_BYTES", 1 << 12)
    rng = np.random.default_rng(3)
    vectors = list(rng.normal(size=(150, 12)) * rng.uniform(0.5, 4, size=12) + 7)
    got = whitening.whiten(table(spark, list(enumerate(vectors))).repartition(5)).toPandas()
    compare(got, vectors, np.arange(150))


def test_odd_rows_are_dropped_and_copies_stay(spark):
    rng = np.random.default_rng(4)
    good = list(rng.normal(size=(40, 4)))
    good += [good[0]] * 20
    odd = [(100, None), (101, []), (102, [1, None, 2, 3]), (103, [1, float("nan"), 2, 3]), (104, [float("inf"), 0, 0, 0]), (105, [1, 2, 3])]
    rows = [*enumerate(good[:40]), *[(40 + i, v) for i, v in enumerate(good[40:])], *odd]
    got = whitening.whiten(table(spark, rows)).toPandas()
    assert got["vec_id"].max() == 59
    compare(got, good, np.arange(60))


def test_directions_without_variance_have_no_component(spark):
    rng = np.random.default_rng(5)
    line = rng.normal(size=(30, 1))
    vectors = list(np.hstack([line, line * 0 + 3, rng.normal(size=(30, 1))]))
    got = whitening.whiten(table(spark, list(enumerate(vectors)))).toPandas()
    compare(got, vectors, np.arange(30))
    assert set(got["component"]) == {1, 2}


@pytest.mark.parametrize("vectors", [[], [(1, None)], [(1, [2.0, 3.0]), (2, [2.0, 3.0]), (None, [2.0, 3.0])]])
def test_nothing_to_whiten(spark, vectors):
    got = whitening.whiten(table(spark, vectors))
    assert got.columns == [c.split()[0] for c in whitening.SCHEMA.split(", ")] and got.isEmpty()


def test_deviation_beyond_64_bits_is_null(spark):
    vectors = [[1e7 * (i % 2), float(i)] for i in range(400)]
    got = whitening.whiten(table(spark, list(enumerate(vectors)))).toPandas()
    _, _, deviation = plain(vectors)
    assert min(deviation) > 1 << 63 and got["deviation"].isna().all()
