from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tallylake.llm import quality
from tests.llm.helpers import documents


def corpus(spark, n=600, seed=1):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words = [f"word{rng.randint(0, 400)}" for _ in range(rng.randint(20, 80))]
        grade = i % 3
        if grade == 0:
            words = [w.upper() + "!!" for w in words]
        if grade == 1:
            words.insert(rng.randint(0, len(words)), rng.choice(["scum", "idiot", "trash"]))
        texts.append(" ".join(words))
        if i < n // 2:
            labels.append((i, int(grade > 0), int(grade == 1)))
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_grades(spark):
    docs, labels = corpus(spark)
    got = quality.classify(docs, labels).where("doc_id >= 300").toPandas()
    grade = got["doc_id"] % 3
    assert (got["keep"] == (grade == 2)).mean() > 0.95
    means = got.groupby(grade)["expected_grade"].mean()
    assert means[0] < means[1] < means[2] and got["tail"].between(0, 1).all()


def test_thresholds_are_ordered_and_weights_shared():
    rows = [np.array([g, 10 + g]) for g in range(3)] * 200
    model = quality.CumulativeLink.fit(rows, np.array([0, 1, 2] * 200))
    assert model.thresholds[0] <= model.thresholds[1]
    tails = model.tails(np.array([model.weights[r].sum() for r in rows[:3]]))
    assert (tails[:, 0] >= tails[:, 1]).all() and tails[0, 0] < 0.5 < tails[1, 0] and tails[1, 1] < 0.5 < tails[2, 1]


def test_defined_cases(spark):
    docs, labels = corpus(spark, 120)
    odd = documents(spark, [(900, None), (901, ""), (902, " \n"), (None, "word1 word2"), (903, "word1 " * 20000), (903, "word1 " * 20000)])
    odd = odd.withColumn("keep", F.lit("clash"))
    messy = labels.union(spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 0, 0), (2, 1, 0)], labels.schema))
    model = quality.train(docs, messy)
    got = quality.score(odd, model).collect()
    assert len(got) == 6 and all(not r["keep"] for r in got if r["doc_id"] in (900, 901, 902))
    assert len({(r["tail"], r["keep"]) for r in got if r["doc_id"] == 903}) == 1
    nothing = quality.classify(odd.limit(0).unionByName(odd), labels.limit(0)).collect()
    assert {r["doc_id"] for r in nothing if r["keep"]} == {None, 903}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_grades_of_labels(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 0)], "q int, t int")
    assert [r[0] for r in rows.select(quality.grade_of(F.col("q"), F.col("t"))).collect()] == [0, 0, 1, 2]


def test_slopes_against_finite_differences():
    rng, h = np.random.default_rng(2), 1e-6
    for _ in range(50):
        score, grade, t = rng.normal(), int(rng.integers(3)), np.sort(rng.normal(size=2)) + [0, 0.1]
        loss, by_score, by_threshold = quality.gradient(score, grade, t)
        cut = [1, *(1 / (1 + np.exp(t - score))), 0]
        assert abs(loss + np.log(cut[grade] - cut[grade + 1])) < 1e-9
        at = lambda s, c: quality.gradient(s, grade, c)[0]
        assert abs((at(score + h, t) - at(score - h, t)) / (2 * h) - by_score) < 1e-5
        for j in range(2):
            step = np.eye(2)[j] * h
            assert abs((at(score, t + step) - at(score, t - step)) / (2 * h) - by_threshold[j]) < 1e-4


def test_fit_reaches_the_likelihood_of_a_plain_descent():
    """One feature per grade and a shared one: thresholds and weights by plain gradient descent give the same tails."""
    rng = np.random.default_rng(7)
    kind = rng.integers(0, 3, size=900)
    grades = np.where(rng.random(900) < 0.8, kind, rng.integers(0, 3, size=900))
    model = quality.CumulativeLink.fit([np.array([k]) for k in kind], grades, epochs=30, l1=0.0)
    w, t = np.zeros(3), np.array([-1.0, 1.0])
    for _ in range(4000):
        gw, gt = np.zeros(3), np.zeros(2)
        for k in range(3):
            for g in range(3):
                n = ((kind == k) & (grades == g)).sum()
                _, by_score, by_threshold = quality.gradient(w[k], g, t)
                gw[k] += n * by_score
                gt += n * by_threshold
        w, t = w - 0.002 * gw, t - 0.002 * gt
    want = 1 / (1 + np.exp(t[None, :] - w[:, None]))
    assert np.abs(model.tails(model.weights[:3]) - want).max() < 0.06


def test_sample_is_bounded_where_ids_repeat(spark):
    docs = documents(spark, [(1, f"text number {i}") for i in range(1500)] + [(2, "word")] * 1501)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.sample_of(docs, labels, 18).count() == 2
