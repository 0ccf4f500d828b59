from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallylake.llm import langid
from tests.llm.helpers import documents

SYLLABLES = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ein", "ung", "ver"], "cc": ["ção", "que", "lho", "nha"]}


def corpus(spark, n=360):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 120))]
        rows.append((i, " ".join(words), lang, "s", 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert list(got["held_out"]) == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_held_out_labels_do_not_reach_the_model(spark):
    docs = corpus(spark, 120)
    wrong = docs.withColumn("lang", F.when(langid.is_held_out(), F.lit("zz")).otherwise(F.col("lang")))
    key = lambda d: [tuple(r) for r in langid.identify(d).orderBy("doc_id").collect()]
    assert key(docs) == key(wrong)


def test_pair_tables_give_the_same_convolution():
    rng = np.random.default_rng(0)
    net = langid.ByteCnn.fit(rng.integers(1, 256, (40, langid.WINDOW)).astype(np.uint8), np.arange(40) % 2, ["x", "y"], steps=5)
    windows = rng.integers(1, 256, (6, langid.WINDOW)).astype(np.uint8)
    tops = [sum(net.filters[w][j][windows[:, j:langid.WINDOW - w + 1 + j]] for j in range(w)).max(axis=1) for w in langid.WIDTHS]
    plain = langid._softmax(np.maximum(np.concatenate(tops, 1) + net.biases, 0) @ net.weights + net.offsets)
    assert np.allclose(net.probabilities(windows, net.pair_tables()), plain, atol=1e-5)


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    windows, labels = rng.integers(1, 256, (8, langid.WINDOW)).astype(np.uint8), np.arange(8) % 2
    net = langid.ByteCnn.fit(windows, labels, ["x", "y"], steps=3)

    def loss():
        tops = [sum(net.filters[w][j][windows[:, j:langid.WINDOW - w + 1 + j]].astype(float) for j in range(w)).max(axis=1) for w in langid.WIDTHS]
        p = langid._softmax(np.maximum(np.concatenate(tops, 1) + net.biases, 0) @ net.weights.astype(float) + net.offsets)
        return -np.log(p[np.arange(8), labels]).mean()

    grads = net._gradients(windows, labels)
    for param, grad in ((net.weights, grads[-2]), (net.offsets, grads[-1]), (net.biases, grads[-3])):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        held = param[at]
        param[at] = held + 1e-2
        up = loss()
        param[at] = held - 1e-2
        down = loss()
        param[at] = held
        assert abs((up - down) / 2e-2 - grad[at]) < 0.05 * abs(grad[at]) + 1e-4


def test_defined_cases(spark):
    docs = corpus(spark, 60)
    odd = documents(spark, [(900, None), (901, ""), (902, "12 + 3 !"), (None, "katomi toka"), (903, "scheinung verung einsch " * 9000), (904, "é")])
    odd = odd.withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in langid.predict(odd, langid.train(docs)).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert got[903]["lang_pred"] == "bb" and got[None]["lang_pred"] in SYLLABLES and got[904]["lang_pred"] in SYLLABLES
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(unlabelled).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_every_language_is_learned(spark):
    rng = random.Random(9)
    syllables = {f"l{k:02d}": [rng.choice("bcdfghjklmnprstvwz") + rng.choice("aeiou") + rng.choice("bcdfghjklmnprstvwz") for _ in range(4)] for k in range(70)}
    syllables["rare"] = ["þæð", "ðøþ", "æþø"]
    rows, trained = [], [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5]
    for lang, own in syllables.items():
        for _ in range(2 if lang == "rare" else 6):
            words = ["".join(rng.choice(own) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(15, 60))]
            rows.append((trained[len(rows)], " ".join(words), lang, "s", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    net = langid.train(docs)
    assert net.languages == sorted(syllables)
    got = langid.predict(docs, net).toPandas()
    right = (got["lang_pred"] == got["lang"]).groupby(got["lang"]).mean()
    assert right["rare"] == 1 and right.min() > 0.8
    counts = {r["lang"]: r["count"] for r in langid.training_windows(docs, per_language=3).groupBy("lang").count().collect()}
    assert counts["rare"] == 4 and sum(counts.values()) < 2 * 5 * 70


@pytest.mark.parametrize("doc_id", range(6))
def test_sample_is_whole_and_bounded_where_ids_repeat(spark, doc_id):
    rows = [(doc_id, f"wort nummer {i} und mehr") for i in range(300)] + [(doc_id, "immer der gleiche text")] * 300
    docs = documents(spark, rows).withColumn("lang", F.lit("de"))
    n = langid.training_windows(docs, per_language=50).count()
    assert n == (0 if docs.where(langid.is_held_out()).count() else 100)
