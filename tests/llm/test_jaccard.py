from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallylake.llm import jaccard
from tallylake.llm.components import components
from tallylake.llm.shingles import Bands, block_keys, least_level, linked, shingle_set
from tests.llm.helpers import documents, jaccard_components, shingles


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
    return words


def near_copies(seed, bases=6, copies=7):
    rng = random.Random(seed)
    texts = []
    for _ in range(bases):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([3, 6, 12, 40, 150, 700]))]
        texts += [" ".join(edited(rng, base, rng.randint(0, max(1, len(base) // 25)))) for _ in range(copies)]
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("seed", range(3))
def test_components_against_all_pairs(spark, seed):
    texts = near_copies(seed)
    got = {r["doc_id"]: r for r in jaccard.jaccard_components(documents(spark, list(texts.items()))).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == jaccard_components(texts)
    assert all(got[i]["n_shingles"] == len(shingles(t)) for i, t in texts.items())


def test_chain_whose_ends_miss_the_first_document(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    texts = {0: " ".join(words)}
    for i in range(1, 14):  # each a few words on from the one before, all sharing most blocks
        words = edited(rng, words, 4)
        texts[i] = " ".join(words)
    shared = " ".join(f"s{i}" for i in range(12))
    texts |= {20 + i: shared + " " + " ".join(f"q{i}_{j}" for j in range(30)) for i in range(40)}
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(documents(spark, list(texts.items()))).collect()}
    assert got == jaccard_components(texts)


def test_linked_sets_share_a_key_in_every_band():
    rng = random.Random(2)
    for size in (1, 2, 3, 4, 5, 9, 15, 16, 17, 60, 64, 200, 1000):
        for _ in range(20):
            base = np.array(sorted({rng.getrandbits(64) for _ in range(size)}), dtype=np.uint64)
            other = base[np.array([rng.random() > 0.12 for _ in base], dtype=bool)]
            other = np.unique(np.concatenate([other, np.array([rng.getrandbits(64) for _ in range(rng.randint(0, size // 9 + 1))], dtype=np.uint64)]))
            if not linked(base, other):
                continue
            frequent = np.sort(base[: size // 2])
            levels = {}
            for s in (base, other):
                for scheme, difference in Bands.of(len(s)):
                    levels[scheme] = max(levels.get(scheme, 0), least_level(s, scheme, difference))
            a, b = [{k for scheme, d in Bands.of(len(s)) for k in block_keys(s, scheme, levels[scheme], d, frequent).tolist()} for s in (base, other)]
            assert a & b


def test_link_rule_and_shingles():
    a = np.arange(700, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a.sort()
    assert linked(a, a[:525]) and not linked(a, a[:524])
    assert len(shingle_set("a b c d e f")) == 2 and len(shingle_set("A  b\tC\x0bd\ne")) == 1 and len(shingle_set("a b")) == 1
    assert np.array_equal(shingle_set("ABC d e f g"), shingle_set("abc D E F G")) and not np.array_equal(shingle_set("É a"), shingle_set("é a"))
    assert len(shingle_set("a b c")) == 1 and len(shingle_set(None)) == len(shingle_set(" \n")) == 0


def test_runs_do_not_depend_on_batches():
    keys, docs = np.array([1, 1, 2, 3, 3, 3, 3, 3, 4, 4], dtype=np.int64), np.arange(10, dtype=np.int64)
    frame = pd.DataFrame({"key": keys, "doc_id": docs})
    pairs = lambda frames: {(r.leader, r.doc_id) for f in jaccard._runs(iter(frames)) for r in f.itertuples()}
    want = {(0, 1), (3, 4), (3, 5), (3, 6), (3, 7), (8, 9)}
    assert pairs([frame]) == want
    for size in (1, 2, 3, 4):
        assert pairs([frame.iloc[a:a + size] for a in range(0, 10, size)]) == want


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(205, 200), (200, 203), (205, 205)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 140)} == {100} and {got[i] for i in (200, 203, 205)} == {200}


def test_defined_cases(spark):
    long = "many words " * 20000
    rows = [(None, "x y z"), (1, None), (2, ""), (3, " \n "), (4, "x y z"), (5, "X  y\tz"), (6, long), (7, long), (7, "q r s"), (9, "q r s")]
    docs = documents(spark, rows).withColumn("component_id", F.lit("clash"))
    got = sorted(((r["doc_id"] is None, r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()), key=str)
    assert got == sorted([(True, None, 1, None), (False, 1, 0, 1), (False, 2, 0, 2), (False, 3, 0, 3), (False, 4, 1, 4), (False, 5, 1, 4),
                          (False, 6, 2, 6), (False, 7, 2, 6), (False, 7, 1, 6), (False, 9, 1, 6)], key=str)
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_components_join_links_in_blocks_and_in_rounds_alike(spark, monkeypatch):
    from tallylake.llm import components as module

    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    frame = spark.createDataFrame(links, "a long, b long").repartition(5)
    at_once = sorted(tuple(r) for r in components(frame).collect())
    monkeypatch.setattr(module, "BLOCK", 0)
    assert sorted(tuple(r) for r in components(frame).collect()) == at_once
    more = spark.createDataFrame([(301, 5), (302, 303), (7, 9)], "a long, b long")
    want = sorted(tuple(r) for r in components(frame.union(more)).collect())
    assert sorted(tuple(r) for r in module.absorb(components(frame), more).collect()) == want


def test_components_are_found_in_few_shuffles(spark):
    """Each shuffle and broadcast costs the driver a thread; a chain of links took dozens."""
    links = spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long")
    before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    assert {r["component"] for r in components(links).collect()} == {0}
    assert spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - before <= 6
