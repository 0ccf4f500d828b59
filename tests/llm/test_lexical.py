from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from tallylake.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, top=10):
    """Per item the sorted (score, doc_id) of its first documents, all documents scored."""
    read = [(i, Counter(terms(t))) for i, t in docs]
    read = [(i, c) for i, c in read if c]
    n_docs, n_terms = len(read), sum(c.total() for _, c in read)
    df = Counter(t for _, c in read for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for i, c in read:
            m = 100 - 90 + (90 * c.total() * n_docs) // n_terms
            w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(terms(text)) if c[t]}
            score = sum(w[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in w)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item_id, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def searched(spark, docs, items, settings=lexical.Settings(), parts=3):
    frame = spark.createDataFrame([(i, t, "clash", "clash") for i, t in docs], "doc_id long, text string, n string, terms string").repartition(parts)
    asked = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, rank string")
    return sorted((tuple(r) for r in lexical.search(frame, asked, settings).collect()), key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Ünder", "das9", "x"]
    odds = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(words, odds, k=rng.randint(1, 60)))) for i in range(n)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(12)]
    return docs, items


@pytest.mark.parametrize("settings", [
    lexical.Settings(), lexical.Settings(leaf_rows=2, shard_rows=40), lexical.Settings(leaf_rows=3, shard_entries=100, terms_at_once=20),
    lexical.Settings(leaf_rows=1, bound_bytes=1)])
def test_against_scoring_everything(spark, settings):
    docs, items = corpus(1, 400)
    assert searched(spark, docs, items, settings) == plain(docs, items)


def test_copies_ties_and_odd_rows(spark):
    docs, items = corpus(2, 80)
    docs += [(1000 + i, docs[0][1]) for i in range(50)] + [(5, docs[5][1])] * 3 + [(None, docs[7][1]), (2000, None), (2001, ""), (2002, "... --"), (2003, "\x00w1\x7fW1[w2")]
    items += [(50, None), (51, ""), (52, "?!"), (53, "unknownword"), (54, docs[0][1]), (54, "w1"), (None, "w2 W2 w3"), (55, "ÜNDER ünder Ünder")]
    assert searched(spark, docs, items, lexical.Settings(leaf_rows=4, shard_rows=30)) == plain(docs, items)


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PIECE_BYTES", 64)
    docs, items = corpus(3, 30)
    docs.append((99, "w1 w2, w3 " * 20_000))
    assert [t.decode() for piece in lexical.terms_of("ab, " * 100) for t in piece] == ["ab"] * 100
    assert searched(spark, docs, items) == plain(docs, items)


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([], [])])
def test_empty_tables(spark, docs, items):
    assert searched(spark, docs, items) == []


def test_fewer_documents_are_scored_than_there_are(spark):
    """Bounds do leave subtrees out."""
    import numpy as np

    rng = np.random.default_rng(6)
    n, words = 2000, 40
    sizes = rng.integers(1, 6, size=n)
    own = np.concatenate([np.sort(rng.choice(words, size=s, replace=False)) for s in sizes])
    tree = lexical.Tree(list(range(n)), np.full(n, 100), sizes, own, np.ones(len(own), dtype=np.int64), np.arange(1, words + 1) * 10, 8)
    offered = []

    class Counting(lexical.Best):
        def offer(self, score, doc_id):
            offered.append(doc_id)
            super().offer(score, doc_id)

    item = np.array([0, 38, 39])
    member = np.zeros(words, dtype=bool)
    member[item] = True
    best = Counting(10)
    tree.search(item, member, best)
    assert 10 <= len(offered) < n / 10
