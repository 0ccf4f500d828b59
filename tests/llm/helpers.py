"""Brute-force versions and small inputs for the tests of this package."""

from __future__ import annotations

import bisect
from collections import defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, schema=DOCS):
    """One row per (doc_id, text) or per text, ids from 0."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], schema)


def shingles(text):
    words = text.encode().lower().split() if text else []
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def jaccard_components(texts):
    """{doc_id: component} by comparing all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def deleted_lines(texts, min_words):
    """{doc_id: text} with every later copy of a run of lines deleted, by looking at all runs."""
    first, gone = {}, defaultdict(set)
    for i in sorted(texts):
        lines = texts[i].split("\n")
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = tuple(lines[a:b])
                if sum(len(line.split()) for line in run) < min_words:
                    continue
                if run in first:
                    other, at = first[run]
                    gone[i].update(range(max(a, at + len(run)) if other == i else a, b))
                else:
                    first[run] = (i, a)
    return {i: "\n".join(line for k, line in enumerate(t.split("\n")) if k not in gone[i]) for i, t in texts.items()}


def best_fit_rooms(lengths, capacity):
    """Rooms left by best-fit decreasing, one piece after another."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, length)
        room = rooms.pop(i) if i < len(rooms) else capacity
        bisect.insort(rooms, room - length)
    return rooms
