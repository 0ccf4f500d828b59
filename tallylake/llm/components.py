"""Connected components of a link table: by rounds of least labels and pointer jumps, and at once where a task's block holds all links.

Labels never leave the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylake.llm.common import cut, stored

BLOCK = 1 << 18  # links that one task joins in its memory


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All links -> (id, component)."""
    above: dict[int, int] = {}

    def least(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for batch in frames:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            lo, hi = sorted((least(above.setdefault(a, a)), least(above.setdefault(b, b))))
            above[hi] = lo
    yield pd.DataFrame({"id": list(above), "component": [least(x) for x in above]}, dtype="int64")


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (id, component): each id of a link with the smallest id that links reach."""
    links = stored(links.select("a", "b"), "links")
    if links.count() <= BLOCK:
        return stored(links.coalesce(1).mapInPandas(_joined, "id long, component long"), "components")
    both = cut(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).select(F.col("a").alias("id"), "component"))
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("b"), "component"), "b")
            .groupBy("a").agg(F.min("component").alias("_near"))
        )
        hooked = labels.join(near, labels["id"] == near["a"]).select("id", F.col("component").alias("_was"), F.least("component", "_near").alias("_to"))
        jump = labels.select(F.col("id").alias("_to"), F.col("component").alias("_further"))
        moved = cut(hooked.join(jump, "_to").select("id", "_was", F.least("_to", "_further").alias("component")))
        labels = moved.select("id", "component")
        if moved.where(F.col("_was") != F.col("component")).isEmpty():
            return stored(labels, "components")


def absorb(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, component) after more ``links`` (a, b); an id that has no label yet is a component of its own."""
    return components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links.select("a", "b")))
