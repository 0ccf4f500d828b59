"""Line dedup: repeated runs of lines found by distributed prefix doubling over line-ID sequences.

Lines get IDs, and IDs ranks. Round j gives every position i whose first 2**j lines occur elsewhere its rank among all such runs, from
the sorted pairs (rank of the first half, rank of the second half): the suffix array's order by the first 2**j lines, with equal runs
sharing a rank. Positions whose run is unique drop out, since nothing longer repeats there, so each round is smaller than the last one.
A run of any length l is then named by the two ranks of the largest power of two that fits, from its start and up to its end; the
positions with one name are an LCP interval of at least l lines.

What counts is a maximal repeated run of at least ``min_words`` words. Its lines are exactly those of the shortest such runs from each
start and to each end within it, and whether a run is the shortest of its kind depends on its own lines only; so those are named, and in
each interval all but the first position, by (doc_id, line), lose their lines. A copy that overlaps the first one keeps the
lines they share, so every deleted line still stands somewhere before.

Defined cases: lines end at line breaks and compare exactly; a null text stays null; a null doc_id takes no part and its text stays;
rows repeated in full are one document and lose the same lines; rows that share just the doc_id are ordered by a hash of their
text; an empty table gives no rows; all columns of the input are kept and ``text`` is replaced (``n_chars`` too where it exists).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylake.llm.common import cut

LINES = "doc_id long, th long, n int, h1 long, h2 long, len_a int, len_b int"
RUN = ("doc_id", "th", "n")


def shortest_runs(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Per line the length of the shortest run of ``min_words`` words from it, and of the one that ends with it; 0 if none."""
    before = np.concatenate([[0], np.cumsum(words)])
    at = np.arange(len(words))
    end = np.searchsorted(before, before[:-1] + min_words)
    len_a = np.where(end <= len(words), end - at, 0)
    start = np.searchsorted(before, before[1:] - min_words, side="right") - 1
    len_b = np.where(start >= 0, at + 1 - start, 0)
    return len_a, len_b


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """One row per position: rows repeated in full are reduced to one here, as lines, which are smaller to shuffle than texts."""
    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in frames:
            parts = []
            for doc_id, th, text in zip(batch["doc_id"], batch["th"], batch["text"], strict=True):
                own = text.split("\n")
                len_a, len_b = shortest_runs(np.fromiter((len(line.split()) for line in own), dtype=np.int64, count=len(own)), min_words)
                code = np.frombuffer(b"".join(xxhash.xxh3_128_digest(line.encode()) for line in own), dtype="<i8").reshape(-1, 2)
                parts.append((np.full(len(own), doc_id), np.full(len(own), th), np.arange(len(own), dtype=np.int32), code[:, 0], code[:, 1],
                              len_a.astype(np.int32), len_b.astype(np.int32)))
            if parts:
                columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                yield pd.DataFrame(dict(zip(("doc_id", "th", "n", "h1", "h2", "len_a", "len_b"), columns, strict=True)))

    slim = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return slim.mapInPandas(lines, LINES).dropDuplicates(list(RUN))


def _ranked(keys: DataFrame, *order: str) -> DataFrame:
    """``keys`` (one row each) plus ``rank``: numbers that rise with ``order`` over all partitions; stored, so they stay."""
    placed = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(placed.withColumn("rank", F.monotonically_increasing_id()))


def prefix_doubling(lines: DataFrame, longest: int) -> list[DataFrame]:
    """Per round j the positions (doc_id, th, n, rank) whose first 2**j lines occur more than once, up to ``longest`` lines."""
    repeated = lines.groupBy("h1", "h2").agg(F.count("*").alias("_times")).where("_times > 1").select("h1", "h2")
    first = lines.join(_ranked(repeated, "h1", "h2"), ["h1", "h2"]).select(*RUN, "rank")
    rounds, span = [cut(first)], 1
    while 2 * span <= longest:
        half = rounds[-1]
        second = half.select("doc_id", "th", (F.col("n") - span).alias("n"), F.col("rank").alias("rank_2"))
        pairs = half.join(second, list(RUN)).withColumnRenamed("rank", "rank_1")
        repeated = pairs.groupBy("rank_1", "rank_2").agg(F.count("*").alias("_times")).where("_times > 1").select("rank_1", "rank_2")
        step = cut(pairs.join(_ranked(repeated, "rank_1", "rank_2"), ["rank_1", "rank_2"]).select(*RUN, "rank"))
        if step.isEmpty():
            break
        rounds.append(step)
        span *= 2
    return rounds


def later_copies(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, th, low, high): lines low <= n < high of a document that a run before them holds already."""
    lines = cut(_lines(docs, min_words))
    needed = lines.agg(F.greatest(F.max("len_a"), F.max("len_b"))).first()[0] or 0
    rounds = prefix_doubling(lines, needed)
    ranks = rounds[0].withColumn("j", F.lit(0))
    for j, step in enumerate(rounds[1:], 1):
        ranks = ranks.union(step.withColumn("j", F.lit(j)))
    starts = lines.where("len_a > 0").select("doc_id", "th", "n", F.col("len_a").alias("length"))
    ends = lines.where("len_b > 0").select("doc_id", "th", (F.col("n") - F.col("len_b") + 1).alias("n"), F.col("len_b").alias("length"))
    runs = starts.union(ends).distinct().withColumn("j", F.floor(F.log2("length") + 1e-9).cast("int"))
    runs = runs.withColumn("_last", F.expr("n + length - shiftleft(1, j)"))
    head = ranks.select("doc_id", "th", "n", "j", F.col("rank").alias("rank_a"))
    tail = ranks.select("doc_id", "th", F.col("n").alias("_last"), "j", F.col("rank").alias("rank_b"))
    named = cut(runs.join(head, ["doc_id", "th", "n", "j"]).join(tail, ["doc_id", "th", "_last", "j"])
                .select("doc_id", "th", "n", "length", "rank_a", "rank_b"))
    name = ["length", "rank_a", "rank_b"]
    place = F.struct("doc_id", "th", "n")
    intervals = named.groupBy(*name).agg(F.min(place).alias("_first"), F.count("*").alias("_times")).where("_times > 1").drop("_times")
    copies = named.join(intervals, name).where(place > F.col("_first"))
    same = (F.col("doc_id") == F.col("_first.doc_id")) & (F.col("th") == F.col("_first.th"))
    return copies.select(
        "doc_id", "th",
        F.when(same, F.greatest("n", F.col("_first.n") + F.col("length"))).otherwise(F.col("n")).alias("low"),
        (F.col("n") + F.col("length")).alias("high"))


def _merge(ranges) -> list[dict[str, int]]:
    """Sorted ranges without overlaps."""
    out: list[list[int]] = []
    for low, high in sorted((r["low"], r["high"]) for r in ranges):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [{"low": low, "high": high} for low, high in out]


def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """All columns of ``docs`` with later copies of runs of at least ``min_words`` words deleted from ``text``, plus ``n_lines`` and
    ``n_removed`` (columns so named are replaced)."""
    copies = later_copies(docs, min_words)
    ranges = copies.where("low < high").groupBy("doc_id", "th").agg(F.collect_set(F.struct("low", "high")).alias("_ranges"))
    merged = F.udf(_merge, "array<struct<low: int, high: int>>")
    ranges = ranges.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), merged("_ranges").alias("_ranges"))
    own = docs.drop("n_lines", "n_removed")
    joined = own.join(ranges, (F.col("doc_id").cast("long") == F.col("_id")) & (F.xxhash64("text") == F.col("_th")), "left")
    lines = F.split("text", "\n")
    left = F.array_join(F.filter(lines, lambda line, i: ~F.exists("_ranges", lambda r: (r["low"] <= i) & (i < r["high"]))), "\n")
    removed = F.aggregate("_ranges", F.lit(0), lambda acc, r: acc + r["high"] - r["low"])
    text = F.when(F.col("_ranges").isNull(), F.col("text")).otherwise(left)
    columns = {"n_lines": F.size(lines), "n_removed": F.coalesce(removed, F.lit(0)), "text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("_ranges").isNull(), F.col("n_chars")).otherwise(F.length(left)).cast(docs.schema["n_chars"].dataType)
    return joined.withColumns(columns).drop("_id", "_th", "_ranges")
