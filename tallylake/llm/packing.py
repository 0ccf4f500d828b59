"""Best-fit packing of tokenized documents into sequences of fixed length.

Best-fit decreasing: pieces go by falling length, each into the open sequence with the least room that still takes it. A sequence
is told apart from others only by its room, so pieces of one length can be dealt in runs: the plan is made from the counts per
length alone, with a segment tree over the rooms 0..capacity that finds the tightest open one in logarithmic time. Counts are at
most ``capacity`` rows and the plan at most a few runs for each pair of length and room, however many documents there are. It is
the very packing that dealing single pieces gives.

Every piece then needs its rank among those of its length: a number in a bounded bucket plus the counts of the buckets before, so
that no length, however frequent, meets in one task. The plan's runs turn rank into sequence and offset.

Defined cases: a null text is empty, so it is the closing id alone; a document longer than ``capacity`` is cut into full pieces and
a rest; rows repeated in full are packed once each; ties go by bucket, id and piece; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallylake.llm.common import cut

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
TEXTS_AT_ONCE = 256


def tokenize_and_cut(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, closing_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the closing one, cut into pieces."""

    def cut_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tallylake.llm.tokens import word_ids

        coder = word_ids(tokenizer_path)
        for batch in batches:
            for at in range(0, len(batch), TEXTS_AT_ONCE):
                part = batch.iloc[at:at + TEXTS_AT_ONCE]
                rows = []
                for doc_id, ids in zip(part["doc_id"], coder.encode_batch(list(part["text"])), strict=True):
                    data = ids.tobytes() + np.uint32(closing_id).tobytes()
                    for piece, begin in enumerate(range(0, len(data), 4 * capacity)):
                        own = data[begin:begin + 4 * capacity]
                        rows.append((doc_id, piece, begin // 4, len(own) // 4, zlib.crc32(own)))
                frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                yield frame.astype({"doc_id": "Int64"})

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return slim.mapInPandas(cut_texts, PIECES)


class RoomTree:
    """Counts of open sequences by room, as a segment tree; finds the smallest room that is large enough."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += n
            node >>= 1

    def tightest(self, length: int) -> int | None:
        node = length + self.leaves
        if self.count[node]:
            return length
        while node > 1:  # up to the first subtree on the right that has one, then down its left edge
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def plan_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first sequence, pieces per sequence, offset) of best-fit decreasing over counts per length."""
    tree, open_at = RoomTree(capacity), {}
    runs, opened = [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            open_at.setdefault(room, []).append((first, n))
            tree.add(room, n)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            else:
                first, n = open_at[room].pop()
                tree.add(room, -n)
            each = room // length
            used = min(n, -(-left // each))
            dealt = min(left, used * each)
            runs.append((length, rank, first, each, capacity - room))
            rest = dealt - (used - 1) * each
            put(room - each * length, first, used - (rest < each))
            if rest < each:
                put(room - rest * length, first + used - 1, 1)
            put(room, first + used, n - used)
            rank, left = rank + dealt, left - dealt
    return runs


def pack(pieces: DataFrame, capacity: int = 2048, bucket_rows: int = 8192) -> DataFrame:
    """``pieces`` plus ``sequence_id`` and ``offset``; reads its input more than once, so give it stored rows."""
    spark = pieces.sparkSession
    counts = {row["length"]: row["n"] for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = 1 + sum(counts.values()) // bucket_rows
    placed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    ahead = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("length", "_bucket").agg(F.count("*").alias("_n")).select(
        "length", "_bucket", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = placed.withColumn("_within", within).join(before, ["length", "_bucket"]).withColumn(
        "_rank", F.col("_before") + F.col("_within") - 1)
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, *run in plan_runs(counts, capacity):
        by_length.setdefault(length, []).append(tuple(run))
    plan = spark.createDataFrame(
        list(by_length.items()), "length int, _runs array<struct<rank: long, sequence: long, each: int, offset: int>>")
    run = F.element_at(F.filter("_runs", lambda r: r["rank"] <= F.col("_rank")), -1)
    inside = F.col("_rank") - F.col("_run.rank")
    return (
        ranked.join(F.broadcast(plan), "length")  # a row per length, so at most ``capacity`` rows
        .withColumn("_run", run)
        .withColumn("sequence_id", (F.col("_run.sequence") + F.floor(inside / F.col("_run.each"))).cast("long"))
        .withColumn("offset", (F.col("_run.offset") + F.pmod(inside, F.col("_run.each")) * F.col("length")).cast("long"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    packed = pack(cut(tokenize_and_cut(docs, tokenizer_path, capacity)), capacity)
    return packed.withColumn("length", F.col("length").cast("long"))
